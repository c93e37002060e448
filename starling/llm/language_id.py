"""Language identification by hierarchical discrimination.

A text's features are its byte trigrams (A-Z lower-cased), hashed to
``FEATURES`` places, as square roots of their shares, so each text is a vector
of length one whatever its own length.  Linear one-versus-rest support vector
machines predict the language *family*; within the family, one linear machine
for each pair of languages votes on the language.  Most votes win, then the
larger sum of margins, then the first language by name.

Fitting: dual coordinate descent on the squared hinge loss, over ``max_train``
labelled rows of each language, whole texts, or over all it has with a letter.
The rows are chosen by a hash of the id; this is the only sampling, and no
language is left out.  Every text is scored whole.

Defined results: ``und`` with score 0 for a null text and for one without a
letter.  A null id belongs to no fold: not held out, and not learned from.
Without any labelled row every text is ``und``; with one language, that one has
score 1.  Languages that ``FAMILIES`` doesn't list are families of their own.
Repeated rows get equal results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starling.llm.common import fold, pick, prepare

FEATURES = 4096
BATCH = 256

#: Families of ISO 639-1 codes.
FAMILIES = {
    "baltic": "lt lv",
    "germanic": "af da de en fy is lb nl no nb nn sv yi",
    "indic": "bn gu hi mr ne pa sa ur",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tk tr uz",
    "uralic": "et fi hu",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or any(c.isalpha() for c in raw.decode("utf-8", "replace") if c > "\x7f" and c != "�")


def vector(raw: bytes) -> np.ndarray:
    """Square roots of the shares of the hashed byte trigrams of a whole text."""
    x = np.frombuffer(b" " + raw.lower() + b" ", np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(FEATURES, np.float32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    n = np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - FEATURES.bit_length() + 1), minlength=FEATURES)
    return np.sqrt(n / (len(x) - 2)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 30, seed: int = 3) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine; y is +1 or -1."""
    r = np.random.default_rng(seed)
    n = len(x)
    balance = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    damping = 1 / (2 * cost * balance)
    w, alpha = np.zeros(x.shape[1] + 1), np.zeros(n)
    xb = np.hstack([x, np.ones((n, 1), x.dtype)]).astype(np.float64)
    norm = (xb * xb).sum(1) + damping
    for _ in range(epochs):
        moved = 0.0
        for i in r.permutation(n):
            slope = y[i] * (w @ xb[i]) - 1 + damping[i] * alpha[i]
            step = max(alpha[i] - slope / norm[i], 0.0) - alpha[i]
            if step:
                w += step * y[i] * xb[i]
                alpha[i] += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


class Hierarchy:
    """Family machines, and pair machines within each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        family = {k: FAMILY_OF.get(k.lower().split("-")[0], k) for k in self.langs}
        self.families = sorted(set(family.values()))
        self.members = [[k for k in self.langs if family[k] == f] for f in self.families]
        own, lang = np.array([family[k] for k in langs]), np.array(langs)
        rest = self.families if len(self.families) > 2 else self.families[:1] * (len(self.families) == 2)
        cols = [fit_svm(x, np.where(own == f, 1.0, -1.0)) for f in rest]
        self.pairs: list[list[tuple[int, int, int]]] = []
        for group in self.members:
            self.pairs.append([])
            for a in range(len(group)):
                for b in range(a + 1, len(group)):
                    rows = (lang == group[a]) | (lang == group[b])
                    self.pairs[-1].append((a, b, len(cols)))
                    cols.append(fit_svm(x[rows], np.where(lang[rows] == group[a], 1.0, -1.0)))
        self.rest = len(rest)
        self.w = np.array(cols, np.float32).T if cols else np.zeros((x.shape[1] + 1, 0), np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages, and scores: sure families with wide margins over every rival come near 1."""
        z = (x @ self.w[:-1] + self.w[-1]).astype(np.float64)
        sure = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
        if self.rest == 0:
            best, score = np.zeros(len(x), int), np.ones(len(x))
        elif self.rest == 1:
            best, score = (z[:, 0] < 0).astype(int), sure(np.abs(z[:, 0]))
        else:
            f = np.sort(z[:, : self.rest], axis=1)
            best, score = z[:, : self.rest].argmax(1), sure((f[:, -1] - f[:, -2]) / 2)
        out = np.empty(len(x), object)
        for k, group in enumerate(self.members):
            rows = np.flatnonzero(best == k)
            votes, margins = np.zeros((len(rows), len(group))), np.zeros((len(rows), len(group)))
            least = np.full((len(rows), len(group)), np.inf)
            for a, b, col in self.pairs[k]:
                m = z[rows, col]
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                margins[:, a] += m
                margins[:, b] -= m
                least[:, a], least[:, b] = np.minimum(least[:, a], m), np.minimum(least[:, b], -m)
            top = votes == votes.max(1, keepdims=True) if len(rows) else votes.astype(bool)
            win = np.where(top, margins, -np.inf).argmax(1) if len(rows) else np.zeros(0, int)
            for r, v in zip(rows, win):
                out[r] = group[v]
            if len(group) > 1 and len(rows):
                score[rows] *= sure(least[np.arange(len(rows)), win])
        return list(out), np.clip(score, 0.0, 1.0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable=None, max_train: int = 500) -> Hierarchy | None:
    prepare(docs.sparkSession)
    d = pick(docs, _id=id_col, _text=text_col, _lang=lang_col).where(F.col("_lang").isNotNull() & F.col("_id").isNotNull() & F.col("_text").rlike(r"\p{L}"))
    if usable is not None:
        d = d.where(usable(F.col("_id")))
    counts = d.groupBy("_lang").agg(F.count("*").alias("n"))
    # a hash of the id thins each language to about twice the bound, then the least hashes are taken
    draw = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1_000_000))
    some = d.withColumn("h", draw).join(F.broadcast(counts), "_lang")  # a row for each language
    some = some.where(F.col("h") < F.floor(F.lit(2_000_000 * max_train) / F.col("n")) + 1).select("_lang", "h", F.col("_id").cast("string").alias("i"), F.col("_text").cast("binary").alias("t"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("h", "i", "t"))
    chosen = some.withColumn("k", rank).where(F.col("k") <= max_train).select("_lang", "h", "i", "t")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [vector(t.as_buffer().to_pybytes()) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([zlib.compress(v.tobytes(), 1) for v in x], pa.binary())], names=["lang", "h", "i", "x"])

    # vectors, not texts, come to the driver: their size is fixed, so a text of any length can be learned from whole
    rows = sorted(tuple(r) for r in chosen.mapInArrow(shrink, "lang string, h long, i string, x binary").collect())
    return Hierarchy(np.array([np.frombuffer(zlib.decompress(r[3]), np.float32) for r in rows]), [r[0] for r in rows]) if rows else None


def predict_languages(docs: DataFrame, model: Hierarchy | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` of each row of ``docs``."""
    prepare(docs.sparkSession)
    d = pick(docs, _id=id_col, _text=text_col).select("_id", F.coalesce(F.col("_text"), F.lit("")).cast("binary").alias("t"))
    kind = d.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            langs: list[str] = ["und"] * len(texts)
            scores = np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            for k in range(0, len(rows), BATCH):
                take = rows[k : k + BATCH]
                got, s = model.predict(np.array([vector(texts[i]) for i in take]))
                scores[take] = s
                for i, v in zip(take, got):
                    langs[i] = v
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["_id", "lang_pred", "score"])

    return d.mapInArrow(run, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict_languages(docs, train(docs, usable=lambda c: fold(c, 3) != 1))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
