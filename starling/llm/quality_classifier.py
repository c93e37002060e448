"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, and learned filters of ``WIDTH`` bytes run over the whole
document in steps of ``STEP``.  The document is cut into chunks of ``CHUNK``
bytes that overlap by ``WIDTH - STEP``, so every filter position of the whole
text lies in exactly one chunk.  In each chunk each filter keeps its maximum.
The largest and the mean of a document's chunk maxima enter one logistic unit,
whose output is the score.  A filter is applied in ``WIDTH / STEP`` slices, each
one matrix product over the embedded bytes laid out in rows, which needs no copy
of overlapping windows.

Fitting: Adam on the logistic loss, on ``max_train`` labelled rows of each class (the
least by a hash of the id; all of them if there are fewer) of at most ``max_train_chars``
characters each; these bounds are the only sampling.  Everything is seeded: the same rows give
the same network.  An id whose labels contradict each other isn't learned from; of an
id's different texts the least is.

Defined results: null and empty texts are one chunk of padding and get the
score the network gives that.  A null id belongs to no fold: it is not held out,
and not learned from.  Repeated rows get equal scores.  If the labelled rows
lack a class the score is 1 or 0 for the class there is, 0.5 without any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import fold, pick, prepare

DIM, WIDTH, STEP, FILTERS, CHUNK = 8, 8, 4, 24, 2048
PAD = 256
BATCH_BYTES, ROWS = 1 << 18, 512
THRESHOLD = 0.7


class ByteNet:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "emb": r.normal(0, 0.5, (257, DIM)).astype(f),
            "w": r.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)).astype(f),
            "b": np.zeros(FILTERS, f),
            "v": r.normal(0, 0.1, 2 * FILTERS).astype(f),
            "c": np.zeros(1, f),
        }
        self.constant: float | None = None

    @staticmethod
    def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes in rows of STEP (each document padded to whole steps and one filter
        width), the row of each filter position, where chunks start among the positions, and each chunk's document."""
        lead = WIDTH // STEP - 1
        sizes = np.array([max(1, -(-len(t) // STEP) - lead) for t in texts])  # filter positions
        rows = sizes + lead
        begins = np.concatenate([[0], np.cumsum(rows)])
        buf = np.full((begins[-1], STEP), PAD, np.int16)
        flat = buf.reshape(-1)
        for t, at in zip(texts, begins):
            if t:
                flat[at * STEP : at * STEP + len(t)] = np.frombuffer(t, np.uint8)
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        positions = np.arange(firsts[-1]) + np.repeat(begins[:-1] - firsts[:-1], sizes)
        per = CHUNK // STEP
        n_chunks = -(-sizes // per)
        docs = np.repeat(np.arange(len(texts)), n_chunks)
        nth = np.arange(len(docs)) - np.repeat(np.concatenate([[0], np.cumsum(n_chunks)])[:-1], n_chunks)
        return buf, positions, firsts[:-1][docs] + nth * per, docs

    def filter_values(self, buf: np.ndarray, positions: np.ndarray) -> np.ndarray:
        x = self.p["emb"][buf.reshape(-1)].reshape(len(buf), STEP * DIM)
        out = None
        for k in range(WIDTH // STEP):
            part = x @ self.p["w"][k * STEP * DIM : (k + 1) * STEP * DIM]
            part = part[positions + k]
            out = part if out is None else out + part
        return out

    def pooled(self, texts: list[bytes]):
        buf, positions, chunks, docs = self.lay_out(texts)
        z = self.filter_values(buf, positions)
        top = np.maximum(np.maximum.reduceat(z, chunks, axis=0) + self.p["b"], 0)
        firsts = np.searchsorted(docs, np.arange(len(texts)))
        counts = np.diff(np.append(firsts, len(docs)))[:, None]
        most = np.maximum.reduceat(top, firsts, axis=0)
        mean = np.add.reduceat(top, firsts, axis=0) / counts
        return np.hstack([most, mean]).astype(np.float32), (buf, positions, chunks, docs, z, top, most, counts)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, begin = [], 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= BATCH_BYTES):
                size += len(texts[end])
                end += 1
            h, _ = self.pooled(texts[begin:end])
            out.append(1 / (1 + np.exp(-np.clip(h.astype(np.float64) @ self.p["v"] + float(self.p["c"][0]), -30, 30))))
            begin = end
        return np.concatenate(out) if out else np.zeros(0)

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        h, (buf, positions, chunks, docs, z, top, most, counts) = self.pooled(texts)
        p = 1 / (1 + np.exp(-(h @ self.p["v"] + self.p["c"][0])))
        err = ((p - y) * weight / len(y)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["v"], g["c"][0] = h.T @ err, err.sum()
        to_most, to_mean = err[:, None] * self.p["v"][:FILTERS], err[:, None] * self.p["v"][FILTERS:] / counts
        at_top = (top == most[docs]) & (top > 0)
        shared = np.maximum(np.add.reduceat(at_top, np.searchsorted(docs, np.arange(len(texts))), axis=0, dtype=np.float32), 1)
        d = np.where(top > 0, to_mean[docs], 0) + np.where(at_top, (to_most / shared)[docs], 0)
        g["b"] = d.sum(0)
        ends = np.append(chunks[1:], len(z))
        win = np.empty((len(chunks), FILTERS), np.int64)
        for k in range(len(chunks)):
            win[k] = chunks[k] + z[chunks[k] : ends[k]].argmax(0)
        rows = positions[win][:, :, None] + np.arange(WIDTH // STEP)
        taken = buf[rows].reshape(len(chunks), FILTERS, WIDTH).astype(np.int64)
        x = self.p["emb"][taken].reshape(len(chunks), FILTERS, WIDTH * DIM)
        g["w"] = np.einsum("cfk,cf->kf", x, d)
        to_x = (d[:, :, None] * self.p["w"].T[None]).reshape(-1, DIM)
        np.add.at(g["emb"], taken.reshape(-1), to_x)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 11) -> ByteNet:
        if len(texts) == 0 or len(set(labels.tolist())) < 2:
            self.constant = float(labels[0]) if len(texts) else 0.5
            return self
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for i in range(0, len(order), batch):
                take = order[i : i + batch]
                g = self.gradients([texts[j] for j in take], labels[take], weights[take])
                t += 1
                lr = rate * (1 - (t - 1) / total)
                for k in self.p:
                    grad = g[k] + 1e-4 * self.p[k] * (k in ("w", "v"))
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    s[k] = 0.999 * s[k] + 0.001 * grad * grad
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int, max_train_chars: int, usable) -> list:
    """(id, text, label) of ``max_train`` rows of each class, or of all there are; those with the least hash of the id.

    Labels meet the ids of documents that can be learned from before any are chosen, so none is chosen in vain.
    """
    lab = pick(labels, _id=id_col, _y=label_col).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & usable(F.col("_id")))
    lab = lab.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").select("_id", "_y")
    d = pick(docs, _id=id_col, _text=text_col).where(F.length("_text") <= max_train_chars)
    there = d.select("_id").join(lab, "_id").distinct()  # ids alone cross the shuffle
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = there.where("_y = 0").orderBy(*order).limit(max_train).union(there.where("_y = 1").orderBy(*order).limit(max_train))
    rows = d.join(F.broadcast(chosen), "_id").select("_id", F.col("_text").cast("binary").alias("t"), "_y")  # chosen: 2 * max_train rows at most
    return sorted(tuple(r) for r in rows.groupBy("_id", "_y").agg(F.min("t").alias("t")).select("_id", "t", "_y").collect())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 1000, max_train_chars: int = 20_000, usable=None, seed: int = 7) -> ByteNet:
    rows = training_rows(docs, labels, id_col, text_col, label_col, max_train, max_train_chars, usable or (lambda c: F.lit(True)))
    y = np.array([r[2] for r in rows], np.float32)
    share = max(y.mean(), 1e-6) if len(y) else 0.5
    weights = np.sqrt(np.where(y == 1, 0.5 / share, 0.5 / max(1 - share, 1e-6))).astype(np.float32)  # halfway to balanced classes
    return ByteNet(seed).fit([bytes(r[1]) for r in rows], y, weights)


def _scored(net: ByteNet, b: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with the scores of the texts in column ``at``; a few rows at a time bound the memory."""
    for k in range(0, len(b), ROWS):
        part = b.slice(k, ROWS)
        yield part, net.scores([t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()])


def score_documents(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` of each row of ``docs``."""
    prepare(docs.sparkSession)
    d = pick(docs, _id=id_col, _text=text_col)
    kind = d.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, scores in _scored(net, b, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["_id", "score"])

    return d.mapInArrow(run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, net: ByteNet, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, with all their columns."""
    prepare(docs.sparkSession)
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, scores in _scored(net, b, at):
                yield part.filter(pa.array(scores >= threshold))

    return flat.mapInArrow(run, flat.schema).toDF(*docs.columns)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = train(docs, labels, usable=lambda c: fold(c, 4) != 2)
    out = score_documents(docs, net)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
