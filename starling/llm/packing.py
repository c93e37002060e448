"""Packing of documents into fixed windows by lexical retrieval.

Documents are tokenized once, each followed by an end id, and written to the shared
folder.  One pass over that table takes the corpus statistics: in how many documents each
term (token id) is, and the mean length; at most one row for each id of the tokenizer
comes to the driver.  Documents are then routed by content: a document's key is made of the
least hashes of its ``RARE`` largest ids (merges learned last, so rare ones), which similar
documents mostly share.  Partitions are formed by the key's first hash and sorted by the whole
key; Spark sizes them, and splits those that a hot key makes too large.  Consecutive
documents form shards (``SHARD_TOKENS`` or ``SHARD_DOCS``, a bound of a task's memory
whatever the partition).

Each shard gets a BM25 inverted index over its token ids, with the statistics of the
corpus.  A window starts with a seed document; the index ranks the unused documents by their
score for all of the seed's terms, and they fill the window one after the other.  A
document that doesn't fit is cut at the window's end, and its rest seeds the
next window, so only the last window of a shard can need padding.  Without any
neighbour left the next unused document in order is taken.  A document longer
than a window fills windows of its own first.

A seed sees the documents of its shard only, so what lies in other shards isn't found (README has figures).
Windows are the same whenever a lost task runs again, as its rows are sorted.

Defined results: null and empty texts are the end id alone.  Every id lies in
exactly one piece.  A window's pieces lie without gaps from offset 0.  Window
numbers are unique, not dense (the partition's number times 2**33, plus a count).
Equal rows are packed one by one.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import pick, prepare, settle

SHARD_TOKENS, SHARD_DOCS = 2 << 20, 60_000
RARE, KEY = 16, 4  # of so many largest ids so many least hashes
K1, B = 1.2, 0.75
NEIGHBOURS = 16  # so many of a ranking are sorted at a time
GRID = float(1 << 24)  # scores are multiples of its inverse, so their sums are exact and the same in any order
TABLE = 1 << 22  # pairs of documents of a shard whose scores for frequent terms are worked out at once

#: Characters whose classes all regular-expression engines agree on.
_PLAIN_BYTES = bytes([9, 10, 13, *range(0x20, 0x7F)])
_UNSURE = re.compile("[^¡-ɏ]")
_AHEAD = r"\s+(?!\S)|"
_BLANKS = bytes.maketrans(b"\t\n\r", b"   ")  # all blanks of plain texts


class Ids:
    """Ids of a byte-level BPE file of the ``tokenizers`` library.

    Texts of plain characters go through ``tiktoken`` with the same vocabulary,
    which is several times faster and gives the same ids; texts with one of the
    file's added tokens, or with characters outside plain Latin, go through
    ``tokenizers`` itself.  The pattern's look-ahead only says where a run of two or more blanks
    is cut, and makes matching slow, so texts without such a run are matched without it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.fast = self.single = None
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            import public_tokenizers
            import tiktoken

            byte = _byte_letters()
            ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
            if sorted(ranks.values()) == list(range(len(ranks))):
                self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
                self.single = tiktoken.Encoding("single", pat_str=public_tokenizers.PATTERN.replace(_AHEAD, ""), mergeable_ranks=ranks, special_tokens={})

    def plain(self, raw: bytes, text: str) -> bool:
        rest = raw.translate(None, _PLAIN_BYTES)
        return not (rest and (_UNSURE.search(rest.decode("utf-8", "replace")))) and not any(a in text for a in self.added)

    def __call__(self, raw: bytes) -> np.ndarray:
        text = raw.decode("utf-8", "replace")
        if self.fast is not None and self.plain(raw, text):
            fast = self.fast if b"  " in raw.translate(_BLANKS) else self.single
            return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Ids:
    return Ids(path)


class Corpus:
    """Statistics of all documents: inverse document frequencies of terms, and the mean length."""

    def __init__(self, documents: int, tokens: int, df: np.ndarray):
        self.idf = np.log1p((documents - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean = max(tokens / max(documents, 1), 1e-9)


class Bm25:
    """Inverted index of a shard: postings by term, with their scores worked out.

    ``corpus`` has the statistics of all documents; without, they are taken from ``docs``.
    """

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        n = len(docs)
        self.n = n
        sizes = np.array([len(d) for d in docs])
        terms = int(max((d.max() for d in docs if len(d)), default=0)) + 1
        key = np.repeat(np.arange(n, dtype=np.uint64), sizes) << np.uint64(32) | np.concatenate(docs).astype(np.uint64)
        if terms <= 1 << 16:
            key = (key >> np.uint64(16) | key & np.uint64(0xFFFF)).astype(np.uint32)
        shift = key.dtype.type(16 if key.dtype == np.uint32 else 32)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.append(first, len(key))).astype(np.float32)
        key = key[first]
        doc, term = (key >> shift).astype(np.int32), (key & ((key.dtype.type(1) << shift) - key.dtype.type(1))).astype(np.int32)
        df = np.bincount(term, minlength=terms)
        corpus = corpus or Corpus(n, int(sizes.sum()), df)
        self.idf = np.where(df > 1, corpus.idf[:terms], 0).astype(np.float32)  # a term of one document of the shard finds no other
        norm = K1 * (1 - B + B * sizes / corpus.mean)
        score = np.rint((self.idf[term] * tf * (K1 + 1) / (tf + norm[doc].astype(np.float32))).astype(np.float64) * GRID) / GRID
        self.doc_begin = np.searchsorted(doc, np.arange(n + 1))
        self.term = term
        order = np.argsort(term.astype(np.uint16) if terms <= 1 << 16 else term, kind="stable")
        self.posting, self.score = doc[order].astype(np.intp), score[order]
        self.begin = np.concatenate([[0], np.cumsum(df)])
        # terms of many documents as whole rows: adding a row is faster than adding its postings
        self.rows = {}
        for t in np.flatnonzero(df > n / 8).tolist():
            row = self.rows[t] = np.zeros(n)
            row[self.posting[self.begin[t] : self.begin[t + 1]]] = self.score[self.begin[t] : self.begin[t + 1]]
        self.rare = self.idf > 0
        self.rare[list(self.rows)] = False
        # and the sums of these rows for all seeds at once, one matrix product, where they are not too many
        self.frequent = None
        if self.rows and n * n <= TABLE:
            has = np.zeros((n, len(self.rows)))
            for i, t in enumerate(self.rows):
                has[self.posting[self.begin[t] : self.begin[t + 1]], i] = 1
            self.frequent = has @ np.stack([*self.rows.values()])

    def neighbours(self, seed: int, used: np.ndarray) -> list[int]:
        return list(self.ranked(seed, used))

    def ranked(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents by falling score for all of the seed's terms; of equal scores the earlier document first."""
        own = self.term[self.doc_begin[seed] : self.doc_begin[seed + 1]]
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in own[self.rare[own]].tolist()]
        found = np.zeros(self.n)
        if spans:
            found = np.bincount(np.concatenate([self.posting[x] for x in spans]), weights=np.concatenate([self.score[x] for x in spans]), minlength=self.n)
        if self.frequent is not None:
            found = found + self.frequent[seed]
        else:
            for t in own.tolist():
                if t in self.rows:
                    found += self.rows[t]
        found[used] = 0
        left, k = np.flatnonzero(found > 0), NEIGHBOURS
        while len(left):
            score = found[left]
            least = np.partition(score, len(left) - k)[len(left) - k] if len(left) > k else 0
            best = left[score >= least]
            yield from best[np.lexsort((best, -found[best]))].tolist()
            left, k = left[score < least], 2 * k


def fill_windows(docs: list[np.ndarray], size: int, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) of each piece; ``docs`` are all non-empty."""
    index = Bm25(docs, corpus)
    used = np.zeros(len(docs), bool)
    out: list[tuple[int, int, int, int, int]] = []
    window, at, next_unused = 0, 0, 0

    def put(d: int) -> int:
        """Append a document piece by piece; the window that holds its end stays open."""
        nonlocal window, at
        start = 0
        while start < len(docs[d]):
            n = min(size - at, len(docs[d]) - start)
            out.append((d, start, n, window, at))
            start, at = start + n, at + n
            if at == size:
                window, at = window + 1, 0
        return d

    while next_unused < len(docs):
        if used[next_unused]:
            next_unused += 1
            continue
        seed = next_unused
        used[seed] = True
        put(seed)
        while at:  # fill the open window; a cut document is the next one's seed
            opened = window
            for d in index.ranked(seed, used):
                used[d] = True
                put(d)
                if window != opened:
                    seed = d
                    break
            else:
                break
    return out


def distinct_terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of each document's distinct ids, ascending; ``docs`` are some thousands at most."""
    key = np.repeat(np.arange(len(docs), dtype=np.uint64), [len(d) for d in docs]) << np.uint64(32) | np.concatenate(docs).astype(np.uint64)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF)


def routes(docs: list[np.ndarray]) -> np.ndarray:
    """A row of words for each (non-empty) document: the least hashes of its largest ids, in ascending order, filled up with ones."""
    doc, term = distinct_terms(docs)
    ends = np.searchsorted(doc, np.arange(len(docs)), side="right")
    at = ends[:, None] - 1 - np.arange(RARE)
    h = (term * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    h = np.where((at >= 0) & (doc[np.maximum(at, 0)] == np.arange(len(docs))[:, None]), h[np.maximum(at, 0)], np.uint64(0xFFFFFFFF))
    return np.sort(h, axis=1)[:, :KEY]


def _pack(ids: np.ndarray) -> bytes:
    """Ids in words of two or four bytes, and a last byte that says which."""
    return ids.astype("<u2").tobytes() + b"2" if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4").tobytes() + b"4"


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[:-1], f"<u{raw[-1:].decode()}").astype("<u4")


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``_id, head, key, ids`` of ``docs`` (``_id, t``): packed ids, and where the document belongs."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path)
        for b in batches:
            for k in range(0, len(b), 1024):
                part = b.slice(k, 1024)
                ids = [np.append(encode(t.as_buffer().to_pybytes()), np.uint32(end_id)).astype("<u4") for t in part.column(1)]
                keys = routes(ids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys[:, 0].astype(np.int64)), pa.array([x.tobytes() for x in keys.astype(">u4")], pa.binary()), pa.array([_pack(x) for x in ids], pa.binary())], names=["_id", "head", "key", "ids"])

    return docs.mapInArrow(run, f"_id {kind}, head long, key binary, ids binary")


def corpus(tokens: DataFrame) -> Corpus:
    """Statistics of all documents; combined in each task, then one row for each token id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, n = np.zeros(0, np.int64), 0, 0
        for b in batches:
            for k in range(0, len(b), 1024):
                ids = [_unpack(x.as_buffer().to_pybytes()) for x in b.column(0).slice(k, 1024)]
                more = np.bincount(distinct_terms(ids)[1].astype(np.int64))
                df, more = (df, more) if len(df) >= len(more) else (more, df)
                df[: len(more)] += more
                documents, n = documents + len(ids), n + sum(map(len, ids))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([[documents, n], df[at]]))], names=["term", "n"])

    rows = {r.term: r.n for r in tokens.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents, n = rows.pop(-2, 0), rows.pop(-1, 0)
    df = np.zeros(max(rows, default=0) + 1, np.int64)
    df[list(rows)] = list(rows.values())
    return Corpus(documents, n, df)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: ``id_col, start, length, doc_tokens, sequence_id, offset, ids`` (little-endian unsigned 32-bit)."""
    prepare(docs.sparkSession)
    d = pick(docs, _id=id_col, _text=text_col).select("_id", F.coalesce(F.col("_text"), F.lit("")).cast("binary").alias("t"))
    kind = d.schema["_id"].dataType.simpleString()
    tokens = settle(tokenized(d, tokenizer_path, end_id), "tokens")
    stats = corpus(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, window = TaskContext.get().partitionId() << 33, 0
        for names, ids in _shards(batches):
            pieces = fill_windows(ids, size, stats)
            for k in range(0, len(pieces), 4096):
                p = pieces[k : k + 4096]
                d, start, length, seq, offset = (np.array(x, dtype=np.int64) for x in zip(*p))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(d)), pa.array(start), pa.array(length), pa.array(np.array([len(ids[i]) for i in d], dtype=np.int64)), pa.array(base + window + seq), pa.array(offset), pa.array([ids[i][s : s + n].tobytes() for i, s, n, _, _ in p], pa.binary())],
                    names=["_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )
            window += int(pieces[-1][3]) + 1

    routed = tokens.hint("rebalance", "head").sortWithinPartitions("key", F.xxhash64("_id"), "ids").select("_id", "ids")
    return routed.mapInArrow(run, f"_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary").withColumnRenamed("_id", id_col)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Names and token ids of the partition's documents, a shard at a time."""
    names, ids, size = [], [], 0
    for b in batches:
        begin = 0
        for i, x in enumerate(b.column(1)):
            ids.append(_unpack(x.as_buffer().to_pybytes()))
            size += len(ids[-1])
            if size >= SHARD_TOKENS or len(ids) >= SHARD_DOCS:
                names.append(b.column(0).slice(begin, i + 1 - begin))
                yield pa.concat_arrays(names), ids
                names, ids, size, begin = [], [], 0, i + 1
        names.append(b.column(0).slice(begin))
    if ids:
        yield pa.concat_arrays(names), ids


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
