"""Substring deduplication by super-k-mer partitioning.

A window is ``window`` consecutive words.  Its *minimiser* is the smallest hash
among its runs of ``MER`` words.  Neighbouring windows mostly share their
minimiser, so a maximal stretch of such windows (a super-k-mer) travels as one
packed string to the bucket its minimiser names.  Equal windows have equal
minimisers, so they meet in one bucket; there the strings with the same
minimiser are cut into windows again, and sorting these counts them exactly, by
their bytes.  The stretches of windows that occur again go back to their
documents, where the words they cover are removed.

Bounded memory and skew:

* A mapping task works through its texts in portions (``PORTION`` bytes).  Equal
  packed strings of a portion are combined: their occurrences are known to
  repeat on the spot, and one copy goes on for others to meet.  So a group
  of copies, however large, sends a bucket one string per portion.
* A passage with a thousand contexts makes a thousand different strings with
  one minimiser.  Minimisers with more than ``HOT_LEAST`` strings and one in
  ``HOT_SHARE`` of all are found by a first pass (each task reports only those
  above its own share, so at most ``HOT_SHARE`` keys come back to the driver,
  whatever the input).  Their windows travel one by one, each to a bucket named
  by the hash of its own words.  Both ways compare bytes: results are the same.
* Strings for one bucket from one portion are packed into one compressed row;
  there are ``BUCKETS_A_PART`` buckets for each shuffle partition, handled one
  after the other.
* A bucket combines equal strings as they arrive, so a passage that every
  portion sends is held once.  Beyond ``BUCKET_BYTES`` of different strings
  (minimisers just below the share of hot ones) it goes on through a spill file
  of the task, read in passes of bounded size.

Defined results: null and empty texts have no words.  Documents shorter than a
window keep everything.  Each row is a document of its own: rows that repeat a
text remove each other's windows, whatever their ids, and each row yields one
row.  Null ids are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import parts, pick, prepare, settle

MER = 4
LONGEST = 64  # windows of a super-k-mer, at most
PORTION, HASHED = 16 << 20, 1 << 20
HOT_LEAST, HOT_SHARE = 500, 8192
BUCKETS_A_PART = 4
BUCKET_BYTES, HELD, SLOTS = 64 << 20, 200, 4096  # a bucket's strings in memory, with HELD more bytes each; slots of minimisers, which passes over a spill file take
NO_ID = -(1 << 63)

ENTRY = np.dtype([("key", "<u4"), ("id", "<i8"), ("hash", "<i8"), ("start", "<u4"), ("size", "<u4"), ("windows", "<u2"), ("flags", "u1")])
KNOWN, REPEATS = 1, 2  # occurrences are known to repeat; its minimiser occurs in it more than once
SPAN = np.dtype([("id", "<i8"), ("hash", "<i8"), ("begin", "<u4"), ("end", "<u4")])

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``buf`` and their ends; every word is followed by one space."""
    a = np.frombuffer(buf, np.uint8)
    ends = np.flatnonzero(a == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends + 1 - starts
    powers = np.cumprod(np.full(int(sizes.max()), _P, np.uint64))
    place = np.arange(len(a)) - np.repeat(starts, sizes)
    return _mix(np.add.reduceat((a.astype(np.uint64) + np.uint64(1)) * powers[place], starts)), ends


def super_kmers(hashes: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, minimiser and REPEATS flag of each super-k-mer.

    ``counts`` are the documents' numbers of words, each ``window`` at least;
    a window's number is that of its first word.
    """
    mer, n = hashes, 1
    while n < MER:
        mer = _mix(mer[: len(mer) - n] * _P + mer[n:])
        n *= 2
    span = window - MER + 1
    low, n = mer, 1
    while 2 * n <= span:
        low = np.minimum(low[: len(low) - n], low[n:])
        n *= 2
    low = np.minimum(low[: len(mer) - span + 1], low[span - n : span - n + len(mer) - span + 1])  # the least of ``span`` in a row
    n_windows = counts - window + 1
    first_word = np.concatenate([[0], np.cumsum(counts)[:-1]])
    first = np.concatenate([[0], np.cumsum(n_windows)])
    at = np.arange(first[-1]) + np.repeat(first_word - first[:-1], n_windows)
    value = low[at]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    new[first[:-1]] = True
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at)))
    if length.max() > LONGEST:
        cuts = -(-length // LONGEST)
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = np.repeat(begin, cuts) + nth * LONGEST
        length = np.minimum(LONGEST, np.repeat(length, cuts) - nth * LONGEST)
    start, least = at[begin], value[begin]
    mers = length + span - 1
    ends = np.cumsum(mers)
    inside = np.arange(ends[-1]) + np.repeat(start - (ends - mers), mers)
    same = np.add.reduceat(mer[inside] == np.repeat(least, mers), ends - mers, dtype=np.int32)
    return start, length, least, np.where(same > 1, REPEATS, 0)


class Texts:
    """Up to about HASHED bytes of texts of at least ``window`` words, and their super-k-mers."""

    def __init__(self, rows: list[tuple[int, int, list[bytes]]], window: int):
        self.rows = rows
        self.buf = b" ".join([b" ".join(w) for _, _, w in rows]) + b" "
        counts = np.array([len(w) for _, _, w in rows])
        self.hashes, self.ends = word_hashes(self.buf)
        self.start, self.length, self.least, self.flags = super_kmers(self.hashes, counts, window)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.doc = np.searchsorted(self.first, self.start, side="right") - 1
        self.place = self.start - self.first[self.doc]
        self.byte_from = np.where(self.start > 0, self.ends[self.start - 1] + 1, 0)
        self.byte_to = self.ends[self.start + self.length + window - 2]


def _texts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[Texts]:
    rows, size = [], 0
    for b in batches:
        for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            raw = t.as_buffer().to_pybytes()
            words = raw.split()
            if len(words) >= window:
                rows.append((i, h, words))
                size += len(raw)
                if size >= HASHED:
                    yield Texts(rows, window)
                    rows, size = [], 0
    if rows:
        yield Texts(rows, window)


def _keyed(docs: DataFrame, id_col: str, text_col: str, others: tuple[str, ...] = ()) -> DataFrame:
    """``_id``; ``i`` and ``h``, which together name a text of an id; ``t``, the text's bytes; ``o0``, ``o1`` ...: ``others``."""
    d = pick(docs, _id=id_col, _text=text_col, **{f"o{k}": c for k, c in enumerate(others)}).withColumn("_text", F.coalesce("_text", F.lit("")))
    if d.schema["_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        number = F.coalesce(F.col("_id").cast("long"), F.lit(NO_ID))
    else:
        number = F.xxhash64(F.col("_id").cast("string"))
    return d.select("_id", number.alias("i"), F.xxhash64("_text").alias("h"), F.col("_text").cast("binary").alias("t"), *[f"o{k}" for k in range(len(others))])


def hot_minimisers(keyed: DataFrame, window: int) -> set[int]:
    """Minimisers of so many different strings that a bucket couldn't hold them; at most HOT_SHARE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        total = 0
        for x in _texts(batches, window):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(x.hashes)])
            content = sums[x.start + x.length + window - 1] - sums[x.start]
            order = np.lexsort((content, x.least))
            least, content = x.least[order], content[order]
            new = np.concatenate([[True], (least[1:] != least[:-1]) | (content[1:] != content[:-1])])
            keys, n = np.unique(least[new], return_counts=True)
            total += int(n.sum())
            often = n >= max(2, n.sum() / HOT_SHARE)
            for k, v in zip(keys[often].tolist(), n[often].tolist()):
                counts[k] = counts.get(k, 0) + v
        keys = np.array([0, *counts], np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([total, *counts.values()], pa.int64()), pa.array([True] + [False] * len(counts))], names=["key", "n", "whole"])

    found = settle(keyed.select("i", "h", "t").mapInArrow(run, "key long, n long, whole boolean").groupBy("key", "whole").agg(F.sum("n").alias("n")), "minimisers", small=True)
    total = found.where("whole").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = found.where(~F.col("whole") & (F.col("n") > max(HOT_LEAST, total / HOT_SHARE))).select("key").collect()
    return {r[0] & 0xFFFFFFFFFFFFFFFF for r in hot}


class Portion:
    """Combines equal strings, and packs what is left by bucket."""

    def __init__(self, window: int, buckets: int, hot: set[int]):
        self.window, self.buckets, self.hot = window, buckets, hot
        self.hot_keys = np.array(sorted(hot), np.uint64)
        self.strings: dict[bytes, list] = {}
        self.spans: list[tuple[int, int, int, int]] = []
        self.size = 0

    def add(self, x: Texts) -> None:
        buf, known = x.buf, self.strings
        hot = np.isin(x.least, self.hot_keys) if len(self.hot_keys) else np.zeros(len(x.least), bool)
        rows = zip(x.byte_from.tolist(), x.byte_to.tolist(), x.least.tolist(), x.doc.tolist(), x.place.tolist(), x.length.tolist(), x.flags.tolist(), hot.tolist())
        for a, b, least, doc, place, length, flags, is_hot in rows:
            s = buf[a:b]
            e = known.get(s)
            i, h, _ = x.rows[doc]
            if e is None:
                known[s] = [least, i, h, place, length, flags, is_hot]
            else:
                self.repeat(e)
                self.spans.append((i, h, place, place + length + self.window - 1))
        self.size += len(buf)

    def repeat(self, e: list) -> None:
        """From now on it is known that the string of entry ``e`` occurs again."""
        if not e[5] & KNOWN:
            e[5] |= KNOWN
            self.spans.append((e[1], e[2], e[3], e[3] + e[4] + self.window - 1))

    def split_hot(self) -> None:
        """Strings of hot minimisers as single windows, combined in their turn."""
        single: dict[bytes, list] = {}
        for s in [s for s, e in self.strings.items() if e[6]]:
            _, i, h, place, length, flags, _ = self.strings.pop(s)
            cuts = _cuts(s)
            for k in range(length):
                w = s[cuts[k] : cuts[k + self.window] - 1]
                e = single.get(w)
                if e is None:
                    single[w] = [xxhash.xxh64_intdigest(w), i, h, place + k, 1, flags & KNOWN, True]
                else:
                    self.repeat(e)
                    if not flags & KNOWN:
                        self.spans.append((i, h, place + k, place + k + self.window))
        self.strings |= single

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.hot:
            self.split_hot()
        if self.strings:
            key = np.array([e[0] for e in self.strings.values()], np.uint64)
            bucket = ((key >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int32)
            entries = np.empty(len(key), ENTRY)
            entries["key"] = key & np.uint64(0xFFFFFFFF)
            for name, k in (("id", 1), ("hash", 2), ("start", 3), ("windows", 4), ("flags", 5)):
                entries[name] = [e[k] for e in self.strings.values()]
            strings = list(self.strings)
            entries["size"] = [len(s) for s in strings]
            yield from self.pack(bucket, entries, lambda rows: b"".join([strings[i] for i in rows.tolist()]))
        if self.spans:
            spans = np.array(self.spans, SPAN)
            bucket = (np.abs(spans["hash"] ^ spans["id"]) % self.buckets).astype(np.int32)
            yield from self.pack(bucket, spans, None)
        self.strings, self.spans, self.size = {}, [], 0

    @staticmethod
    def pack(bucket: np.ndarray, entries: np.ndarray, texts) -> Iterator[pa.RecordBatch]:
        order = np.argsort(bucket, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
        blobs = []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(order)]):
            rows = order[a:b]
            blobs.append(_packed(entries[rows], texts(rows) if texts else b""))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order[begin]]), pa.array(np.full(len(begin), texts is not None)), pa.array(blobs, pa.binary())], names=["bucket", "strings", "blob"])


def _packed(entries: np.ndarray, texts: bytes) -> bytes:
    return struct.pack("<I", len(entries)) + zstandard.ZstdCompressor(level=5).compress(entries.tobytes() + texts)


def _unpack(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    (n,) = struct.unpack_from("<I", blob)
    raw = zstandard.ZstdDecompressor().decompress(blob[4:])
    e = np.frombuffer(raw, ENTRY, n)
    ends = n * ENTRY.itemsize + np.cumsum(e["size"], dtype=np.int64)
    return e, [raw[b - size : b] for b, size in zip(ends.tolist(), e["size"].tolist())]


def _slot(key: np.ndarray) -> np.ndarray:
    return (_mix(key.astype(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)


def _cuts(s: bytes) -> list[int]:
    """Where the words of a packed string begin, and one more, as if another word followed."""
    a = np.flatnonzero(np.frombuffer(s, np.uint8) == 32) + 1
    return [0, *a.tolist(), len(s) + 1]


class Bucket:
    """The strings of one bucket, equal ones combined on arrival; ``out`` are stretches known to repeat so far.

    Beyond ``budget`` bytes what is held goes to a spill file of the task; ``spans``
    then reads it again in passes that hold some of the minimisers each, and for
    minimisers that exceed the budget by themselves some of the windows each.
    """

    def __init__(self, window: int, budget: float = BUCKET_BYTES):
        self.window, self.budget = window, budget
        self.out: list[np.ndarray] = []
        self.spill = None
        self.slot_bytes, self.slot_cut = np.zeros(SLOTS), np.zeros(SLOTS)  # bytes spilled of each slot of minimisers, whole and as windows
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.e = np.empty(64, ENTRY)
        self.size = 0

    def add(self, blob: bytes) -> None:
        e, strings = _unpack(blob)
        self.put(e, strings)
        if self.size > self.budget:
            self.write()

    def put(self, e: np.ndarray, strings: list[bytes]) -> None:
        held = len(self.rows)
        row = np.array([self.rows.setdefault(s, len(self.rows)) for s in strings], np.int64)
        new = np.flatnonzero(np.concatenate([[held - 1], np.maximum.accumulate(np.maximum(row, held - 1))[:-1]]) < row)
        if len(self.rows) > len(self.e):
            self.e = np.concatenate([self.e[:held], np.empty(2 * len(self.rows) - held, ENTRY)])
        self.e[held : len(self.rows)] = e[new]
        self.size += int(e["size"][new].sum()) + HELD * len(new)
        again = np.ones(len(e), bool)
        again[new] = False
        if again.any():
            first = np.unique(row[again])
            first = first[self.e["flags"][first] & KNOWN == 0]
            own = e[again]
            self.out += [self.whole(self.e[first]), self.whole(own[own["flags"] & KNOWN == 0])]
            self.e["flags"][first] |= KNOWN

    def whole(self, e: np.ndarray) -> np.ndarray:
        x = np.empty(len(e), SPAN)
        x["id"], x["hash"], x["begin"], x["end"] = e["id"], e["hash"], e["start"], e["start"] + e["windows"] + np.uint32(self.window - 1)
        return x

    def write(self) -> None:
        """All that is held goes to the spill file, which has no name and ends with the task."""
        self.spill = self.spill or tempfile.TemporaryFile()
        strings, e = list(self.rows), self.e[: len(self.rows)]
        size, n = e["size"].astype(float), e["windows"].astype(float)
        self.slot_bytes += np.bincount(_slot(e["key"]), size + HELD, SLOTS)
        self.slot_cut += np.bincount(_slot(e["key"]), n * (size * self.window / (n + self.window - 1) + HELD), SLOTS)
        for a in range(0, len(e), 1 << 14):
            blob = _packed(e[a : a + (1 << 14)], b"".join(strings[a : a + (1 << 14)]))
            self.spill.write(struct.pack("<Q", len(blob)) + blob)
        self.clear()

    def spilled(self, take: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """What the spill file holds of the slots ``take``."""
        self.spill.seek(0)
        while head := self.spill.read(8):
            e, strings = _unpack(self.spill.read(struct.unpack("<Q", head)[0]))
            own = np.flatnonzero(take[_slot(e["key"])])
            yield e[own], [strings[i] for i in own.tolist()]

    def spans(self) -> Iterator[np.ndarray]:
        if self.spill is None:
            yield from self.out
            self.out = []
            yield self.resolved()
            return
        self.write()
        yield from self.out
        self.out = []
        large = self.slot_bytes > self.budget
        turn = np.cumsum(np.where(large, 0, self.slot_bytes)) // self.budget  # slots of one pass exceed the budget by one slot at most
        for p in np.unique(turn[~large & (self.slot_bytes > 0)]).tolist():
            part = Bucket(self.window, float("inf"))
            for e, strings in self.spilled(~large & (turn == p)):
                part.put(e, strings)
            yield from part.spans()
        for slot in np.flatnonzero(large).tolist():
            passes = int(self.slot_cut[slot] // self.budget) + 1
            for p in range(passes):
                part = Bucket(self.window, float("inf"))
                for e, strings in self.spilled(np.arange(SLOTS) == slot):
                    part.put(*self.windows(e, strings, p, passes))
                    yield from part.out
                    part.out = []
        self.spill.close()

    def windows(self, e: np.ndarray, strings: list[bytes], p: int, passes: int) -> tuple[np.ndarray, list[bytes]]:
        """The strings' windows one by one, as far as they belong to pass ``p``."""
        of, place, cut = [], [], []
        for i, (s, n) in enumerate(zip(strings, e["windows"].tolist())):
            c = _cuts(s)
            for k in range(n):
                w = s[c[k] : c[k + self.window] - 1]
                if xxhash.xxh64_intdigest(w) % passes == p:
                    of.append(i)
                    place.append(k)
                    cut.append(w)
        one = e[of]
        one["start"] += np.array(place, np.uint32)
        one["size"], one["windows"] = [len(w) for w in cut], 1
        return one, cut

    def resolved(self) -> np.ndarray:
        """What windows that several strings share cover, of strings that don't repeat as a whole."""
        e, strings = self.e[: len(self.rows)], list(self.rows)
        order = np.argsort(e["key"], kind="stable")
        key = e["key"][order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        ends = np.append(begin[1:], len(key))
        alone = (ends - begin == 1) & (e["flags"][order[begin]] & REPEATS == 0)
        ids, hashes, starts, windows, flags = (e[k].tolist() for k in ("id", "hash", "start", "windows", "flags"))
        out: list[tuple[int, int, int, int]] = []
        for a, b in zip(begin[~alone].tolist(), ends[~alone].tolist()):
            rows = {strings[r]: r for r in order[a:b].tolist()}
            again = self.counted(rows, windows)
            for s, r in rows.items():
                if not flags[r] & KNOWN:
                    out += [(ids[r], hashes[r], starts[r] + x, starts[r] + y + self.window - 1) for x, y in _stretches(again.get(s, []))]
        return np.array(out, SPAN)

    def counted(self, rows: dict[bytes, int], windows: list[int]) -> dict[bytes, list[int]]:
        """For each string the places of its windows that occur again, found by sorting all windows."""
        cut: list[tuple[bytes, bytes, int]] = []
        for s, r in rows.items():
            c = _cuts(s)
            cut += [(s[c[k] : c[k + self.window] - 1], s, k) for k in range(windows[r])]
        order = sorted(range(len(cut)), key=lambda i: cut[i][0])
        again: dict[bytes, list[int]] = {}
        for a, b in zip(order, order[1:]):
            if cut[a][0] == cut[b][0]:
                for i in (a, b):
                    again.setdefault(cut[i][1], []).append(cut[i][2])
        return {s: sorted(set(v)) for s, v in again.items()}


def _stretches(places: list[int]) -> list[tuple[int, int]]:
    """Ascending numbers as stretches [from, to)."""
    out: list[list[int]] = []
    for p in places:
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [(a, b) for a, b in out]


def repeated_spans(keyed: DataFrame, window: int) -> DataFrame:
    """``i, h, begin, end``: stretches of words that windows which occur again cover."""
    spark = keyed.sparkSession
    buckets = BUCKETS_A_PART * parts(spark)
    hot = hot_minimisers(keyed, window)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portion = Portion(window, buckets, hot)
        for x in _texts(batches, window):
            portion.add(x)
            if portion.size >= PORTION:
                yield from portion.rows()
        yield from portion.rows()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number = Bucket(window), None
        for b in batches:
            for n, strings, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                blob = blob.as_buffer().to_pybytes()
                if n != number:
                    for x in bucket.spans():
                        yield from _span_rows(x)
                    bucket, number = Bucket(window), n
                if strings:
                    bucket.add(blob)
                    if len(bucket.out) >= 64:
                        yield from _span_rows(np.concatenate(bucket.out))
                        bucket.out = []
                else:
                    yield from _span_rows(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), SPAN))
        for x in bucket.spans():
            yield from _span_rows(x)

    sent = keyed.select("i", "h", "t").mapInArrow(split, "bucket int, strings boolean, blob binary")
    sent = sent.repartition(parts(spark), "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(count, "i long, h long, begin int, end int")


def _span_rows(x: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(x):
        yield pa.RecordBatch.from_arrays([pa.array(x["id"]), pa.array(x["hash"]), pa.array(x["begin"].astype(np.int32)), pa.array(x["end"].astype(np.int32))], names=["i", "h", "begin", "end"])


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = (), keep_layout: bool = False) -> DataFrame:
    """``id_col, n_words, n_removed, kept`` and the columns ``others``.

    ``kept`` is what is left of each text, its words joined by one space; with
    ``keep_layout`` a text that loses nothing stays as it is.
    """
    if window < MER:
        raise ValueError(f"a window has {MER} words at least")
    prepare(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col, others)
    spans = repeated_spans(keyed, window).groupBy("i", "h").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    kinds = {c: keyed.schema[c].dataType.simpleString() for c in ["_id", *[f"o{k}" for k in range(len(others))]]}
    carried = ", ".join(f"{c} {kind}" for c, kind in kinds.items())

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = pa.array([zip_.compress(t.as_buffer().to_pybytes()) for t in b.column("t")], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kinds], b.column("i"), b.column("h"), z], names=[*kinds, "i", "h", "z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for z, x, y in zip(b.column("z"), b.column("begins").to_pylist(), b.column("ends").to_pylist()):
                raw = unzip.decompress(z.as_buffer().to_pybytes())
                words = raw.split()
                n = len(words)
                if x:
                    step = np.zeros(n + 1, np.int32)
                    np.add.at(step, x, 1)
                    np.add.at(step, y, -1)
                    stay = np.flatnonzero(np.cumsum(step[:n]) == 0).tolist()
                    words = [words[k] for k in stay]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(raw if keep_layout and n == len(words) else b" ".join(words))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kinds], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*kinds, "n_words", "n_removed", "kept"])

    small = keyed.mapInArrow(shrink, f"{carried}, i long, h long, z binary")
    joined = small.join(spans, ["i", "h"], "left").select(*kinds, "z", F.col("spans.begin").alias("begins"), F.col("spans.end").alias("ends"))
    out = joined.mapInArrow(cut, f"{carried}, n_words long, n_removed long, kept string")
    return out.select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept", *[F.col(f"o{k}").alias(c) for k, c in enumerate(others)])


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, hash(array_to_string(words[i:i + 34], ' ')) AS h, md5(array_to_string(words[i:i + 34], ' ')) AS m FROM d, unnest(range(1, len(words) - 33)) AS t(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h, m) AS n FROM w) WHERE n > 1),
c AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM r, unnest(range(0, 35)) AS t(k) GROUP BY doc_id),
s AS (SELECT d.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed, words, coalesce(gone, []) AS gone FROM d LEFT JOIN c USING (doc_id)),
p AS (SELECT s.doc_id, string_agg(words[i], ' ' ORDER BY i) AS kept FROM s, unnest(range(1, len(words) + 1)) AS t(i) ANTI JOIN (SELECT doc_id AS g, unnest(gone) AS x FROM s) ON g = s.doc_id AND x = i GROUP BY s.doc_id)
SELECT s.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM s LEFT JOIN p USING (doc_id)
"""
