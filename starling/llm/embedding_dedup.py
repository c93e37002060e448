"""Near-duplicate embeddings by a subspace pigeonhole join.

For vectors of length one, cosine >= t means squared distance <= 2 - 2t.  A
fixed orthogonal rotation spreads the vectors' energy, and the rotated vectors
are split into blocks of ``BLOCK`` dimensions.  If the whole squared distance
keeps within its budget, at least one block keeps within its share of it (shares
go by dimensions).  So pairs within the share of some block are candidates, and
no others.  In each block a range join finds them: values of the block's first
coordinate fall into strips as wide as the share's root, so partners lie in the
same or the next strip; within these, sorted by that coordinate, only the range
that can match is compared.  Each candidate is verified by its cosine in double
precision, from the vectors as given.  A pair counts in the first block whose
share it keeps, so nothing has to be removed afterwards.

Equal vectors are one vector with a count from the start.  There are at most
``2 / width + 1`` strips in a block however many vectors there are; strips of more
than ``CHUNK`` vectors are dealt into chunks, which are written once to the shared
folder (so a vector crosses the shuffle once for each block).  Each pair of chunks of
the same or of neighbouring strips is a row of a table of its own, and the task that
gets it reads both chunks by range; so a strip with a third of all rows is many tasks of
a bounded size.  A task returns sums of links and a star forest of them, never the pairs.

The comparisons grow with the square of what shares a strip; in directions
without structure that is most of the vectors, for any exact join of this kind.

Defined results: vectors that are null, of length zero, or hold null or
non-finite components link with nothing; so do vectors of different dimensions,
and rows with a null id.  Each row counts the other rows that its own vector links
with, so rows that repeat an id with different vectors can have different counts;
what one of them reaches, all do: they share their component.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import new_path, parts, pick, prepare, settle
from starling.llm.components import components, roots
from starling.llm.warc_zip import file_system

BLOCK, CHUNK, ROWS, PAIRS = 16, 16384, 512, 1 << 16
SLACK = 1e-9  # on shares, for rounding in the rotation; far below what it lets in


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int) -> list[slice]:
    n = max(1, -(-dim // BLOCK))
    edges = np.linspace(0, dim, n + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def shares(dim: int, cosine: float) -> np.ndarray:
    return np.array([(2 - 2 * cosine) * (b.stop - b.start) / dim for b in blocks(dim)]) + SLACK


def rotated(v: np.ndarray) -> np.ndarray:
    scale = np.abs(v).max(1, keepdims=True)
    u = v / scale
    return (u / np.linalg.norm(u, axis=1, keepdims=True)) @ rotation(v.shape[1])


def strips(y: np.ndarray, cosine: float) -> np.ndarray:
    """The strip of each vector in each block."""
    width = np.sqrt(shares(y.shape[1], cosine)) * (1 + 1e-6)
    return np.floor((y[:, [b.start for b in blocks(y.shape[1])]] + 1) / width).astype(np.int64)


class Task:
    """One chunk against itself (``right`` empty) or against another, in one block."""

    def __init__(self, block: int, cosine: float, v: np.ndarray, ids: np.ndarray, weight: np.ndarray, side: np.ndarray):
        self.block, self.cosine, self.v, self.ids, self.weight = block, cosine, v.astype(np.float64), ids, weight
        self.y = rotated(self.v)
        self.norm = self.v / np.abs(self.v).max(1, keepdims=True)
        self.norm = self.norm / np.linalg.norm(self.norm, axis=1, keepdims=True)
        self.share = shares(v.shape[1], cosine)
        self.slices = blocks(v.shape[1])
        self.left, self.right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        self.links = np.zeros(len(ids), np.int64)
        self.label = np.arange(len(ids))

    def run(self) -> None:
        s, share = self.slices[self.block], self.share[self.block]
        x = self.y[:, s.start]
        inner = len(self.right) == 0
        left = self.left[np.argsort(x[self.left], kind="stable")]
        right = left if inner else self.right[np.argsort(x[self.right], kind="stable")]
        if not len(left) or not len(right):
            return
        z = self.y[:, s].astype(np.float32)
        size = (z * z).sum(1)
        reach = np.sqrt(share) * (1 + 1e-6)
        for k in range(0, len(left), ROWS):
            a = left[k : k + ROWS]
            lo, hi = np.searchsorted(x[right], [x[a[0]] - reach, x[a[-1]] + reach])
            lo = max(lo, k) if inner else lo
            for m in range(lo, hi, 8 * ROWS):
                b = right[m : min(m + 8 * ROWS, hi)]
                near = size[a][:, None] + size[b] - 2 * (z[a] @ z[b].T) <= share + 1e-4  # single precision, with room
                i, j = np.nonzero(near)
                if inner:
                    keep = i + k < j + m
                    i, j = i[keep], j[keep]
                for p in range(0, len(i), PAIRS):
                    self.verify(a[i[p : p + PAIRS]], b[j[p : p + PAIRS]])

    def verify(self, a: np.ndarray, b: np.ndarray) -> None:
        d = (self.y[a] - self.y[b]) ** 2
        within = np.array([d[:, s].sum(1) for s in self.slices[: self.block + 1]]) <= self.share[: self.block + 1, None]
        first = within[-1] & ~within[:-1].any(0)
        a, b = a[first], b[first]
        linked = np.einsum("ij,ij->i", self.norm[a], self.norm[b]) >= self.cosine
        a, b = a[linked], b[linked]
        self.links += np.bincount(a, self.weight[b], len(self.ids)).astype(np.int64) + np.bincount(b, self.weight[a], len(self.ids)).astype(np.int64)
        la, lb = self.label[a], self.label[b]
        apart = la != lb
        if apart.any():
            self.label = roots(len(self.ids), la[apart], lb[apart])[self.label]


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_dim(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, rows and vectors of a batch, for each dimension that occurs."""
    sizes = b.column(at).value_lengths().to_numpy()
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, _matrix(b.column(at).take(pa.array(rows)), dim)


def _entry(dim: int) -> np.dtype:
    """A vector as it is kept in a chunk's file."""
    return np.dtype([("g", "<i8"), ("n", "<i8"), ("v", "<f8", (dim,))])


def write_chunks(groups: DataFrame, cosine: float, folder: str) -> DataFrame:
    """A file for each chunk of each strip of each block, and a table of them: ``dim, block, strip, chunk, path, at, n``.

    A vector crosses the shuffle once for each block.  A strip is split by a hash into as many keys as
    it needs for chunks of about CHUNK vectors; its size comes from a count of all strips.
    """
    spark = groups.sparkSession

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, rows, v in _by_dim(b, 0):
                s = strips(rotated(v.astype(np.float64)), cosine)
                m, nb = s.shape
                part = b.take(pa.array(np.tile(rows, nb)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m * nb, dim, np.int32)), pa.array(np.repeat(np.arange(nb, dtype=np.int32), m)), pa.array(s.T.reshape(-1)), part.column(1)], names=["dim", "block", "strip", "g"])

    where = groups.select("v", "g").mapInArrow(place, "dim int, block int, strip long, g long")
    sizes = settle(where.groupBy("dim", "block", "strip").agg(F.count("*").alias("m")), "strips", small=True)  # at most (blocks x strips) rows for each dimension
    many = F.ceil(F.col("m") / CHUNK)
    dealt = where.join(F.broadcast(sizes), ["dim", "block", "strip"]).select("dim", "block", "strip", F.pmod(F.xxhash64("g"), many).cast("int").alias("chunk"), "g")
    rows = dealt.join(groups.select("g", "n", "v"), "g").select("dim", "block", "strip", "chunk", "g", "n", "v")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path, out, at = f"chunks-{task.partitionId():06d}-{task.taskAttemptId()}", None, 0
        done, last, begin, held = [], None, 0, 0
        for b in batches:
            if out is None:
                fs, root = file_system(folder)
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{path}")
            keys = list(zip(*(c.to_pylist() for c in b.columns[:4])))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if keys[x] != last:
                    if last is not None:
                        done.append((*last, path, begin, held))
                    last, begin, held = keys[x], at, 0
                e = np.empty(y - x, _entry(last[0]))
                e["g"], e["n"], e["v"] = b.column(4).slice(x, y - x).to_numpy(), b.column(5).slice(x, y - x).to_numpy(), _matrix(b.column(6).slice(x, y - x), last[0])
                out.write(e.tobytes())
                at, held = at + e.nbytes, held + len(e)
        if last is not None:
            done.append((*last, path, begin, held))
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["dim", "block", "strip", "chunk", "path", "at", "n"])

    sorted_ = rows.repartition("dim", "block", "strip", "chunk").sortWithinPartitions("dim", "block", "strip", "chunk", "g")
    return settle(sorted_.mapInArrow(write, "dim int, block int, strip long, chunk int, path string, at long, n long"), "chunks", small=True)


def chunk_links(chunks: DataFrame, cosine: float, folder: str) -> DataFrame:
    """``g, links, root`` of the vectors that link in some pair of chunks: each a task's row, which reads both chunks by range."""
    spark = chunks.sparkSession
    other = chunks.select("dim", "block", F.col("strip").alias("strip_b"), F.col("chunk").alias("chunk_b"), F.col("path").alias("path_b"), F.col("at").alias("at_b"), F.col("n").alias("n_b"))
    same = chunks.join(other.withColumn("strip", F.col("strip_b")), ["dim", "block", "strip"]).where("chunk <= chunk_b")
    following = chunks.join(other.withColumn("strip", F.col("strip_b") - 1), ["dim", "block", "strip"])
    columns = ["dim", "block", "path", "at", "n", "path_b", "at_b", "n_b", ((F.col("strip") == F.col("strip_b")) & (F.col("chunk") == F.col("chunk_b"))).alias("own")]
    pairs = same.select(*columns).union(following.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)

        def read(dim: int, path: str, at: int, n: int) -> np.ndarray:
            with fs.open_input_file(f"{root}/{path}") as f:
                f.seek(at)
                return np.frombuffer(f.read(n * _entry(dim).itemsize), _entry(dim))

        for b in batches:
            for dim, block, path, at, n, path_b, at_b, n_b, own in zip(*(c.to_pylist() for c in b.columns)):
                e = read(dim, path, at, n)
                e = e if own else np.concatenate([e, read(dim, path_b, at_b, n_b)])
                side = (np.arange(len(e)) >= n).astype(np.int8)
                job = Task(block, cosine, e["v"], e["g"], e["n"], side)
                job.run()
                found = np.flatnonzero((job.links > 0) | (job.label != np.arange(len(e))))
                yield pa.RecordBatch.from_arrays([pa.array(e["g"][found]), pa.array(job.links[found]), pa.array(e["g"][job.label[found]])], names=["g", "links", "root"])

    # the pairs, a few numbers each, are dealt evenly
    return pairs.repartition(max(parts(spark), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "g long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, n_links, component_id, kept`` of each row."""
    spark = vectors.sparkSession
    prepare(spark)
    base = pick(vectors, id=id_col, v=vector_col)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    base = base.withColumn("valid", F.coalesce(F.col("id").isNotNull() & finite, F.lit(False))).withColumn("h", F.xxhash64("v"))
    valid = base.where("valid").select("id", "h", F.col("v").cast("array<double>").alias("v"))
    # one vector for all equal ones, counted before the shuffle; its number is what stands in the written table
    groups = valid.groupBy("v").agg(F.min("id").alias("rep"), F.first("h").alias("h"), F.count("*").alias("n"))
    groups = settle(groups.withColumn("g", F.monotonically_increasing_id()), "vectors")
    folder = new_path(spark, "starling-chunk-files")
    found = settle(chunk_links(write_chunks(groups, cosine, folder), cosine, folder), "vector-links", small=True)
    # which vector a row has: of a vector of its own by id and hash, of an equal one by the vector
    shared = valid.join(groups.where("n > 1").select("v", "g"), "v").select("id", "h", "g")
    places = settle(groups.where("n = 1").select(F.col("rep").alias("id"), "h", "g").union(shared).distinct(), "places")
    again = places.groupBy("id").agg(F.min("g").alias("a"), F.max("g").alias("z")).where("a < z").select("id", "a")  # ids with several vectors
    same_id = places.join(again, "id").select("a", F.col("g").alias("b"))
    label = components(found.select(F.col("g").alias("a"), F.col("root").alias("b")).union(same_id))
    named = label.join(groups.select(F.col("g").alias("node"), "rep"), "node")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select(F.col("node").alias("g"), "component_id")
    sums = found.groupBy("g").agg(F.sum("links").alias("links"))
    # written, so that the join below is a plain one, which Spark can split at a vector that very many rows have
    known = settle(places.join(groups.select("g", "rep", "n"), "g").join(named, "g", "left").join(sums, "g", "left").select("id", "h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component_id", "rep").alias("component_id")), "linked")
    out = base.select("id", "valid", F.when(F.col("valid"), F.col("h")).alias("h")).join(known, ["id", "h"], "left")
    out = out.select("id", F.when(F.col("valid"), F.col("links")).otherwise(0).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
