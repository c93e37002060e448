"""WARC records in ZIP packages: a writer, and a reader that never extracts.

Each writing task makes one package: a ZIP of *stored* members with
``archive/data.warc.gz`` (one gzip member per WARC record, so a record can be
read alone) and ``indexes/index.cdxj`` (one JSON line per record with its
offset and length inside that member).  Sizes are always written in ZIP64 form,
so packages past 4 GB differ in nothing.

The reader parses the end record, the ZIP64 locator and directory and the
central directory from the file's tail, finds where the two members' bytes
begin, reads the index, and range-reads records in runs of neighbouring ones.

A payload of at least ``MIN_REVISIT`` bytes is stored once, in the record of the
smallest id; other records with an equal payload are ``revisit`` records that
name it.  Equal payloads are found by SHA-256 and length, by a grouped minimum
(combined before the shuffle) joined back; Spark may split that join where a
payload makes up a large share of all rows.  What is read back is written as a
table, and each revisit record gets its payload, digest and length from the response
it names, by a join of the records read; one that leads to none is an error.

Files go to the shared folder through ``pyarrow.fs``.  A file's name has the
task attempt in it, and only files named by a finished attempt are read, so
a lost or repeated task leaves at most an unread file.

Defined results: a null payload counts as empty.  A null id is kept as null and
is never one that others refer to.  Rows that repeat an id and payload are a
response each and a revisit of none (they share the smallest id).  An id that
repeats with other payloads is a record each; a revisit's digest says which of
them it means.  An empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import new_path, parts, pick, prepare, settle

MIN_REVISIT = 100
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
WARC_DATE = "2000-01-01T00:00:00Z"  # records must have a date; ours carry no crawl time
READ_AHEAD = 4 << 20


def record(kind: str, uri: str, page_id, payload: bytes, size: int, digest: str, refers_to=None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload."""
    name = "" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {uri}')}>", f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {uri}", f"X-Page-ID: {name}", f"X-Payload-Length: {size}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record doesn't end where its length says")
    return fields, rest[:n]


class PackageWriter:
    """A ZIP package written in one pass to a stream that can't seek."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, key: dict, raw: bytes) -> None:
        z = gzip.compress(raw, 1, mtime=0)
        self.data.write(z)
        self.lines.append(json.dumps(key | {"offset": self.at, "length": len(z)}))
        self.at += len(z)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write("\n".join(self.lines).encode())
        self.zip.close()


class PackageReader:
    """Stored members of a ZIP file by range reads; ``f`` has ``seek`` and ``read``."""

    def __init__(self, f, size: int):
        self.f = f
        self.members: dict[str, tuple[int, int]] = {}
        tail_at = max(0, size - 65_557)  # the end record with the longest comment
        tail = self.take(tail_at, size - tail_at)
        k = tail.rfind(b"PK\x05\x06")
        while k >= 0 and (len(tail) < k + 22 or struct.unpack_from("<H", tail, k + 20)[0] != len(tail) - k - 22):
            k = tail.rfind(b"PK\x05\x06", 0, k)
        if k < 0:
            raise ValueError("not a ZIP file: no end of central directory")
        count, length, begin = struct.unpack_from("<HII", tail, k + 10)
        locator = self.take(tail_at + k - 20, 20) if tail_at + k >= 20 else b""
        if locator[:4] == b"PK\x06\x07":
            (end64,) = struct.unpack_from("<Q", locator, 8)
            big = self.take(end64, 56)
            if big[:4] != b"PK\x06\x06":
                raise ValueError("a ZIP64 locator points to no ZIP64 end record")
            count, length, begin = struct.unpack_from("<QQQ", big, 32)
        elif 0xFFFFFFFF in (length, begin) or count == 0xFFFF:
            raise ValueError("a ZIP64 directory is needed but missing")
        directory, at = self.take(begin, length), 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
            (header,) = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            packed, plain, header = self.wide(directory[at + 46 + n_name : at + 46 + n_name + n_extra], packed, plain, header)
            at += 46 + n_name + n_extra + n_comment
            if method == 0 and not flags & 1:  # stored and not encrypted: bytes can be read in place
                local = self.take(header, 30)
                if local[:4] != b"PK\x03\x04":
                    raise ValueError(f"no local header for {name}")
                self.members[name] = (header + 30 + sum(struct.unpack_from("<HH", local, 26)), plain)

    @staticmethod
    def wide(extra: bytes, packed: int, plain: int, header: int) -> tuple[int, int, int]:
        """Sizes and offset with what the ZIP64 field has for those that are all ones."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                values = [v for (v,) in struct.iter_unpack("<Q", extra[at + 4 : at + 4 + n // 8 * 8])]
                if plain == 0xFFFFFFFF:
                    plain = values.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = values.pop(0)
                if header == 0xFFFFFFFF:
                    header = values.pop(0)
            at += 4 + n
        return packed, plain, header

    def take(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        raw = self.f.read(n)
        if len(raw) != n:
            raise ValueError("the file ends early")
        return raw

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        begin, size = self.members[name]
        length = size - offset if length is None else length
        if offset < 0 or offset + length > size:
            raise ValueError(f"a range outside {name}")
        return self.take(begin + offset, length)

    def records(self) -> Iterator[tuple[dict, dict[str, str], bytes]]:
        """(index entry, WARC fields, payload); neighbouring records share a range read of about READ_AHEAD bytes."""
        index = [json.loads(x) for x in self.read(INDEX).decode().split("\n") if x]
        k = 0
        while k < len(index):
            end, stop = k + 1, index[k]["offset"] + index[k]["length"]
            while end < len(index) and index[end]["offset"] == stop and stop + index[end]["length"] - index[k]["offset"] <= READ_AHEAD:
                stop += index[end]["length"]
                end += 1
            raw = self.read(DATA, index[k]["offset"], stop - index[k]["offset"])
            for x in index[k:end]:
                at = x["offset"] - index[k]["offset"]
                yield x, *parse_record(zlib.decompress(raw[at : at + x["length"]], 31))
            k = end


def file_system(uri: str):
    """File system and path of a folder; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """``id, url, payload, digest, first``: ``first`` is the response's id where the row is to be a revisit."""
    p = pick(pages, id=id_col, url=url_col, payload=payload_col)
    p = p.select("id", "url", F.coalesce("payload", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    large = F.length("payload") >= MIN_REVISIT
    # combined before the shuffle; only payloads that occur again are joined back
    firsts = p.where(large).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    firsts = settle(firsts, "payloads")  # written, so that the join is a plain one, which Spark can split at a payload that very many rows have
    return p.join(firsts, "digest", "left").withColumn("first", F.when(F.coalesce(F.col("id") != F.col("first"), F.lit(True)), F.col("first")))


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one package per partition; a table of the finished files: ``path, size``."""
    prepare(pages.sparkSession)
    rows = with_revisits(pages, id_col, url_col, payload_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = out = path = None
        for b in batches:
            for page_id, url, payload, digest, first in zip(b["id"], b["url"], b["payload"], b["digest"], b["first"]):
                if writer is None:
                    fs, root = file_system(folder)
                    task = TaskContext.get()
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/pages-{task.partitionId():06d}-{task.taskAttemptId()}.wacz"
                    out = fs.open_output_stream(path)
                    writer = PackageWriter(_Unseekable(out))
                page_id = None if page_id is None or page_id != page_id else int(page_id)
                revisit = first is not None and first == first
                uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                payload = bytes(payload)
                raw = record("revisit" if revisit else "response", uri, page_id, b"" if revisit else payload, len(payload), digest, int(first) if revisit else None)
                writer.add({"page_id": page_id, "url": uri, "digest": digest}, raw)
        if writer is not None:
            writer.close()
            out.close()
            yield pd.DataFrame({"path": [path], "size": [fs.get_file_info(path).size]})

    # as few columns as the records need, in a type that keeps null ids apart from numbers
    rows = rows.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.col("first").cast("string").alias("first"))
    return rows.mapInPandas(run, "path string, size long")


class _Unseekable(io.RawIOBase):
    """A stream as ``zipfile`` wants it; it then marks sizes after the data."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, b) -> int:
        self.stream.write(bytes(b))
        return len(b)

    def flush(self) -> None:
        pass


def read_packages(files: DataFrame, folder: str) -> DataFrame:
    """One row per record of the packages in ``files``: ``page_id, url, record_type, refers_to, payload_digest, payload_bytes`` and ``payload``.

    Digest and length of a response are those of the payload read; a record
    whose header says otherwise is an error.  A revisit has what its header says
    until :func:`resolve_revisits` finds its payload.
    """
    prepare(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = file_system(folder)
        for b in batches:
            for path, size in zip(b["path"], b["size"]):
                with fs.open_input_file(path) as f:
                    rows, held = [], 0
                    for entry, fields, payload in PackageReader(f, int(size)).records():
                        revisit = fields["WARC-Type"] == "revisit"
                        digest, n = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                        if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != n or entry["digest"] != digest):
                            raise ValueError(f"{path}: the payload of page {entry['page_id']} isn't what its record says")
                        rows.append((fields["X-Page-ID"] or None, fields["WARC-Target-URI"], fields["WARC-Type"], fields.get("X-Refers-To-Page-ID"), digest, n, None if revisit else payload))
                        held += len(payload)
                        if held >= 8 << 20 or len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=columns)

    columns = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    files = files.repartition(parts(files.sparkSession), "path")  # a few names; each task opens its own packages
    out = files.mapInPandas(run, "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary")
    return out.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with payload, digest and length of revisits taken from the responses they name.

    Only responses that are named cross the shuffle, once each.  ``records`` should be a written table:
    then Spark can split the join at a response that very many records name.
    """
    named = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("named"), F.col("payload_digest").alias("wanted")).distinct()
    there = records.where(f"record_type = 'response' and payload_bytes >= {MIN_REVISIT}").select(F.col("page_id").alias("named"), F.col("payload_digest").alias("wanted"), F.col("payload_bytes").alias("found"), F.col("payload").alias("body"))
    there = there.join(named, ["named", "wanted"], "left_semi").dropDuplicates(["named", "wanted"])
    revisit = F.col("record_type") == "revisit"
    d = records.withColumns({"named": F.col("refers_to"), "wanted": F.when(revisit, F.col("payload_digest"))}).join(there, ["named", "wanted"], "left")
    lost = F.concat(F.lit("the revisit record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("(none)")), F.lit(" leads to no response with its payload"))
    n = F.when(~revisit, F.col("payload_bytes")).otherwise(F.when(F.col("found") == F.col("payload_bytes"), F.col("found")).otherwise(F.raise_error(lost).cast("long")))
    return d.select("page_id", "url", "record_type", "refers_to", "payload_digest", n.alias("payload_bytes"), F.when(revisit, F.col("body")).otherwise(F.col("payload")).alias("payload"))


def round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the packages, then read every record of them back, with its payload."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "packages")
    files = settle(write_packages(pages, folder, id_col, url_col, payload_col), "manifest")
    return resolve_revisits(settle(read_packages(files, folder), "records"))


def op4_warc_zip(spark, sf_dir: str) -> DataFrame:
    records = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""
