"""SentencePiece encoding and decoding of merge-type (BPE) models by a prefix table.

The merges of a text have one property that makes a table possible: the
encoding of a text's prefix ends in exactly one token, and a token may follow
another just when the pair, encoded alone, stays that pair.  So for each prefix
the table stores its last token: of the tokens that an Aho-Corasick automaton
finds ending there, the one whose own start is the text's start or that is
compatible with the last token stored for the shorter prefix.  Ids are then
recovered from the end backwards.  One pass, no merge queue.

Two exact shortcuts keep Python out of the inner loop.  No token spans two
neighbouring characters that are neighbours in no token, so a text falls into
parts at such places that are encoded one by one; and parts are remembered in a
bounded memory (``memory`` entries, then it starts anew), as are pair tests.
Both are per worker and hold nothing that grows with the input.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to the empty string.  Every row gives one row; repeated rows give equal
rows.  Whole texts are encoded, whatever their length.  A model that changes texts
first, or is not of the merge type with byte pieces, is an error.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import pick, prepare

SPACE = "▁"
MEMORY = 500_000
BATCH_CHARS = 4_000_000

#: Field numbers of the model file format, and the values that the coder relies on (fixed values).
MODEL_TYPE, SPACE_LAST, BYTE_FALLBACK = 3, 24, 35  # of the trainer's part
CHARS_MAP, ADD_SPACE, TRIM_SPACES, ESCAPE_SPACES = 2, 3, 4, 5  # of the normalizer's part
PIECE_TYPE = 3  # of a piece
MERGES = 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


def refuse_other_models(model: bytes) -> None:
    """ValueError if a model is one for which the prefix table would give other ids than the library."""
    parts: dict[int, dict] = {2: {}, 3: {}, 5: {}}  # trainer, normalizer, denormalizer; later settings replace earlier ones
    kinds = set()
    for number, value in _fields(model):
        if number == 1:
            kinds.add(dict(_fields(value)).get(PIECE_TYPE, NORMAL))
        elif number in parts:
            parts[number].update(_fields(value))
    trainer, normal, back = parts[2], parts[3], parts[5]
    wrong = [
        ("not of the merge type", trainer.get(MODEL_TYPE, 1) != MERGES),
        ("spaces end words", trainer.get(SPACE_LAST, 0)),
        ("no byte pieces", not trainer.get(BYTE_FALLBACK, 0)),
        ("texts are rewritten", normal.get(CHARS_MAP) or back.get(CHARS_MAP)),
        ("no leading space is added", not normal.get(ADD_SPACE, 1)),
        ("spaces are trimmed", normal.get(TRIM_SPACES, 1)),
        ("spaces are not escaped", not normal.get(ESCAPE_SPACES, 1)),
        ("user-defined or unused pieces", kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}),
    ]
    if found := [what for what, bad in wrong if bad]:
        raise ValueError(f"this model can't be encoded by the prefix table: {', '.join(found)}")


class PieceModel:
    """A model file's pieces, and the prefix-table coder over them."""

    def __init__(self, path: str, memory: int = MEMORY):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        refuse_other_models(sp.serialized_model_proto())
        self.memory, self.parts, self.odd, self.tested = memory, {}, set(), 0
        self.pieces: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.text: list[bytes] = []  # what an id decodes to, before runs of bytes are joined
        self.bytes = [sp.unk_id()] * 256
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.text.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i):
                self.text.append(b"")
            elif sp.is_unknown(i):
                self.text.append(" ⁇ ".encode())
            else:
                self.pieces[p] = i
                self.score[p] = sp.get_score(i)
                self.text.append(p.replace(SPACE, " ").encode())
        self.names = {i: p for p, i in self.pieces.items()}
        self.neighbours = {a + b for p in self.pieces for a, b in zip(p, p[1:])}
        self.spaced = not any(x[1] == SPACE and x[0] != SPACE for x in self.neighbours)
        self.lined = not any("\n" in x for x in self.neighbours)
        self.follow: dict[int, dict[int, bool]] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.pieces.items():
            if len(p) == 1 or self.merged(p) == [p]:  # a token that merges never reach ends no prefix
                self.automaton.add_word(p, (i, len(p)))
                self.follow[i] = {}
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The merges carried out one by one: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether b may follow a: the pair encoded alone stays that pair.  Kept in ``follow[a]``."""
        if self.tested >= 4 * self.memory:
            for d in self.follow.values():
                d.clear()
            self.tested = 0
        x, y = self.names[a], self.names[b]
        known = self.follow[a][b] = self.merged(x + y) == [x, y]
        self.tested += 1
        return known

    def encode_run(self, run: str) -> list[int] | None:
        """Ids by the prefix table; None if some character is no token by itself."""
        n = len(run)
        last, sizes, after = [-1] * (n + 1), [0] * (n + 1), [None] * (n + 1)
        follow = self.follow
        for end, (i, size) in self.automaton.iter(run):  # the longest first at each end
            end += 1
            if last[end] >= 0:  # only one token can end a prefix
                continue
            start = end - size
            if start:
                d = after[start]
                if d is None:
                    continue
                known = d.get(i)
                if known is None:
                    known = self.compatible(last[start], i)
                if not known:
                    continue
            last[end], sizes[end], after[end] = i, size, follow[i]
        ids, at = [], n
        while at:
            if last[at] < 0:
                return None
            ids.append(last[at])
            at -= sizes[at]
        return ids[::-1]

    def encode_part(self, part: str) -> list[int]:
        ids = self.encode_run(part)
        if ids is not None:
            return ids
        ids, begin = [], 0  # again between the places that no token spans, where unknown characters stand alone
        for k in range(1, len(part) + 1):
            if k == len(part) or part[k - 1 : k + 1] not in self.neighbours:
                run = part[begin:k]
                got = self.encode_run(run)
                if got is None:
                    got = [x for p in self.merged(run) for x in ([self.pieces[p]] if p in self.pieces else [self.bytes[c] for c in p.encode()])]
                ids += got
                begin = k
        return ids

    def part(self, part: str) -> bytes:
        """Ids of a part as packed int32, remembered; ``odd`` has the parts whose ids decode to another text."""
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) >= self.memory:
                self.parts.clear()
                self.odd.clear()
            ids = self.encode_part(part)
            if self.join(ids) != part.replace(SPACE, " ").encode():
                self.odd.add(part)
            got = self.parts[part] = array("i", ids).tobytes()
        return got

    def join(self, ids) -> bytes:
        return b"".join([self.text[i] for i in ids])

    def split(self, text: str) -> list[str]:
        """Parts of a text, the leading space that the model adds included."""
        if not text:
            return []
        full = SPACE + text.replace(" ", SPACE)
        if not self.spaced:
            return [full]
        if not self.lined or "\n" not in text:
            return re.findall(_PART, full)
        return re.findall(_LINED, full)

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Packed int32 ids and decoded UTF-8 of a whole text."""
        get, part = self.parts.get, self.part
        parts = self.split(text)
        packed = b"".join([get(p) or part(p) for p in parts])
        if self.odd and not self.odd.isdisjoint(parts):
            return packed, self.decode(np.frombuffer(packed, np.int32).tolist()).encode()
        return packed, text.replace(SPACE, " ").encode()  # each part's ids were seen to decode to it

    def decode(self, ids) -> str:
        first = next((x for x in (self.names.get(i, self.text[i]) for i in ids) if x), "")
        return self.finish(self.join(ids), first[:1] == SPACE).decode()

    @staticmethod
    def finish(joined: bytes, spaced: bool = True) -> bytes:
        """Without the added space; bytes that are no UTF-8 become replacement characters, one each."""
        if spaced and joined[:1] == b" ":
            joined = joined[1:]
        try:
            joined.decode()
        except UnicodeDecodeError:
            joined = _bytewise(joined).encode()
        return joined


def _bytewise(raw: bytes) -> str:
    out, k = [], 0
    while k < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[k : k + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("�")
        k += n
    return "".join(out)


_PART = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_LINED = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int) and ``decoded`` (string) of each row."""
    prepare(docs.sparkSession)
    d = pick(docs, _id=id_col, _text=text_col).withColumn("_text", F.coalesce("_text", F.lit("")))
    kind = d.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(model_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            begin = 0
            while begin < len(texts):
                ids, decoded, chars, end = [], [], 0, begin
                while end < len(texts) and (end == begin or chars < BATCH_CHARS):
                    i, s = coder.encode(texts[end])
                    ids.append(i)
                    decoded.append(s)
                    chars += len(texts[end])
                    end += 1
                ends = np.cumsum([0, *[len(i) // 4 for i in ids]], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(decoded, pa.binary()).cast(pa.string())], names=["_id", "ids", "decoded"])
                begin = end

    return d.mapInArrow(run, f"_id {kind}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)


def op8_piece_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("piece_bpe_32k.model")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
