"""The training-data operators against SQL, libraries and brute force, and on odd input."""

import hashlib
import io
import os
import random
import zipfile
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import zstandard

from starling.llm import components, embedding_dedup, entry_queries, language_id, minhash_forest, packing, piece_bpe, quality_classifier, quality_rules, substring_dedup, url_filters, warc_zip

SF = "/root/testdata/sf0.001"
PIECES = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
BYTES = __import__("public_tokenizers").path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", sorted(entry_queries.oracle_sql()))
def test_query_equals_sql(spark, same_as_sql, name):
    same_as_sql(entry_queries.queries()[name](spark, SF), entry_queries.oracle_sql()[name])


# --- 1 substring dedup


def kept_by_hand(rows, window):
    count, texts = Counter(), [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in texts:
        count.update(b" ".join(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[b" ".join(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [500, 1])
def test_substrings_by_hand(spark, odd_docs, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", hot)
    r = random.Random(hot)
    passage = [f"p{k}" for k in range(12)]
    made = [(k, " ".join(r.choice(["a", "b", "c"]) for _ in range(r.randint(0, 40)))) for k in range(60)]
    made += [(100 + k, " ".join([f"u{k}_{j}" for j in range(5)] + passage + [f"v{k}_{j}" for j in range(5)])) for k in range(40)]
    for docs, window in ((spark.createDataFrame(made, "doc_id long, text string"), 8), (odd_docs, 35)):
        got = sorted((tuple(x) for x in substring_dedup.remove_repeats(docs, window).collect()), key=repr)
        assert got == kept_by_hand(_rows(docs), window)


def _rows(docs):
    """(id, text) by position."""
    return [(r[0], r[1]) for r in docs.collect()]


def _blobs(texts: list[str], window: int, portion: int) -> list[bytes]:
    """The strings of one bucket as ``portion`` texts each send them."""
    out = []
    for k in range(0, len(texts), portion):
        p = substring_dedup.Portion(window, 1, set())
        p.add(substring_dedup.Texts([(k + i, 0, t.encode().split()) for i, t in enumerate(texts[k : k + portion])], window))
        for b in p.rows():
            out += [(strings, blob) for strings, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
    return out


def _covered(blobs: list, window: int, budget: float) -> set[tuple[int, int]]:
    """Words (document, place) that what repeats covers."""
    bucket, spans = substring_dedup.Bucket(window, budget), []
    for strings, blob in blobs:
        if strings:
            bucket.add(blob)
        else:
            spans.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), substring_dedup.SPAN))
    spans += list(bucket.spans())
    return {(i, w) for x in spans for i, a, b in zip(x["id"].tolist(), x["begin"].tolist(), x["end"].tolist()) for w in range(a, b)}


@pytest.mark.parametrize("words", [3, 40, 2000])  # few words: one minimiser has nearly all strings
def test_buckets_beyond_their_memory_give_the_same(words):
    rng, window = np.random.default_rng(words), 6
    texts = [" ".join(f"w{x}" for x in rng.integers(0, words, 60)) for _ in range(40)]
    texts += [texts[0], " ".join(texts[1].split()[10:30] + texts[2].split()[5:40]), " ".join(["same"] * 80)]
    where = {}
    for i, t in enumerate(texts):
        t = t.split()
        for k in range(len(t) - window + 1):
            where.setdefault(tuple(t[k : k + window]), []).append((i, k))
    want = {(i, k + j) for places in where.values() if len(places) > 1 for i, k in places for j in range(window)}
    blobs = _blobs(texts, window, 5)
    for budget in (float("inf"), 20000, 3000, 300):
        assert _covered(blobs, window, budget) == want, budget


def test_a_bucket_holds_a_passage_once():
    passage = " ".join(f"w{k}" for k in range(50))
    blobs = _blobs([passage] * 300, 35, 1)
    bucket = substring_dedup.Bucket(35)
    for _, blob in blobs:
        bucket.add(blob)
    assert len(bucket.rows) == len(substring_dedup._unpack(blobs[0][1])[1])
    assert _covered(blobs, 35, float("inf")) == {(i, w) for i in range(300) for w in range(50)}


def test_substrings_carry_columns_and_layout(odd_docs, no_docs):
    out = substring_dedup.remove_repeats(odd_docs, others=("lang", "n_chars"), keep_layout=True)
    assert {r.doc_id: r.kept for r in out.collect()}[4] == " \n\t " and out.columns[-2:] == ["lang", "n_chars"]
    assert substring_dedup.remove_repeats(no_docs).count() == 0


# --- 2 language


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang_pred"] == out["lang"]).mean() > 0.98 and out["score"].between(0, 1).all()


def test_languages_on_odd_input(odd_docs, no_docs):
    model = language_id.train(odd_docs)
    rows = language_id.predict_languages(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[0].lang_pred == by_id[1].lang_pred == by_id[7].lang_pred == "und" and by_id[0].score == 0
    assert {r.lang_pred for r in rows} <= {"en", "de", "xx", "und"}  # the only French text has no letter
    assert language_id.train(no_docs) is None
    assert {r.lang_pred for r in language_id.predict_languages(odd_docs, None).collect()} == {"und"}
    assert language_id.predict_languages(no_docs, model).count() == 0


def test_hierarchy_covers_families_and_pairs():
    r = np.random.default_rng(0)
    langs = ["de", "en", "es", "fr", "ru", "zz"]
    x = np.vstack([np.abs(r.normal(np.eye(6, 40)[k] * 3, 0.3)) for k in range(6) for _ in range(20)]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = [k for k in langs for _ in range(20)]
    model = language_id.Hierarchy(x, y)
    got, score = model.predict(x)
    assert got == y and score.min() > 0 and len(model.families) == 4


def test_votes_and_ties_by_hand():
    """Family by the largest machine, then one vote for each pair; ties go to the larger sum of margins, then to the first name."""
    model = language_id.Hierarchy.__new__(language_id.Hierarchy)
    model.langs, model.families = ["ca", "es", "fr", "xx"], ["romance", "xx"]
    model.members, model.rest = [["ca", "es", "fr"], ["xx"]], 1
    model.pairs = [[(0, 1, 1), (0, 2, 2), (1, 2, 3)], []]
    model.w = np.vstack([np.eye(4), np.zeros(4)]).astype(np.float32)

    def plainly(z):
        if z[0] < 0:
            return "xx"
        votes, sums = Counter(), Counter()
        for a, b, m in (("ca", "es", z[1]), ("ca", "fr", z[2]), ("es", "fr", z[3])):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        return min(("ca", "es", "fr"), key=lambda k: (-votes[k], -sums[k], k))

    cases = [[1, 1, 1, 1], [1, -1, 1, 1], [1, 2, -1, 1], [1, 1, -2, 1], [1, 1, -1, 1], [-1, 1, 1, 1], [1, 0, 0, 0], [1, -1, -1, -1], [1, 1, -1, 2]]
    x = np.array(cases, np.float32)
    langs, scores = model.predict(x)
    assert langs == [plainly(z) for z in cases] and langs[4] == "ca" and langs[2] == "ca" and langs[3] == "fr"
    sure = lambda m: 1 / (1 + np.exp(-4 * m))
    assert np.allclose(scores[:3], [sure(1) * sure(1), sure(1) * sure(1), sure(1) * sure(-1)])


def test_every_language_is_learned(spark):
    """105 languages, one of long texts only, and one with a single usable row."""
    word = lambda k: "".join(chr(97 + (k * 7 + j * (k + 3)) % 26) for j in range(6))
    rows = [(200 * k + j, f"{word(k)} {word(k + 1)} {word(k)} " * (2 + j), f"l{k}") for k in range(105) for j in range(2)]
    rows += [(90_000 + j, "ωξψ ζθη " * (9_000 + j), "gr") for j in range(3)] + [(95_000, "12 34", "one"), (95_001, None, "one"), (95_002, "ещё один", "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert len(model.langs) == 107
    got = {r.doc_id: r.lang_pred for r in language_id.predict_languages(docs, model).collect()}
    assert got[90_000] == "gr" and got[95_002] == "one" and got[95_000] == got[95_001] == "und"


# --- 3 packing


def test_pieces(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(str(BYTES))
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        rows = packing.pack_documents(docs, str(BYTES)).collect()
        want = Counter((i, tuple(exact.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in _rows(docs))
        windows = defaultdict(list)
        ids = [np.frombuffer(r.ids, "<u4").tolist() for r in rows]
        for r, x in zip(rows, ids):
            assert len(x) == r.length > 0
            windows[r.sequence_id].append((r.offset, r.length))
        for v in windows.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= 2048
        # pieces come in the order of their documents' ids, one document after the other begins at 0
        texts, open_ = Counter(), {}
        for r, x in sorted(zip(rows, ids), key=lambda p: (repr(p[0].doc_id), p[0].sequence_id, p[0].offset)):
            key = next((k for k, v in open_.items() if k[0] == r.doc_id and len(v) == r.start and k[1] == r.doc_tokens), None) if r.start else None
            if key is None:
                assert r.start == 0
                key = (r.doc_id, r.doc_tokens, len(open_) + len(texts))
                open_[key] = []
            open_[key] += x
            if len(open_[key]) == r.doc_tokens:
                texts[(r.doc_id, tuple(open_.pop(key)))] += 1
        assert not open_ and texts == want
        total = sum(r.length for r in rows)
        assert sum(2048 - sum(n for _, n in v) for v in windows.values()) < 0.02 * total + 2048 * 8
    assert packing.pack_documents(no_docs, str(BYTES)).count() == 0


def test_neighbours_are_lexically_close():
    docs = [np.array([7, 8, 9] * 5 + [100 + k // 2], np.uint32) for k in range(40)]
    index = packing.Bm25(docs)
    used = np.zeros(40, bool)
    used[10] = True
    assert index.neighbours(10, used)[0] == 11
    used[11] = True
    assert 11 not in index.neighbours(10, used)


def test_windows_follow_the_whole_ranking():
    """All terms of a seed count, and its ranking goes on until the window is full."""
    r = np.random.default_rng(4)
    docs = [r.integers(0, 300, r.integers(60, 140)).astype(np.uint32) for _ in range(60)]
    df = Counter(t for d in docs for t in set(d.tolist()))
    mean = sum(map(len, docs)) / 60

    def score(seed, d):
        tf = Counter(docs[d].tolist())
        norm = packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / mean)
        return sum(np.log1p((60 - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (packing.K1 + 1) / (tf[t] + norm) for t in set(docs[seed].tolist()))

    used = np.zeros(60, bool)
    used[[0, 7]] = True
    want = sorted((d for d in range(60) if not used[d]), key=lambda d: -score(0, d))
    assert packing.Bm25(docs).neighbours(0, used) == want
    used[7] = False
    pieces = packing.fill_windows(docs, 3000)
    first = list(dict.fromkeys(d for d, _, _, window, _ in pieces if window == 0))
    want = sorted(range(1, 60), key=lambda d: -score(0, d))
    assert len(first) > 20 and first == [0, *want[: len(first) - 1]]


def test_corpus_statistics_and_routes(spark, monkeypatch):
    """Document frequencies and mean length of the whole table; copies and near copies meet whatever lies between them."""
    r = random.Random(9)
    texts = [" ".join(f"{r.choice('bcdfg')}{r.randrange(900)}" for _ in range(60)) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, f"{t} {k}") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    encode = packing.tokenizer(str(BYTES))
    ids = {i: np.append(encode(t.encode()), np.uint32(1)) for i, t in rows}
    tokens = packing.tokenized(docs.selectExpr("doc_id AS _id", "cast(text AS binary) AS t"), str(BYTES), 1)
    stats, df = packing.corpus(tokens), Counter(t for x in ids.values() for t in set(x.tolist()))
    assert all(abs(stats.idf[t] - np.log1p((600 - n + 0.5) / (n + 0.5))) < 1e-5 for t, n in df.items()) and abs(stats.mean - np.mean([len(x) for x in ids.values()])) < 1e-9
    monkeypatch.setattr(packing, "SHARD_TOKENS", 20_000)  # the table is several shards
    windows = defaultdict(set)
    for x in packing.pack_documents(docs, str(BYTES)).collect():
        windows[x.doc_id].add(x.sequence_id)
    near = lambda k: any(abs(a - b) <= 1 for a in windows[k] for b in windows[1000 + k])  # noqa: E731  the same window or the next
    assert sum(near(k) for k in range(300)) > 200


def test_fast_ids_equal_the_library():
    from tokenizers import Tokenizer

    exact, ours, r = Tokenizer.from_file(str(BYTES)), packing.tokenizer(str(BYTES)), random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "é", "中", "👍", "20", "'ll", "\x85", "\xa0", "\x1c", "<|endoftext|>", "²", "ß", "\r\n", "\t"]
    for _ in range(2000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert ours(s.encode()).tolist() == exact.encode(s, add_special_tokens=False).ids


def test_texts_without_runs_of_blanks_need_no_look_ahead():
    from tokenizers import Tokenizer

    exact, ours, r = Tokenizer.from_file(str(BYTES)), packing.tokenizer(str(BYTES)), random.Random(4)
    assert "(?!" not in ours.single._pat_str and "(?!" in ours.fast._pat_str
    for _ in range(600):
        text = "".join(r.choice(["we", "'s", "'ll", " ", "\n", "\t", "\r", "9", "é", "--", " a", "A's "]) for _ in range(30))
        for t in (text, " ".join(text.split()), " " + "\n".join(text.split()) + "\t"):
            assert ours(t.encode()).tolist() == exact.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("factor", [1, 500])
def test_sums_of_scores_are_exact_in_any_order(monkeypatch, factor):
    rng = np.random.default_rng(8)
    docs = [(rng.zipf(1.3, rng.integers(1, 80)) % 400 * factor).astype(np.uint32) for _ in range(150)]
    at_once, used = packing.Bm25(docs), np.zeros(150, bool)
    assert at_once.rows and at_once.frequent is not None and np.array_equal(at_once.score * packing.GRID, np.rint(at_once.score * packing.GRID))
    windows = packing.fill_windows(docs, 100)
    monkeypatch.setattr(packing, "TABLE", 0)
    one_by_one = packing.Bm25(docs)
    assert one_by_one.frequent is None and packing.fill_windows(docs, 100) == windows
    assert all(at_once.neighbours(i, used) == one_by_one.neighbours(i, used) for i in range(150))


# --- 4 packages

PAGE = "page_id long, url string, html string, payload string, digest int, first string"


def test_packages_on_odd_input(spark, tmp_path):
    big = "<p>" + "x" * 300_000 + "</p>"
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", "ü" * 60), (8, "u", "ü" * 60), (9, "u", "ü" * 60), (1, "http://a/", big)]
    pages = spark.createDataFrame([(*r, "p", 1, "f") for r in rows], PAGE)
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc_zip.round_trip(pages, str(tmp_path / "w")).collect())
    assert got == Counter([(1, "response", None, 300_007), (1, "response", None, 300_007), (2, "revisit", 1, 300_007), (3, "response", None, 0), (4, "response", None, 0), (5, "response", None, 5), (6, "response", None, 5), (None, "revisit", 8, 120), (8, "response", None, 120), (9, "revisit", 8, 120)])
    read = Counter((r.page_id, r.payload_digest == hashlib.sha256(bytes(r.payload)).hexdigest(), len(r.payload)) for r in warc_zip.round_trip(pages, str(tmp_path / "p")).collect())
    assert read == Counter((i, True, len((t or "").encode())) for i, _, t in rows)  # revisits have the payload they name
    names = [f for f in os.listdir(tmp_path / "w") if f.endswith(".wacz")]
    assert names
    for name in names:  # an independent reader finds the same members
        path = tmp_path / "w" / name
        with zipfile.ZipFile(path) as z, open(path, "rb") as f:
            assert z.testzip() is None
            own = warc_zip.PackageReader(f, path.stat().st_size)
            assert {n: z.read(n) for n in z.namelist()} == {n: own.read(n) for n in own.members}
    assert warc_zip.round_trip(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_ids_with_several_payloads(spark, tmp_path):
    """An id that repeats with other payloads: a revisit names the id, and the digest says which of its payloads."""
    a, b = "a" * 200, "b" * 300
    pages = spark.createDataFrame([(1, "u", a), (1, "u", b), (2, "u", a), (2, "u", b), (3, "u", b)], "page_id long, url string, html string")
    got = Counter((r.page_id, r.record_type, r.refers_to, bytes(r.payload).decode()) for r in warc_zip.round_trip(pages, str(tmp_path / "w")).collect())
    assert got == Counter([(1, "response", None, a), (1, "response", None, b), (2, "revisit", 1, a), (2, "revisit", 1, b), (3, "revisit", 1, b)])


@pytest.mark.parametrize("wrong", ["refers", "digest"])
def test_revisits_must_lead_to_their_payload(spark, tmp_path, monkeypatch, wrong):
    own = warc_zip.record

    def other(kind, uri, page_id, payload, size, digest, refers_to=None):
        if kind == "revisit" and wrong == "refers":
            refers_to = 77
        return own(kind, uri, page_id, payload, size, digest[::-1] if kind == "revisit" and wrong == "digest" else digest, refers_to)

    pages = spark.createDataFrame([(1, "u", "a" * 200), (2, "u", "a" * 200)], "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    monkeypatch.setattr(warc_zip, "write_packages", lambda *a, **k: _written_here(spark, folder, other))
    with pytest.raises(Exception, match="leads to no"):
        warc_zip.round_trip(pages, folder).collect()


def _written_here(spark, folder, record):
    """A package with one response and one revisit of the given making."""
    os.makedirs(folder)
    path, digest = f"{folder}/pages.wacz", hashlib.sha256(b"a" * 200).hexdigest()
    with open(path, "wb") as f:
        w = warc_zip.PackageWriter(warc_zip._Unseekable(f))
        w.add({"page_id": 1, "url": "u", "digest": digest}, record("response", "u", 1, b"a" * 200, 200, digest))
        w.add({"page_id": 2, "url": "u", "digest": digest}, record("revisit", "u", 2, b"", 200, digest, 1))
        w.close()
    return spark.createDataFrame([(path, os.path.getsize(path))], "path string, size long")


def test_package_reader_formats():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a comment with PK\x05\x06 in it"
        z.writestr("deflated.txt", "x" * 100, zipfile.ZIP_DEFLATED)
        with z.open("ünicode/stored.bin", "w", force_zip64=True) as f:
            f.write(b"0123456789")
    reader = warc_zip.PackageReader(raw, len(raw.getvalue()))
    assert list(reader.members) == ["ünicode/stored.bin"] and reader.read("ünicode/stored.bin", 3, 4) == b"3456"
    with pytest.raises(ValueError):
        reader.read("ünicode/stored.bin", 8, 4)
    with pytest.raises(ValueError):
        warc_zip.PackageReader(io.BytesIO(b"no zip"), 6)
    # sizes and offset all from the ZIP64 field, in its order
    field = b"\x01\x00\x18\x00" + b"".join(v.to_bytes(8, "little") for v in (5_000_000_000, 6_000_000_000, 7_000_000_000))
    assert warc_zip.PackageReader.wide(field, 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF) == (6_000_000_000, 5_000_000_000, 7_000_000_000)


def test_zip64_directory_of_many_members():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        for k in range(66_000):
            z.writestr(zipfile.ZipInfo(f"{k}"), b"%d" % k)
    reader = warc_zip.PackageReader(raw, len(raw.getvalue()))
    assert len(reader.members) == 66_000 and reader.read("65999") == b"65999"


# --- 5 quality rules


def test_rules_on_odd_input(odd_docs, no_docs):
    rows = quality_rules.judge_quality(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[0].n_words == 0 and by_id[0].base_failed and not by_id[0].kept
    assert by_id[9].n_repeat_words == 200 and by_id[9].base_failed
    assert by_id[3].n_words == 60_000 and by_id[3].n_repeat_words == 60_000
    kept = quality_rules.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(map(repr, (r[0] for r in kept.collect()))) == sorted(repr(r.doc_id) for r in rows if r.kept)
    assert quality_rules.judge_quality(no_docs).count() == 0 and quality_rules.keep_good(no_docs).count() == 0


def test_rules_catch_junk_and_keep_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    d = quality_rules.judge_quality(docs).join(labels, "doc_id").toPandas()
    clean = d[(d["quality"] == 1) & ~d["base_failed"]]
    assert clean["kept"].mean() > 0.98 and d[d["quality"] == 0]["kept"].mean() < 0.1


def test_rules_use_no_python(spark, monkeypatch):
    """The plans of the query itself and of every table that it writes on its way."""
    plans, settle = [], quality_rules.settle
    monkeypatch.setattr(quality_rules, "settle", lambda df, *a, **k: plans.append(df) or settle(df, *a, **k))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plans += [quality_rules.op5_quality_rules(spark, SF), quality_rules.keep_good(docs)]
    assert len(plans) == 6 and not any(x in p._jdf.queryExecution().toString() for p in plans for x in ("Python", "Pandas", "Arrow"))


def test_rules_learn_any_language(spark):
    """A fifth language has a reference of its own; one with few documents, or none, is judged by the base rules alone."""
    r = random.Random(5)
    function, content = "i w nie na się z do to że jest o jak po co".split(), [f"słowo{k}" for k in range(400)]
    prose = lambda: " ".join(r.choice(function) if r.random() < 0.45 else r.choice(content) for _ in range(150))
    junk = lambda: " ".join(f"{r.choice(content)}{k}" for k in range(150))
    rows = [(k, prose(), "pl") for k in range(60)] + [(100 + k, junk(), "pl") for k in range(6)]
    rows += [(200 + k, junk(), lang) for k, lang in enumerate(["fi", "fi", None, None])]
    kept = {x.doc_id: (x.kept, x.base_failed, x.word_distance) for x in quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[k][0] for k in range(60)) and not any(kept[100 + k][0] or kept[100 + k][1] for k in range(6))
    assert all(kept[200 + k] == (True, False, None) for k in range(4))
    assert set(function[:10]) <= set(quality_rules.common_words(spark.createDataFrame(rows, "doc_id long, text string, lang string")).first().common)


# --- 6 embeddings


def links_by_hand(rows, cosine=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and len(v) and np.isfinite(np.array(v, float)).all() and np.any(v)]
    good = [(i, v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())) for i, v in good]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    n = Counter()
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y >= cosine:
                n[i] += 1
                n[j] += 1
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return sorted((i, n[i], root(i)) for i, _ in rows if i is not None)


def test_embeddings_by_hand(spark, monkeypatch):
    r = np.random.default_rng(4)
    base = r.normal(size=(6, 40))
    rows = [(k, (base[k % 6] + r.normal(scale=s, size=40)).tolist()) for k, s in enumerate(np.repeat([0.05, 0.25, 0.33, 2.0], 30))]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, (2 * np.array(rows[0][1])).tolist())]
    rows += [(300, None), (301, []), (302, [0.0] * 40), (303, [float("nan")] * 40), (304, [1.0, None]), (305, [float("inf"), 1.0]), (306, [1.0, 2.0]), (307, [1.0, 2.1]), (308, [1e-200, 2e-200]), (309, [1e300, 2e300]), (None, rows[0][1])]
    frame = spark.createDataFrame([(*x, "v", 1) for x in rows], "vec_id long, embedding array<double>, v string, rep int")
    want = links_by_hand(rows)
    for chunk in (8192, 16):
        monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
        out = embedding_dedup.near_duplicates(frame).collect()
        assert sorted((x.vec_id, x.n_links, x.component_id) for x in out if x.vec_id is not None) == want
        lone = [x for x in out if x.vec_id is None]
        assert [(x.n_links, x.component_id, x.kept) for x in lone] == [(0, None, True)]
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_ids_with_several_vectors(spark):
    """Each row counts what its own vector links with; the component goes by the id."""
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, x), (5, y), (1, y), (7, x), (9, x), (8, z), (8, z), (6, [1.0, 0.01, 0.0]), (None, x)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out)
    assert got == Counter([(5, 3, 1, False), (5, 1, 1, False), (1, 1, 1, True), (7, 3, 1, False), (9, 3, 1, False), (8, 1, 8, True), (8, 1, 8, True), (6, 3, 1, False), (None, 0, None, True)])


def test_some_block_keeps_its_share():
    r = np.random.default_rng(9)
    for dim in (2, 5, 16, 33, 64):
        x = r.normal(size=(300, dim))
        y = x + r.normal(scale=0.3, size=x.shape)
        a, b = embedding_dedup.rotated(x), embedding_dedup.rotated(y)
        close = (a * b).sum(1) >= 0.9
        share = embedding_dedup.shares(dim, 0.9)
        within = np.array([((a - b)[:, s] ** 2).sum(1) <= share[k] for k, s in enumerate(embedding_dedup.blocks(dim))])
        assert close.any() and within.any(0)[close].all()


# --- 7 URL filters


def verdict_by_hand(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=url_filters.rank, default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_rules_by_hand(spark):
    r = random.Random(8)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "aa.com", "org", "x.org", "com.", ""]
    paths = ["", "/", "/a", "/a/b", "/a/b/c", "/ü"]
    rules = [(r.choice(hosts[:7]), r.choice(paths), r.choice(["allow", "block"])) for _ in range(25)]
    urls = [None, "", "no-scheme/a", "http://", "HTTP://B.A.COM/a/b?x=://y", "x://a.com#/a", "ftp://ÄÖ.com/a\n/b", "http://a.com/" + "z" * 100_000] + [f"http://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q', '#f'])}" for _ in range(150)]
    frame = spark.createDataFrame([(k, u, "p", "q") for k, u in enumerate(urls)] + [(None, urls[4], "p", "q")], "page_id long, url string, path string, verdict string")
    want = sorted([(k, *verdict_by_hand(u, rules)) for k, u in enumerate(urls)] + [(None, *verdict_by_hand(urls[4], rules))], key=repr)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for given, size in ((rules, 1000), (rules, 3), (table, 4)):
        assert sorted((tuple(x) for x in url_filters.judge_urls(frame, given, max_rules=size).collect()), key=repr) == want
    assert {x.verdict for x in url_filters.judge_urls(frame, [], default="block").collect()} == {"block"}
    assert url_filters.judge_urls(frame.limit(0), rules).count() == 0


# --- 8 pieces


def test_models_that_change_texts_are_refused(tmp_path):
    model = Path(PIECES).read_bytes()
    piece_bpe.refuse_other_models(model)
    part = lambda number, *body: bytes([number << 3 | 2, len(body), *body])  # noqa: E731  a part of the file again: its settings replace the ones before
    changes = {"no leading space": part(3, 24, 0), "trimmed": part(3, 32, 1), "escaped": part(3, 40, 0), "rewritten": part(3, 18, 1, 65), "merge type": part(2, 24, 1), "user-defined": part(1, 10, 1, 113, 24, 4)}
    for what, extra in changes.items():
        with pytest.raises(ValueError, match=what):
            piece_bpe.refuse_other_models(model + extra)
    path = tmp_path / "trimmed.model"
    path.write_bytes(model + changes["trimmed"])
    with pytest.raises(ValueError, match="trimmed"):
        piece_bpe.PieceModel(str(path))


def test_pieces_equal_the_library(spark, odd_docs, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(PIECES))
    r = random.Random(6)
    parts = ["a", "the", "▁", " ", "  ", "\n", "\t", "é", "中", "ｶ", "👍", "ﬁ", "20", "''", "ing", "\x00", "<s>", "<0x41>", " ⁇ ", "\r\n", "İ"]
    small = piece_bpe.PieceModel(str(PIECES), memory=50)
    for s in ["", " ", "▁", "▁▁a", "a  b "] + ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(2000)]:
        ids, text = small.encode(s)
        ids = np.frombuffer(ids, np.int32).tolist()
        assert ids == sp.encode(s) and text.decode() == sp.decode(ids) == small.decode(ids)
    for ids in ([300, 400, 231, 187, 29], [258, 68], [0, 1, 2, 300]):
        assert small.decode(ids) == sp.decode(ids)
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        got = Counter((x.doc_id, tuple(x.ids), x.decoded) for x in piece_bpe.encode_documents(docs, str(PIECES)).collect())
        assert got == Counter((i, tuple(e := sp.encode(t or "")), sp.decode(e)) for i, t in _rows(docs))
    assert piece_bpe.encode_documents(no_docs, str(PIECES)).count() == 0
    first = piece_bpe.op8_piece_bpe(spark, SF).where("doc_id = 0").first()
    text = next(t for i, t in _rows(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")) if i == 0)
    assert first.ids_sha256 == hashlib.sha256(",".join(map(str, sp.encode(text))).encode()).hexdigest() and first.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


# --- 9 classifier


def test_classifier_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    d = quality_classifier.op9_quality_classifier(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert (d["predicted"] == d["quality"]).mean() > 0.93


def test_gradients_by_differences():
    net = quality_classifier.ByteNet(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts, y, w = [b"abc def ghi" * 5, b"zz", b"", b"hello world" * 300], np.array([1.0, 0, 1, 0]), np.ones(4)

    def loss():
        p = 1 / (1 + np.exp(-(net.pooled(texts)[0].astype(np.float64) @ net.p["v"] + net.p["c"][0])))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradients(texts, y, w)
    r = np.random.default_rng(0)
    for name in ("w", "b", "v", "c"):
        flat, got = net.p[name].reshape(-1), g[name].reshape(-1)
        for k in r.integers(0, len(flat), 6):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-3 - got[k]) < 2e-3


def test_classifier_sees_the_whole_text():
    net = quality_classifier.ByteNet(2)
    text = b"quiet words here " * 3000
    other = text[:-40] + b"$$$ ### %%% &&&" + text[-25:]
    assert net.scores([text])[0] != net.scores([other])[0]
    batch = net.scores([text, b"", b"x", other])
    assert np.allclose(batch, [net.scores([t])[0] for t in (text, b"", b"x", other)])


def test_scores_by_plain_loops():
    """Every filter at every position of the whole text, chunk by chunk, one multiplication at a time."""
    net = quality_classifier.ByteNet(5)
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    r = random.Random(1)
    texts = [b"", b"a", b"abcdefgh", b"abcdefghi", bytes(r.randrange(256) for _ in range(2 * quality_classifier.CHUNK + 100))]
    for text, score in zip(texts, net.scores(texts)):
        n = max(1, -(-len(text) // 4) - 1)
        padded = list(text) + [quality_classifier.PAD] * (4 * (n + 1) - len(text))
        chunks = defaultdict(lambda: [-1e9] * quality_classifier.FILTERS)
        for k in range(n):
            x = [v for byte in padded[4 * k : 4 * k + 8] for v in p["emb"][byte]]
            best = chunks[4 * k // quality_classifier.CHUNK]
            for f in range(quality_classifier.FILTERS):
                best[f] = max(best[f], sum(v * w[f] for v, w in zip(x, p["w"])))
        tops = [[max(0.0, v + b) for v, b in zip(c, p["b"])] for c in chunks.values()]
        h = [max(t[f] for t in tops) for f in range(quality_classifier.FILTERS)] + [sum(t[f] for t in tops) / len(tops) for f in range(quality_classifier.FILTERS)]
        z = sum(a * b for a, b in zip(h, p["v"])) + p["c"][0]
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-4


def test_training_rows_of_both_classes(spark):
    """A class has ``max_train`` rows, or all that can be learned from: labels without a usable document take no place."""
    docs = spark.createDataFrame([(k, f"text {k}" if k % 7 else None) for k in range(200)] + [(1, "a first text"), (2, "x" * 50_000)], "doc_id long, text string")
    lab = spark.createDataFrame([(k, int(k % 10 > 0)) for k in range(2000)] + [(11, 0), (20, 1), (21, 1)], "doc_id long, quality int")
    rows = quality_classifier.training_rows(docs, lab, "doc_id", "text", "quality", 30, 20_000, lambda c: c != 3)
    usable = [k for k in range(200) if k % 7 and k not in (3, 11, 20)]
    assert [y for _, _, y in rows].count(1) == 30 and [i for i, _, y in rows if y == 0] == [k for k in usable if k % 10 == 0]
    assert {i: t for i, t, _ in rows}.get(1, b"a first text") == b"a first text" and not {i for i, _, _ in rows} - set(usable)


def test_classifier_on_odd_input(spark, odd_docs, no_docs):
    lab = spark.createDataFrame([(5, 1), (9, 0), (3, 1), (None, 1), (2, None), (9, 0)], "doc_id long, quality int")
    net = quality_classifier.train(odd_docs, lab)
    rows = quality_classifier.score_documents(odd_docs, net).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    kept = quality_classifier.keep_good(odd_docs, net, 0.5)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.score >= 0.5 for r in rows)
    one = quality_classifier.train(odd_docs, lab.where("quality = 1"))
    assert {r.score for r in quality_classifier.score_documents(odd_docs, one).collect()} == {1.0}
    none = quality_classifier.train(no_docs, lab)
    assert {r.score for r in quality_classifier.score_documents(odd_docs, none).collect()} == {0.5}


# --- 10 near-duplicates


def groups_by_hand(rows, k, percent=80):
    sets = defaultdict(set)
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
        if i is not None and w:
            sets[i] |= {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or {tuple(w)}
    ids = sorted({i for i, _ in rows if i is not None})
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_by_hand(spark, odd_docs, no_docs, words):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for d in (docs, odd_docs):
        got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(d, words).collect() if r.doc_id is not None}
        assert got == groups_by_hand(_rows(d), words)
    assert minhash_forest.near_duplicates(no_docs, words).count() == 0


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "GROUP", 50)  # comparisons with one document in several groups
    r = random.Random(1)
    text = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = [(k, " ".join(w if r.random() > 0.01 else f"z{r.randrange(9999)}" for w in text)) for k in range(400)]
    rows += [(1000 + k, " ".join(f"q{r.randrange(10**6)}" for _ in range(100))) for k in range(200)]
    out = {x.doc_id: x.component_id for x in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert all(out[k] == 0 for k in range(400)) and all(out[1000 + k] == 1000 + k for k in range(200))


def test_a_crowd_lists_few_candidates(spark):
    """Pairs of a crowd are left to the pass that compares all of them: its members are candidates of the smallest ids of regions."""
    common = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*common, *(f"x{i}-{j}" for j in range(20))]).encode()) for i in range(300)]
    sketches = minhash_forest.sketches(spark.createDataFrame(rows, "id long, t binary"), 2)
    reps = sketches.selectExpr("id AS rep", "n", "sig")
    pairs, crowd = minhash_forest.candidates(reps, 80)
    assert pairs.count() < 20 * 300  # by neighbours, too: more than 30 * 300
    assert crowd.selectExpr("a AS x").union(crowd.select("b")).distinct().count() == 300


def test_links_inside_a_crowd(spark):
    """One template with fills of their own: any two are at 199/253, pairs that share three words of fill at 202/250."""
    template = " ".join(f"t{k}" for k in range(200))
    fill = lambda k, n: " ".join(f"f{k}_{j}" for j in range(n))
    rows = [(k, f"{template} {fill(k, 27)}") for k in range(500)]
    rows += [(1000 + 2 * k + side, f"{template} {fill(-k, 3)} {fill(1000 + 2 * k + side, 24)}") for k in range(1, 51) for side in (0, 1)]
    rows += [(5000 + k, f"{template} {fill(9999, 27)} {fill(5000 + k, 1)}") for k in range(300)]  # a group that the forest links
    random.Random(3).shuffle(rows)
    out = {x.doc_id: x.component_id for x in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert out == {k: 5000 if k >= 5000 else k - k % 2 if k >= 1000 else k for k in out} and len(out) == 900


@pytest.mark.parametrize("dense", [0, 5, 10**9])
def test_common_counts_of_blocks(monkeypatch, dense):
    monkeypatch.setattr(minhash_forest, "DENSE", dense)
    r = np.random.default_rng(2)
    x, y = ([np.unique(r.integers(0, 80, r.integers(1, 40)).astype(np.uint64)) for _ in range(m)] for m in (30, 17))
    assert minhash_forest.common_counts(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]


def test_shingle_sets_are_exact():
    texts = [b"a b a b c", b"A B a b C", b"a", b"", b"a b", b"b a"]
    two = [len(s) for s in minhash_forest.shingle_sets(texts, 2)]
    assert two == [3, 3, 1, 0, 1, 1]
    s = minhash_forest.shingle_sets(texts, 2)
    assert (s[0] == s[1]).all() and s[4][0] != s[5][0] and minhash_forest.similar(s[0], s[0], 80)
    assert [len(x) for x in minhash_forest.shingle_sets(texts, 5)] == [1, 1, 1, 0, 1, 1]


def test_components_of_long_paths_and_stars(spark):
    r = random.Random(3)
    n = 300
    name = list(range(n))
    r.shuffle(name)
    pairs = [(name[k], name[k + 1]) for k in range(n - 1) if k % 100 != 99] + [(1000, 1000 + k) for k in range(1, 80)] + [(5, 5)]
    up = {}
    for a, b in pairs:
        up.setdefault(a, a), up.setdefault(b, b)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    frame = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    assert {x.node: x.component for x in components.components(frame).collect()} == {k: root(k) for k in up}
    assert components.components(frame.limit(0)).count() == 0
