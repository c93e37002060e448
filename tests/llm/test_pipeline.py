"""The pipeline stage by stage against brute force on a small fixture."""

from collections import defaultdict

import numpy as np
import pytest
from test_operators import _rows, groups_by_hand, kept_by_hand

import corpus_pipeline
from starling.llm import quality_classifier, quality_rules
from starling.llm.common import fold

SF = "/root/testdata/sf0.001"


def _ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_one_after_the_other(spark, duck, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    (_, rules), (_, classifier), (_, near), (_, repeats), (_, pack) = corpus_pipeline.STAGES

    def settled(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    one = settled(rules(spark, docs, SF), "1")
    assert one.columns == columns and _ids(one) == sorted(r[0] for r in duck.sql(f"SELECT doc_id FROM ({quality_rules.OP5_SQL}) WHERE kept").fetchall())
    two = settled(classifier(spark, one, SF), "2")
    net = quality_classifier.train(one, spark.read.parquet(f"{SF}/labels.parquet"), usable=lambda c: fold(c, 4) != 2)
    scores = {i: net.scores([t.encode()])[0] for i, t in _rows(one.select("doc_id", "text"))}
    assert _ids(two) == sorted(i for i, s in scores.items() if s >= corpus_pipeline.LEAST_SCORE)
    three = settled(near(spark, two, SF), "3")
    groups = groups_by_hand(_rows(two.select("doc_id", "text")), 5)
    assert three.columns == columns and _ids(three) == sorted(i for i, g in groups.items() if i == g) and three.count() < two.count()
    four = settled(repeats(spark, three, SF), "4")
    before = {r.doc_id: r for r in three.collect()}
    by_hand = {i: (gone, text) for i, _, gone, text in kept_by_hand(_rows(three.select("doc_id", "text")), 35)}
    assert four.columns == columns and sum(g > 0 for g, _ in by_hand.values()) > 0
    for r in four.collect():
        gone, text = by_hand[r.doc_id]
        assert r.text == (text if gone else before[r.doc_id].text) and r.n_chars == (len(text) if gone else before[r.doc_id].n_chars)
        assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)
    five = pack(spark, four, SF).collect()
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(str(__import__("public_tokenizers").path("byte_bpe_50k.json")))
    pieces = defaultdict(dict)
    for r in five:
        pieces[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
    for i, t in _rows(four.select("doc_id", "text")):
        assert [x for s in sorted(pieces[i]) for x in pieces[i][s]] == [*exact.encode(t, add_special_tokens=False).ids, 1]
    key = lambda rows: sorted((r.doc_id, r.start, r.length) for r in rows)
    assert sum(r.length for r in corpus_pipeline.run(spark, SF).collect()) == sum(r.length for r in five) and key(five)


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_input(spark, odd_docs, stage):
    flat = odd_docs.toDF(*[f"c{k}" for k in range(len(odd_docs.columns))])
    docs = flat.selectExpr("c0 AS doc_id", "c1 AS text", "c2 AS lang", "c3 AS source", "c4 AS n_chars")
    f = corpus_pipeline.STAGES[stage][1]
    for d in (docs, docs.limit(0)):
        out = f(spark, d, SF).collect()
        assert len(out) <= max(1, d.count() * 400)
        if stage < 4:
            assert f(spark, d, SF).columns == docs.columns
