"""Quality rules by distribution divergence, with DataFrame functions only.

Of every document two histograms are taken: of character classes (over the
characters of its words), and of its language's ``LIST`` most common words (with
one more bin for all other words).  A language's common words are those in most of
its documents; its reference is the sum of the histograms of all its documents that
pass the base rules.  Both are learned from the whole corpus, for every ``lang`` with
``MIN_DOCUMENTS`` documents or more.  A document is rejected when the Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1) of either histogram from
its language's reference is above its limit.  A short document has a ragged histogram
by chance alone, so a guard applies: each limit is widened by ``slack / sqrt(count)``, and
below ``min_chars`` characters or ``min_words`` words the histogram isn't judged.  A
document without a language, or whose language has no reference, isn't held against
any: the base rules decide alone.

Repeated windows are found by 64-bit hashes of eight words, made by doubling
(one, two, four, eight words) and sorted within the document, so a long text
costs n log n.  One pass over the texts counts in how many documents of a language
each word is (combined before the shuffle), a second one takes the counts of each
document, which are written to the shared folder; references and verdicts come
from that table.  Word lists are broadcast: one row a language, and an error beyond
``MAX_LANGUAGES`` of them.

Defined results: a null text has no words and fails the base rules, as does an
empty one.  Repeated rows count as often as they occur.  With no reference at
all (an empty table, or every document failing) the base rules decide alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starling.llm.common import WS_CLASS, pick, settle

LIST = 18
MIN_DOCUMENTS, MAX_LANGUAGES = 20, 100_000

#: Character classes in the order in which they are taken out; what is left over is the last class.
CLASSES = [("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"), ("stop", "[.,;:!?]+"), ("punct", r"[\x00-\x7F]+")]
N_CLASSES = len(CLASSES) + 1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REPEAT_WINDOW = 8  # a power of two

#: Limits of the Jensen-Shannon distances, and what a short text may have on top.
CHAR_LIMIT, CHAR_SLACK = 0.16, 2.0
WORD_LIMIT, WORD_SLACK = 0.15, 1.5
MIN_CHARS, MIN_WORDS = 200, 40


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WS_CLASS), "")


def _lower(words: Column) -> Column:
    """A-Z lower-cased, as every engine can do alike."""
    return F.translate(words, UPPER, UPPER.lower())


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``_lang, common``: the words that are in most documents of a language, ties by word, of all languages with enough documents."""
    d = pick(docs, _text=text_col, _lang=lang_col).where("_lang is not null")
    enough = d.groupBy("_lang").agg(F.count("*").alias("_docs")).where(F.col("_docs") >= MIN_DOCUMENTS)
    n = d.select("_lang", F.explode(F.array_distinct(_words(_lower(F.col("_text"))))).alias("w")).groupBy("_lang", "w").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "w"))  # limited before the shuffle, too
    top = n.withColumn("k", rank).where(F.col("k") <= LIST).groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("l"))
    return settle(top.join(enough, "_lang", "left_semi").select("_lang", F.col("l.w").alias("common")), "common-words", small=True)


def features(docs: DataFrame, common: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", whole_rows: bool = False) -> DataFrame:
    """``_id``, ``_lang``, the base counts, ``chars`` and ``hits``: one histogram each (``hits`` null without common words).  With ``whole_rows`` ``_id`` is the whole row."""
    if common.limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages have {MIN_DOCUMENTS} documents; is {lang_col!r} a language?")
    if whole_rows:
        flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
        d = flat.select(F.struct(*flat.columns).alias("_id"), F.col(f"_c{docs.columns.index(text_col)}").alias("_text"), F.col(f"_c{docs.columns.index(lang_col)}").alias("_lang"))
    else:
        d = pick(docs, _id=id_col, _text=text_col, _lang=lang_col)
    d = d.join(F.broadcast(common), "_lang", "left").withColumn("_text", F.coalesce("_text", F.lit("")))
    d = d.select("_id", "_lang", "common", _words(F.col("_text")).alias("words"), F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("words")
    d = d.select(
        "_id", "_lang", "common", n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array_join("words", "").alias("t0"),
        F.when(n >= REPEAT_WINDOW, F.transform("words", lambda w: F.xxhash64(w))).alias("g1"),
        F.when(F.col("common").isNotNull(), F.concat(F.lit(" "), F.array_join(F.filter(F.split(_lower(F.array_join("words", " ")), " "), lambda w: F.array_contains("common", w)), "  "), F.lit(" "))).alias("hit"),
    )
    size = 1
    while size < REPEAT_WINDOW:  # the hash of 2, 4, 8 words from the hashes of the two halves
        whole, half = F.col(f"g{size}"), f"g{size}"
        if 2 * size == REPEAT_WINDOW:
            whole = F.slice(whole, F.lit(1), F.size(whole) - (REPEAT_WINDOW - 1))
        d = d.withColumn(f"g{2 * size}", F.transform(whole, lambda x, i: F.xxhash64(x, F.get(half, i + size))))  # noqa: B023
        size *= 2
    d = d.withColumnRenamed(f"g{size}", "grams")
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    d = d.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, i, j: F.coalesce((F.get("sorted", j)["g"] == x["g"]) & (j >= 0), F.lit(False))
    flagged = F.transform("sorted", lambda x, i: F.when(same(x, i, i - 1) | same(x, i, i + 1), x["i"]).otherwise(F.lit(-1)))
    d = d.withColumn("at", F.sort_array(F.filter(flagged, lambda i: i >= 0)))
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(REPEAT_WINDOW)))), F.lit(0), lambda a, x: a + x)
    counts = {"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long")}
    for k, (name, rx) in enumerate(CLASSES):  # each step leaves a shorter string to the next
        d = d.withColumn(f"t{k + 1}", F.regexp_replace(f"t{k}", rx, ""))
        counts[name] = F.char_length(f"t{k}") - F.char_length(f"t{k + 1}")
    d = d.withColumns({k: v for k, v in counts.items()})
    in_hit = lambda w: (F.char_length("hit") - F.char_length(F.replace("hit", w, F.lit("")))) / F.char_length(w)
    d = d.withColumn("listed", F.transform("common", lambda w: in_hit(F.concat(F.lit(" "), w, F.lit(" "))).cast("int")))
    return d.select(
        "_id", "_lang", "n_words", F.char_length("t0").cast("long").alias("word_chars"), F.col("symbol").cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        F.array(*[F.col(c[0]).cast("int") for c in CLASSES], F.char_length(f"t{len(CLASSES)}")).alias("chars"),
        F.concat("listed", F.array(F.col("n_words").cast("int") - F.aggregate("listed", F.lit(0), lambda a, x: a + x))).alias("hits"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def references(counts: DataFrame) -> DataFrame:
    """``_lang, char_shares, word_shares`` of each language with MIN_DOCUMENTS documents that pass the base rules."""
    good = counts.where(~base_failed() & F.col("hits").isNotNull())
    add = lambda c, size: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(size)])
    sums = good.groupBy("_lang").agg(F.count("*").alias("_docs"), add("chars", N_CLASSES).alias("c"), add("hits", LIST + 1).alias("h")).where(F.col("_docs") >= MIN_DOCUMENTS)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    # a language with fewer different words than LIST has a shorter list
    return sums.select("_lang", F.transform("c", lambda x: x / total("c")).alias("char_shares"), F.transform(F.filter("h", lambda x: x.isNotNull()), lambda x: x / total("h")).alias("word_shares"))


def js_distance(counts: str, total: str, shares: str) -> Column:
    """Jensen-Shannon distance of a histogram column from a column of shares."""
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(F.transform(counts, lambda x: x / F.col(total)), shares, lambda p, r: (part(p, (p + r) / 2) + part(r, (p + r) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def _verdict(counts: DataFrame, char_limit: float, word_limit: float) -> DataFrame:
    """``counts`` with ``base_failed``, ``char_distance``, ``word_distance`` and ``kept``."""
    d = counts.join(references(counts), "_lang", "left")
    long = F.col("n_words") >= MIN_WORDS
    char = F.when(long & (F.col("word_chars") >= MIN_CHARS), js_distance("chars", "word_chars", "char_shares"))
    word = F.when(long & F.col("word_shares").isNotNull(), js_distance("hits", "n_words", "word_shares"))
    d = d.withColumns({"base_failed": base_failed(), "char_distance": char, "word_distance": word}).drop("char_shares", "word_shares")
    ok = F.coalesce(F.col("char_distance") <= char_limit + CHAR_SLACK / F.sqrt("word_chars"), F.lit(True)) & F.coalesce(F.col("word_distance") <= word_limit + WORD_SLACK / F.sqrt("n_words"), F.lit(True))
    return d.withColumn("kept", ~F.col("base_failed") & ok)


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """The contract's columns and the two distances (null where a guard applies)."""
    counts = settle(features(docs, common_words(docs, text_col, lang_col), id_col, text_col, lang_col), "quality-counts")
    d = _verdict(counts, char_limit, word_limit)
    return d.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Rows are written once together with their counts, which costs less than to take the counts
    twice, or to shuffle all texts to join verdicts back, and needs no ids.
    """
    counts = settle(features(docs, common_words(docs, text_col, lang_col), text_col=text_col, lang_col=lang_col, whole_rows=True), "quality-counts")
    return _verdict(counts, char_limit, word_limit).where("kept").select("_id.*").toDF(*docs.columns)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The same in DuckDB SQL, over ``documents``."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    steps, prev = [], "t0"
    for k, (name, rx) in enumerate(CLASSES):
        steps.append(f"s{k + 1} AS (SELECT *, regexp_replace({prev}, {text(rx)}, '', 'g') AS t{k + 1} FROM s{k})")
        prev = f"t{k + 1}"
    n = len(CLASSES)
    chars = ", ".join([f"length(t{k}) - length(t{k + 1})" for k in range(n)] + [f"length(t{n})"])
    shares = lambda col: f"list_transform({col}, lambda v: v / list_sum({col}))"

    def jsd(c: str, total: str, r: str) -> str:
        term = lambda x: f"(CASE WHEN {x} > 0 THEN {x} * log2({x} / ((p + q) / 2)) ELSE 0 END)"
        body = f"({term('p')} + {term('q')}) / 2".replace("p", "z[1]").replace("q", "z[2]")
        return f"sqrt(greatest(0, list_sum(list_transform(list_zip(list_transform({c}, lambda v: v / {total}), {r}), lambda z: {body}))))"

    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, list_transform(words, lambda x: translate(x, '{UPPER}', '{UPPER.lower()}')) AS lw,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
enough AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {MIN_DOCUMENTS}),
df AS (SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(list_distinct(lw)) AS x FROM w SEMI JOIN enough USING (lang)) GROUP BY ALL),
common AS MATERIALIZED (SELECT lang, list(x ORDER BY k) AS common FROM (SELECT lang, x, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS k FROM df) WHERE k <= {LIST} GROUP BY lang),
g AS (SELECT doc_id, i, words[i:i + {REPEAT_WINDOW - 1}] AS gram FROM w, unnest(range(1, len(words) - {REPEAT_WINDOW} + 2)) AS t(i)),
f AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(k) AS n_repeat FROM (SELECT doc_id, least({REPEAT_WINDOW}, lead(i, 1, i + {REPEAT_WINDOW}) OVER (PARTITION BY doc_id ORDER BY i) - i) AS k FROM f) GROUP BY 1),
s0 AS (SELECT doc_id, lang, len(words) AS n_words, array_to_string(words, '') AS t0, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
       CASE WHEN common IS NOT NULL THEN list_transform(common, lambda y: len(list_filter(lw, lambda x: x = y))) END AS listed FROM w LEFT JOIN c USING (doc_id) LEFT JOIN common USING (lang)),
{", ".join(steps)},
h AS (SELECT *, length(t0) AS word_chars, length(t{[c[0] for c in CLASSES].index('symbol')}) - length(t{[c[0] for c in CLASSES].index('symbol') + 1}) AS n_symbols, [{chars}] AS chars, list_append(listed, n_words - coalesce(list_sum(listed), 0)::BIGINT) AS hits,
      n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s{n}),
q AS (SELECT lang, i, sum(chars[i]) AS c, sum(hits[i]) AS hit, count(*) AS docs FROM h, unnest(range(1, {max(N_CLASSES, LIST + 1) + 1})) AS t(i) WHERE NOT base_failed AND listed IS NOT NULL GROUP BY ALL),
t AS (SELECT lang, list(c ORDER BY i) FILTER (i <= {N_CLASSES}) AS c, list(hit ORDER BY i) FILTER (hit IS NOT NULL) AS h FROM q WHERE docs >= {MIN_DOCUMENTS} GROUP BY lang),
r AS MATERIALIZED (SELECT lang, {shares('c')} AS rc, {shares('h')} AS rh FROM t),
k AS (SELECT doc_id, {jsd('chars', 'word_chars', 'rc')} AS dc, {jsd('hits', 'n_words', 'rh')} AS dh FROM h JOIN r USING (lang) WHERE n_words >= {MIN_WORDS})
SELECT h.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND (dc IS NULL OR word_chars < {MIN_CHARS} OR dc <= {CHAR_LIMIT} + {CHAR_SLACK} / sqrt(word_chars)) AND (dh IS NULL OR dh <= {WORD_LIMIT} + {WORD_SLACK} / sqrt(n_words)) AS kept
FROM h LEFT JOIN k USING (doc_id)
""".replace("\\\\", "\\")


OP5_SQL = _sql()
