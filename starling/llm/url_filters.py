"""URL filters: a sort-merge range join of URLs with prefix rules.

A host is turned round label by label (``blog.example.com`` becomes
``com.example.blog.``), so "this host and all its subdomains" is a prefix, and
a prefix is an interval of the sorted order.  Each partition of URLs is sorted
by that key (in the JVM, spilling if it must) and swept together with the
sorted rules.  The sweep keeps a stack of the rule hosts whose intervals hold
the current key: intervals of prefixes nest, so the stack is the chain of rule
hosts above the URL's host.  At each level the URL's path is looked up among
the rule paths of that level, longest first.

No row is shuffled: a partition's sweep needs the rules only, so a host with a
third of all URLs costs nothing special.  Rules travel in slices of at most
``max_rules`` (default 200,000), a size bound of what a task is sent; a larger
rule table takes one sweep per slice and the best rule so far is kept, which
gives the same result.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule and gets ``default``.  Of several fitting rules the one with
the most characters (host and path) wins, then the one with the longer host,
then ``block``.  Repeated rows are judged one by one; an empty table gives an
empty result; no rules give ``default`` everywhere.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import pick, prepare

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # host, path, "allow" or "block"


def split_rule(text: str) -> tuple[str, str]:
    """``com/en/`` as host ``com`` and path ``/en/``."""
    host, slash, path = text.partition("/")
    return host.lower(), slash + path


def host_key(host: str) -> str:
    """Labels from the right, each followed by a dot; a subdomain's key starts with its parent's."""
    return ".".join(reversed(host.split("."))) + "."


def rank(rule: Rule) -> tuple:
    host, path, verdict = rule
    return (len(host) + len(path), len(host), verdict == "block", host, path)


class Sweep:
    """Sorted rule hosts, and the stack of those whose interval holds the current key."""

    def __init__(self, rules: Iterable[Rule]):
        levels: dict[str, dict[str, Rule]] = {}
        for r in rules:
            at = levels.setdefault(host_key(r[0]), {})
            if r[1] not in at or rank(r) > rank(at[r[1]]):
                at[r[1]] = r
        self.keys = sorted(levels)
        self.levels = [levels[k] for k in self.keys]
        self.lengths = [sorted({len(p) for p in x}, reverse=True) for x in self.levels]
        self.restart()

    def restart(self) -> None:
        self.next, self.stack, self.last = 0, [], ""

    def move(self, key: str) -> None:
        """Advance to ``key``; keys come in ascending order."""
        if key < self.last:  # a new sorted run
            self.restart()
        self.last = key
        end = bisect_right(self.keys, key, self.next)
        for i in range(self.next, end):
            while self.stack and not self.keys[i].startswith(self.keys[self.stack[-1]]):
                self.stack.pop()
            self.stack.append(i)
        self.next = end
        while self.stack and not key.startswith(self.keys[self.stack[-1]]):
            self.stack.pop()

    def best(self, path: str) -> Rule | None:
        found = None
        for i in self.stack:
            for n in self.lengths[i]:
                r = self.levels[i].get(path[:n]) if n <= len(path) else None
                if r is not None:
                    if found is None or rank(r) > rank(found):
                        found = r
                    break  # a shorter path at this host can't win
        return found


def url_parts(url):
    """Host (A-Z lower-cased) and path of a URL column; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(urls: DataFrame, rules: Iterable[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rules: int = 200_000) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` and ``verdict`` of each row of ``urls``.

    ``rules`` are (host, path, verdict) tuples, or a DataFrame with these columns.
    """
    prepare(urls.sparkSession)
    slices = _slices(rules, max_rules)
    df = pick(urls, _id=id_col, _url=url_col)
    host, path = url_parts(F.col("_url"))
    df = df.select("_id", host.alias("host"), path.alias("path"))
    kind = df.schema["_id"].dataType.simpleString()
    df = df.withColumns({"key": F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")), "rule_host": F.lit(None).cast("string"), "rule_path": F.lit(None).cast("string"), "verdict": F.lit(default)})
    schema = f"_id {kind}, host string, path string, key string, rule_host string, rule_path string, verdict string"
    for part in slices:
        df = df.select("_id", "host", "path", "key", "rule_host", "rule_path", "verdict").sortWithinPartitions("key").mapInPandas(_sweeper(part), schema)
    return df.select(F.col("_id").alias(id_col), "host", "path", F.concat("rule_host", "rule_path").alias("rule"), "verdict")


def _slices(rules, max_rules: int) -> Iterator[list[Rule]]:
    if not isinstance(rules, DataFrame):
        rows = sorted(set(rules))
        for i in range(0, len(rows), max_rules):
            yield rows[i : i + max_rules]
        return
    table = pick(rules, host="host", path="path", verdict="verdict").dropDuplicates().orderBy("host", "path", "verdict")
    part: list[Rule] = []
    for r in table.toLocalIterator():
        part.append((r.host, r.path, r.verdict))
        if len(part) == max_rules:
            yield part
            part = []
    if part:
        yield part


def _sweeper(rules: list[Rule]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sweep = Sweep(rules)
        for b in batches:
            hosts, paths, verdicts = [], [], []
            for key, path, h, p, v in zip(b["key"], b["path"], b["rule_host"], b["rule_path"], b["verdict"]):
                sweep.move(key)
                r = sweep.best(path)
                if r is not None and not (isinstance(h, str) and rank((h, p, v)) >= rank(r)):
                    h, p, v = r
                hosts.append(h)
                paths.append(p)
                verdicts.append(v)
            yield b.assign(rule_host=hosts, rule_path=paths, verdict=verdicts)

    return run


#: The rules of query op7 (fixed values).
OP7_RULES = [
    (*split_rule("com/en/"), "block"),
    (*split_rule("example.com/en/7"), "allow"),
    (*split_rule("net/de/"), "allow"),
    (*split_rule("example.net/de/8"), "block"),
    (*split_rule("org/es/"), "block"),
]


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), OP7_RULES)


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rh, rp, rv) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), f AS (
  SELECT p.page_id, p.host, p.path, rh || rp AS rule, rv,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM f WHERE k = 1
"""
