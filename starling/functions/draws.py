"""Seeded random numbers: hash-uniform columns, and the xorshift32 stream.

Hash-uniform numbers depend on (seed, step, particle, purpose) alone, all integers, so a lost
task draws the same again, and any SQL engine can draw them too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the generator: start, shifts, largest word.
XORSHIFT_SEED = 123456789
XORSHIFT_SHIFTS = (13, 17, 5)
XORSHIFT_MAX = 4294967295


def hash_key(*parts: Column) -> Column:
    """MD5 of the parts as hexadecimal text: a random order of rows, the same in every engine."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


#: Factors of the mixing of 32-bit words; products stay below 2**63, so no engine overflows.
MIX = (0x45D9F3B, 0x2C1B3C6D)
WORD = 0xFFFFFFFF
PURPOSES = {"mode": 0, "pick": 1, "walk": 2}


def uniform(*parts: str) -> Column:
    """A number in [0, 1) that integers decide: each in its turn is mixed into a 32-bit word.  Parts are SQL, as plans of many calls take long to put together."""
    x = f"(((h ^ (v & {WORD}L)) * {MIX[0]}L) & {WORD}L)"
    y = f"((({x} ^ shiftright({x}, 15)) * {MIX[1]}L) & {WORD}L)"
    words = ", ".join(f"CAST({p} AS BIGINT)" for p in parts)
    return F.expr(f"CAST(aggregate(array({words}), 0L, (h, v) -> {y} ^ shiftright({y}, 13)) AS DOUBLE) / 4294967296D")


def uniform_sql(*parts: str) -> str:
    x = f"(xor(h, v & {WORD}) * {MIX[0]}) & {WORD}"
    y = f"(xor({x}, ({x}) >> 15) * {MIX[1]}) & {WORD}"
    return f"(list_reduce([{', '.join(parts)}]::BIGINT[], lambda h, v: xor({y}, ({y}) >> 13), 0::BIGINT)::DOUBLE / 4294967296.0)"


def xorshift32(x: int) -> int:
    a, b, c = XORSHIFT_SHIFTS
    x ^= x << a & XORSHIFT_MAX
    x ^= x >> b
    return x ^ (x << c & XORSHIFT_MAX)


def xorshift_stream(spark: SparkSession, n: int, seed: int = XORSHIFT_SEED) -> DataFrame:
    """``i, x, u``: the first n numbers; each depends on the one before, so they are made by a recursive query."""
    a, b, c = XORSHIFT_SHIFTS
    s1 = f"(x ^ (shiftleft(x, {a}) & {XORSHIFT_MAX}L))"
    s2 = f"({s1} ^ shiftright({s1}, {b}))"
    step = f"({s2} ^ (shiftleft({s2}, {c}) & {XORSHIFT_MAX}L))"
    return spark.sql(f"""
        WITH RECURSIVE s(i, x) MAX RECURSION LEVEL {n + 1} AS (
          SELECT 0, {seed}L UNION ALL SELECT i + 1, {step} FROM s WHERE i < {n})
        SELECT i, x, x / {float(XORSHIFT_MAX)}D AS u FROM s WHERE i > 0""")
