"""Ordered sums over arrays: the same bits in every engine, which plain sums don't promise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

