"""Helpers shared by the training-data operators.

Every operator first calls :func:`pick`, which takes the columns it needs *by
position* and under names of its own, so extra columns, columns whose names
differ only in case and columns that clash with an operator's own names are
all harmless.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starling.functions.storage import new_path, prepare, written

__all__ = ["WS_CLASS", "crc_of", "fold", "new_path", "parts", "pick", "prepare", "settle"]

#: The separators of the word class ``[^\x20\x09-\x0D]+`` (fixed values).
WS_CLASS = r"[\x20\x09-\x0D]+"

def pick(df: DataFrame, **cols: str) -> DataFrame:
    """``df``'s columns ``cols[alias]`` under the given aliases, found by exact name and position."""
    names = df.columns
    missing = [c for c in cols.values() if c not in names]
    if missing:
        raise ValueError(f"no column {missing} among {names}")
    prepare(df.sparkSession)
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"_c{names.index(c)}").alias(a) for a, c in cols.items()])


def settle(df: DataFrame, tag: str, small: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    This cuts the lineage at a place that survives a lost executor, and keeps a
    costly step from running again for each of its consumers.  ``small``: see ``written``.
    """
    return written(df, f"starling-{tag}", small)


def crc_of(value: object) -> int:
    """CRC-32 of a value's decimal text, as the contracts' folds use it."""
    return zlib.crc32(str(value).encode())


def fold(col, n: int):
    """``crc32(id as text) mod n`` as a column; null for a null id."""
    return F.crc32(col.cast("string")) % n


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
