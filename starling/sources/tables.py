"""Sources: points, edges, ready graphs and labels as DataFrames with checked schemas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNLABELLED = -1


def points(df: DataFrame, id_col: str, features: str | list[str]) -> DataFrame:
    """``node_id, features``: one array column, or several numeric columns put together."""
    if isinstance(features, str):
        kind = df.schema[features].dataType
        if kind.typeName() != "array" or kind.elementType.typeName() not in ("double", "float", "integer", "long", "short", "byte"):
            raise ValueError(f"features must be an array of numbers, not {kind.simpleString()}")
        column = F.col(features).cast("array<double>")
    else:
        column = F.array(*[F.col(c).cast("double") for c in features])
    return df.select(F.col(id_col).cast("long").alias("node_id"), column.alias("features"))


def edge_list(df: DataFrame, src: str, dst: str) -> DataFrame:
    """``src, dst`` as long."""
    for c in (src, dst):
        if c not in df.columns:
            raise ValueError(f"no column {c} in {df.columns}")
    return df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))


def ready_graph(adjacency: DataFrame, node: str = "node_id", neighbors: str = "neighbors") -> DataFrame:
    """Edges ``src, dst`` of a neighbour-list table; padding (negative ids) is dropped."""
    return adjacency.select(F.col(node).cast("long").alias("src"), F.explode(neighbors).cast("long").alias("dst")).where("dst >= 0")


def labels(df: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``node_id, label``; null counts as unlabelled (-1), any other integer is a class."""
    return df.select(F.col(id_col).cast("long").alias("node_id"), F.coalesce(F.col(label_col).cast("long"), F.lit(UNLABELLED)).alias("label"))


def label_points(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Every node with its label, -1 where ``known`` has none."""
    return nodes.select("node_id").join(known, "node_id", "left").select("node_id", F.coalesce("label", F.lit(UNLABELLED)).alias("label"))


def matrix(spark: SparkSession, rows: Iterable[Iterable[float]]) -> DataFrame:
    """A small in-memory matrix as points numbered from 0."""
    data = [(i, [float(x) for x in r]) for i, r in enumerate(rows)]
    if len({len(r) for _, r in data}) > 1:
        raise ValueError("rows of a matrix must be of one length")
    return spark.createDataFrame(data, "node_id long, features array<double>")
