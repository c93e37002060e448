"""Connected components of a graph given by links, without gathering it anywhere.

First each task contracts the links it holds to a forest of stars (union-find),
which keeps the components.  Then labels are passed along the links and pointers
are doubled, one round a job, until no label changes: each node's label is the
smallest id that it can reach.  Sums over a node's links are combined before the
shuffle, and joins on a node with very many links are ones that Spark may split.
Each round's labels are written to the shared folder, so lineage stays short and
a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import prepare, settle


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the smallest node each reaches by the links (a, b)."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            return label
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node reached) that have the same components as (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = roots(len(nodes), at[: len(a)], at[len(a) :])
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x in batches:
        a, b = stars(np.concatenate([a, x["a"].to_numpy(np.int64)]), np.concatenate([b, x["b"].to_numpy(np.int64)]))
        if len(a) > 2_000_000:
            yield pd.DataFrame({"a": a, "b": b})
            a, b = a[:0], b[:0]
    yield pd.DataFrame({"a": a, "b": b})


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node with a link; ``links`` has long columns ``a`` and ``b``.

    A row with a null in either column links nothing.  Repeated links and those of a node with itself change nothing.
    """
    prepare(links.sparkSession)
    links = links.where("a <> b").mapInPandas(_contract, "a long, b long")
    both = settle(links.union(links.select("b", "a")).distinct(), "links", small=True)
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("moved")), "labels", small=True)
    while labels.where("moved").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        # the label's own label, which is as small or smaller
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("u"))
        step = labels.select("node", "label").join(near, "node").join(up, "label")
        labels = settle(step.select("node", F.least("label", "m", "u").alias("label"), (F.least("label", "m", "u") < F.col("label")).alias("moved")), "labels", small=True)
    return labels.select("node", F.col("label").alias("component"))
