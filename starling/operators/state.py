"""Initial state of a fit: particles, node dominance, sparse distances, weights, the stop threshold."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starling.functions.storage import written

#: Largest distance that is kept (distances are one unsigned byte in the model).
FAR = 255


@dataclass
class State:
    """``particles``: pid, home, cur, cls, strength.  ``nodes``: node_id, cls, dom, own (arrays by class).
    ``dist``: pid, node_id, d for known distances; all others are ``far``.  ``adjacency``: node_id, neighbors."""

    adjacency: DataFrame
    particles: DataFrame
    nodes: DataFrame
    dist: DataFrame
    n: int
    c: int

    @property
    def far(self) -> int:
        return min(self.n - 1, FAR)

    def mapped(self, f) -> State:
        """The same state with each changing table passed through f(table, name); the three are made side by side."""
        names = ("particles", "nodes", "dist")
        with ThreadPoolExecutor(len(names)) as side_by_side:
            return replace(self, **dict(zip(names, side_by_side.map(lambda x: f(getattr(self, x), x), names))))


def particles_init(coded: DataFrame) -> DataFrame:
    """One particle for each labelled node, numbered from 0 by ascending node; strength 1, at home.

    Nodes are dealt into ranges, numbered within each, and the sizes of the ranges before are added.
    """
    dealt = coded.where("cls <> -1").select("node_id", "cls").repartitionByRange("node_id").withColumn("part", F.spark_partition_id())
    seeds = written(dealt, "seeds")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    sizes = seeds.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    pid = F.row_number().over(Window.partitionBy("part").orderBy("node_id")) - 1 + F.col("before")
    return seeds.join(sizes, "part").select(pid.cast("long").alias("pid"), F.col("node_id").alias("home"), F.col("node_id").alias("cur"), "cls", F.lit(1.0).alias("strength"))


def nodes_init(coded: DataFrame, c: int) -> DataFrame:
    """Dominance: 1/c for each class, or all on the own class of a labelled node; nothing accumulated yet."""
    spread = F.array_repeat(F.lit(1.0 / c), c)
    own = F.transform(F.sequence(F.lit(0), F.lit(c - 1)), lambda i: F.when(i == F.col("cls"), 1.0).otherwise(0.0))
    return coded.select("node_id", "cls", F.when(F.col("cls") == -1, spread).otherwise(own).alias("dom"), F.array_repeat(F.lit(0.0), c).alias("own"))


def dist_init(particles: DataFrame) -> DataFrame:
    """A particle is at distance 0 from home; unknown distances have no row."""
    return particles.select("pid", F.col("home").alias("node_id"), F.lit(0).alias("d"))


def distance_weights(dexp: float = 2.0) -> list[float]:
    """1 / (d + 1) ** dexp for d = 0..256, worked out once so that all engines use the same bits."""
    return [1.0 / ((d + 1.0) * (d + 1.0)) if dexp == 2.0 else 1.0 / (d + 1.0) ** dexp for d in range(257)]


def stop_threshold(n: int, n_particles: int, k_nn: int, es_chk: int = 2000) -> int:
    """Checks without progress that are waited for: max(1, round(n / (P * k) * round(es_chk / 10))), halves to even."""
    if n_particles < 1 or k_nn < 1:
        raise ValueError("a fit needs labelled nodes, and a graph with edges")
    return max(1, round(n / (n_particles * k_nn) * round(es_chk * 0.1)))


def initial_state(adjacency: DataFrame, coded: DataFrame, c: int, n: int | None = None) -> State:
    particles = particles_init(coded)
    return State(adjacency, particles, nodes_init(coded, c), dist_init(particles), coded.count() if n is None else n, c)
