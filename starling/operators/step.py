"""One synchronous step of all particles as DataFrame operators.

Every particle reads the state before the step; all updates of a node are then
added up.  Reductions of one node by several particles all start from the same
row, so dominance may fall below zero while its sum stays; isolated particles
stay where they are.  Where the order of additions matters for the last bit they
are folds over lists sorted by particle.

The list of a node's visitors, or of a particle's neighbours, is the one thing
held per row; it is bounded by the particles at a node and by the degree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starling.functions.draws import PURPOSES, uniform
from starling.functions.folds import fold_sum
from starling.operators.state import State, distance_weights


@dataclass(frozen=True)
class Params:
    p_grd: float = 0.5
    delta_v: float = 0.1
    deltap: float = 1.0
    dexp: float = 2.0
    seed: int = 1


def draw(params: Params, it: int, purpose: str) -> Column:
    return uniform(str(params.seed), str(it), "pid", str(PURPOSES[purpose]))


def mode_draw(s: State, params: Params, it: int) -> DataFrame:
    """Particles that can move (valid node, class and neighbours), and whether each is greedy."""
    p = s.particles.where((F.col("cls") >= 0) & (F.col("cls") < s.c))
    moving = p.join(s.adjacency.withColumnRenamed("node_id", "cur"), "cur")
    return moving.withColumn("greedy", draw(params, it, "mode") < params.p_grd)


def greedy_weights(s: State, params: Params, it: int) -> DataFrame:
    """``pid, pos, nb, w``: dominance of the particle's class at each neighbour times the weight of its distance."""
    lut = F.expr(f"array({', '.join(f'{x!r}D' for x in distance_weights(params.dexp))})")  # one call for all literals
    near = mode_draw(s, params, it).where("greedy").select("pid", "cls", F.posexplode("neighbors").alias("pos", "nb"))
    near = near.join(s.nodes.select(F.col("node_id").alias("nb"), "dom"), "nb")
    near = near.join(s.dist.withColumnRenamed("node_id", "nb"), ["pid", "nb"], "left")
    return near.select("pid", "pos", "nb", (F.get("dom", F.col("cls")) * F.get(lut, F.coalesce("d", F.lit(s.far)))).alias("w"))


def cumulative_slices(weights: DataFrame) -> DataFrame:
    """``pid, nbs, slices, total``: running sums of the weights in neighbour order."""
    in_order = Window.partitionBy("pid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = weights.withColumn("slice", F.sum("w").over(in_order)).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("pos", "nb", "slice"))).alias("a"))
    return rows.select("pid", F.col("a.nb").alias("nbs"), F.col("a.slice").alias("slices"), F.element_at("a.slice", -1).alias("total"))


def roulette_pick(slices: DataFrame, params: Params, it: int) -> DataFrame:
    """``pid, pick``: the first neighbour whose slice reaches the draw; null where all weights are zero."""
    r = draw(params, it, "pick") * F.col("total")
    below = slices.withColumn("r", r).withColumn("i", F.size(F.filter("slices", lambda x: x < F.col("r"))))
    pick = F.get("nbs", F.least(F.col("i"), F.size("nbs") - 1))
    return below.select("pid", F.when(F.col("total") > 0, pick).alias("pick"))


def targets(s: State, params: Params, it: int) -> DataFrame:
    """``pid, cur, cls, strength, greedy, picked, target``; ``picked``: the move was greedy to the end.

    A greedy particle without any weight falls back to a random neighbour.
    """
    picks = roulette_pick(cumulative_slices(greedy_weights(s, params, it)), params, it)
    moving = mode_draw(s, params, it).join(picks, "pid", "left")
    at_random = F.get("neighbors", F.floor(draw(params, it, "walk") * F.size("neighbors")).cast("int"))
    return moving.select("pid", "cur", "cls", "strength", "greedy", F.col("pick").isNotNull().alias("picked"), F.coalesce("pick", at_random).alias("target"))


def dominance_update(s: State, moves: DataFrame, params: Params) -> DataFrame:
    """``nodes`` after the step: at unlabelled targets each class loses up to the particle's step, its own gains the sum."""
    step = F.col("strength") * F.lit(params.delta_v / (s.c - 1))
    hits = moves.select(F.col("target").alias("node_id"), F.struct("pid", F.col("cls").alias("k"), step.alias("step")).alias("v"))
    hits = hits.groupBy("node_id").agg(F.array_sort(F.collect_list("v")).alias("visits"))
    n = s.nodes.join(hits, "node_id", "left")
    gain = F.transform("visits", lambda v: F.struct(v["k"].alias("k"), v["step"].alias("step"), fold_sum(F.transform("dom", lambda x: F.least(x, v["step"]))).alias("sum")))
    n = n.withColumn("visits", F.when(F.col("cls") == -1, gain))

    def after(x: Column, i: Column) -> Column:
        less = F.aggregate("visits", x, lambda a, v: a - F.least(x, v["step"]))
        return F.aggregate("visits", less, lambda a, v: F.when(v["k"] == i, a + v["sum"]).otherwise(a))

    return n.select("node_id", "cls", F.when(F.col("visits").isNull(), F.col("dom")).otherwise(F.transform("dom", after)).alias("dom"), "own")


def strength_update(moves: DataFrame, nodes: DataFrame, params: Params) -> DataFrame:
    """Moves with the dominance ``dom`` found at the target after the update, and the strength that follows from it."""
    at = moves.join(nodes.select(F.col("node_id").alias("target"), "dom"), "target")
    found = F.get("dom", F.col("cls"))
    new = found if params.deltap == 1.0 else F.col("strength") + (found - F.col("strength")) * F.lit(params.deltap)
    return at.withColumn("strength", new)


def distance_relax(s: State, moves: DataFrame) -> DataFrame:
    """``dist`` after the step: a target is no farther than one more than the place left."""
    known = lambda c: s.dist.select("pid", F.col("node_id").alias(c), F.col("d").alias(f"d_{c}"))
    m = moves.join(known("cur"), ["pid", "cur"], "left").join(known("target"), ["pid", "target"], "left")
    here, there = F.coalesce("d_cur", F.lit(s.far)), F.coalesce("d_target", F.lit(s.far))
    new = m.where((here < 255) & (there > here + 1)).select("pid", F.col("target").alias("node_id"), (here + 1).cast("int").alias("d"))
    return s.dist.union(new).groupBy("pid", "node_id").agg(F.min("d").alias("d"))


def owndeg_accumulate(nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """``nodes`` with the new strengths of non-greedy visitors added to ``own`` of their class."""
    adds = moved.where(~F.col("picked")).select(F.col("target").alias("node_id"), F.struct("pid", F.col("cls").alias("k"), F.col("strength").alias("w")).alias("v"))
    adds = adds.groupBy("node_id").agg(F.array_sort(F.collect_list("v")).alias("adds"))
    n = nodes.join(adds, "node_id", "left")
    own = F.transform("own", lambda x, i: F.aggregate("adds", x, lambda a, v: F.when(v["k"] == i, a + v["w"]).otherwise(a)))
    return n.select("node_id", "cls", "dom", F.when(F.col("adds").isNull(), F.col("own")).otherwise(own).alias("own"))


def shock_move(s: State, moved: DataFrame) -> DataFrame:
    """``particles`` after the step: a particle enters its target if its class is (one of) the largest there."""
    enters = F.get("dom", F.col("cls")) == F.array_max("dom")
    m = moved.select("pid", F.when(enters, F.col("target")).otherwise(F.col("cur")).alias("at"), F.col("strength").alias("new"))
    return s.particles.join(m, "pid", "left").select("pid", "home", F.coalesce("at", "cur").alias("cur"), "cls", F.coalesce("new", "strength").alias("strength"))


def superstep(s: State, params: Params, it: int, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> State:
    """The state after step ``it``; still lazy, see ``plans.estimator`` for runs of steps.

    ``keep`` may write what more than one of its tables comes from (one row a particle), so that each move is worked out once.
    """
    moves = keep(targets(s, params, it), "moves")
    nodes = dominance_update(s, moves, params)
    moved = keep(strength_update(moves, nodes, params), "moved")
    return State(s.adjacency, shock_move(s, moved), owndeg_accumulate(nodes, moved), distance_relax(s, moves), s.n, s.c)


def mean_max_potential(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.avg(F.array_max("dom")).alias("potential"))


def hard_labels(nodes: DataFrame) -> DataFrame:
    """``node_id, cls``: the first class with the largest dominance; labelled nodes keep theirs."""
    first = (F.array_position("dom", F.array_max("dom")) - 1).cast("int")
    return nodes.select("node_id", F.when(F.col("cls") == -1, first).otherwise(F.col("cls")).alias("cls"))


def owndeg_normalize(nodes: DataFrame) -> DataFrame:
    """``node_id, own``: shares of each class; rows without any stay zero."""
    total = fold_sum(F.col("own"))
    d = nodes.select("node_id", "own", total.alias("t"))
    return d.select("node_id", F.transform("own", lambda x: x / F.when(F.col("t") == 0, 1.0).otherwise(F.col("t"))).alias("own"))
