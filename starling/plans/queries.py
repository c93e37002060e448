"""The queries over the test tables, one for each operator."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starling.functions.draws import xorshift_stream
from starling.functions.storage import written
from starling.operators import graph, metrics, prep, state, step
from starling.plans.estimator import GraphLabeler, fit_runs, repeated_runs
from starling.sources import tables

FRACTION, SEED, K = 0.1, 7, 10
STEPS = 2  # step operators are shown on the state after so many steps

#: What :func:`_once` has made; clear it to time a query with all it needs.
_kept: dict[tuple, object] = {}


def _once(spark: SparkSession, key: tuple, make):
    """Tables that several queries of one session share."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return tables.points(table(spark, d, "embeddings"), "vec_id", "embedding")


def truth(spark: SparkSession, d: str) -> DataFrame:
    return tables.labels(table(spark, d, "embeddings"), "vec_id", "label")


def near(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, (d, "near"), lambda: graph.knn(vectors(spark, d), K))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, (d, "edges"), lambda: written(graph.both_ways(near(spark, d)).distinct(), "edges"))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, (d, "adjacency"), lambda: written(graph.neighbor_lists(graph.both_ways(near(spark, d))), "adjacency"))


def masked(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, (d, "masked"), lambda: written(prep.seed_mask_stratified(truth(spark, d), FRACTION, SEED), "masked"))


def classes(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, (d, "classes"), lambda: written(prep.class_dictionary(masked(spark, d)), "classes"))


def coded(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, (d, "coded"), lambda: written(prep.encode_labels(masked(spark, d), classes(spark, d)), "coded"))


def particles(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, (d, "particles"), lambda: written(state.particles_init(coded(spark, d)), "particles"))


def state_after(spark: SparkSession, d: str, steps: int) -> state.State:
    def make():
        if steps == 0:
            with ThreadPoolExecutor(1) as aside:  # labels are made ready while the graph is built
                lists = aside.submit(adjacency, spark, d)
                s = state.initial_state(None, coded(spark, d), classes(spark, d).count()).mapped(written)
                return replace(s, adjacency=lists.result())
        return step.superstep(state_after(spark, d, steps - 1), step.Params(), steps - 1, written).mapped(written)

    return _once(spark, (d, "state", steps), make)


def moves_at(spark: SparkSession, d: str) -> tuple[state.State, DataFrame]:
    s = state_after(spark, d, STEPS)
    return s, _once(spark, (d, "moves"), lambda: written(step.targets(s, step.Params(), STEPS), "moves"))


def long_form(df: DataFrame, column: str, value: str) -> DataFrame:
    """One row for each node and class, rounded."""
    return df.select("node_id", F.posexplode(column).alias("class_idx", "x")).select("node_id", "class_idx", F.round("x", 6).alias(value))


# --- preparation


def q01(spark, d):
    return prep.seed_mask_global(truth(spark, d), FRACTION, SEED)


def q02(spark, d):
    return prep.seed_mask_stratified(truth(spark, d), FRACTION, SEED)


def q03(spark, d):
    quality = prep.class_dictionary(tables.labels(table(spark, d, "labels"), "doc_id", "quality")).withColumn("source", F.lit("quality"))
    return quality.union(prep.class_dictionary(truth(spark, d)).withColumn("source", F.lit("embeddings")))


def q04(spark, d):
    back = prep.decode_labels(coded(spark, d), classes(spark, d))
    return coded(spark, d).join(back, "node_id").select("node_id", "cls", "label")


def q05(spark, d):
    part = prep.standard_scale(tables.points(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"])).withColumn("source", F.lit("part"))
    vec = prep.standard_scale(vectors(spark, d)).withColumn("source", F.lit("embeddings"))
    return part.union(vec).select("source", "node_id", F.posexplode("features").alias("i", "x")).select("source", "node_id", "i", F.round("x", 5).alias("x"))


# --- graph


def knn_by(metric, p=2):
    def run(spark, d):
        near = graph.knn(vectors(spark, d), K, metric, p)
        return near.select("src", "dst", "rank", F.round("distance", 6).alias("distance"))

    return run


def q09(spark, d):
    return edges(spark, d)


SUPPLIER_OFFSET = 10_000_000


def supply_pairs(spark, d):
    return tables.edge_list(table(spark, d, "lineitem").select("l_partkey", (F.col("l_suppkey") + SUPPLIER_OFFSET).alias("s")), "l_partkey", "s")


def q10(spark, d):
    return graph.edge_graph(supply_pairs(spark, d))


def order_graph(spark, d):
    """Customers and their order priorities: many repeated pairs, and customers without any."""
    o = table(spark, d, "orders").select("o_custkey", (F.substring("o_orderpriority", 1, 1).cast("long") - 10).alias("prio"))
    return graph.edge_graph(tables.edge_list(o, "o_custkey", "prio"))


def q11(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("node_id"))
    return graph.degrees(nodes, order_graph(spark, d))


def q11b(spark, d):
    return graph.max_degree(graph.degrees(vectors(spark, d), edges(spark, d)))


def q12(spark, d):
    return graph.padded_lists(vectors(spark, d), edges(spark, d)).select("node_id", F.array_join("neighbors", ",").alias("neighbors"))


# --- initial state


def q13(spark, d):
    return state.particles_init(coded(spark, d))


def q14(spark, d):
    n = state.nodes_init(coded(spark, d), classes(spark, d).count())
    return long_form(n, "dom", "dominance").join(long_form(n, "own", "own"), ["node_id", "class_idx"])


def q15(spark, d):
    far = min(coded(spark, d).count() - 1, state.FAR)
    return state.dist_init(particles(spark, d)).select("pid", "node_id", "d", F.lit(far).alias("far"))


def q16(spark, d):
    w = F.array(*[F.lit(x) for x in state.distance_weights()])
    return spark.range(257).select(F.col("id").alias("d"), F.get(w, F.col("id").cast("int")).alias("w"))


def q17(spark, d):
    most = state.stop_threshold(coded(spark, d).count(), particles(spark, d).count(), K)
    return spark.range(1).select(F.lit(most).cast("long").alias("stop_max"))


# --- one step, on the state after STEPS steps


STAR = step.Params(delta_v=0.4)


def star(spark: SparkSession, d: str) -> state.State:
    """Nations around their regions, one move away from every branch of a step: isolated particles (no edges in region 4),
    particles without any greedy weight (region 2 belongs to class 0 for good), and several particles at one node (the other regions)."""

    def make():
        nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), (F.col("n_regionkey") + 100).cast("long").alias("hub"))
        hubs = nations.select(F.col("hub").alias("node_id")).distinct().select("node_id", F.when(F.col("node_id") == 102, 0).otherwise(-1).alias("cls"))
        edges_ = nations.where("hub <> 104").select(F.col("node_id").alias("src"), F.col("hub").alias("dst"))
        coded_ = nations.select("node_id", (F.col("node_id") % 2).cast("int").alias("cls")).union(hubs)
        return state.initial_state(written(graph.neighbor_lists(graph.edge_graph(edges_)), "star"), written(coded_, "star"), 2).mapped(written)

    return _once(spark, (d, "star"), make)


def on_both(f):
    """A step operator on the state after STEPS steps of the embeddings, and on the star."""

    def run(spark, d):
        s = star(spark, d)
        ours = f(*moves_at(spark, d), step.Params(), STEPS).withColumn("fixture", F.lit("embeddings"))
        return ours.union(f(s, step.targets(s, STAR, 0), STAR, 0).withColumn("fixture", F.lit("star")))

    return run


q18 = on_both(lambda s, m, p, it: step.mode_draw(s, p, it).select("pid", "cur", "greedy", F.size("neighbors").alias("degree")))
q21 = on_both(lambda s, m, p, it: step.roulette_pick(step.cumulative_slices(step.greedy_weights(s, p, it)), p, it))
q23 = on_both(lambda s, m, p, it: m.select("pid", (F.col("greedy") & ~F.col("picked")).alias("fell_back"), "target"))
q24 = on_both(lambda s, m, p, it: long_form(step.dominance_update(s, m, p), "dom", "dominance"))


def q19(spark, d):
    w = step.greedy_weights(state_after(spark, d, STEPS), step.Params(), STEPS)
    return w.select("pid", "pos", "nb", F.round("w", 6).alias("w"))


def q20(spark, d):
    s = step.cumulative_slices(step.greedy_weights(state_after(spark, d, STEPS), step.Params(), STEPS))
    return s.select("pid", F.posexplode("slices").alias("pos", "x")).select("pid", "pos", F.round("x", 6).alias("slice"))


def q22(spark, d):
    _, m = moves_at(spark, d)
    return m.where("not greedy").select("pid", "target")


def q25(spark, d):
    s, m = moves_at(spark, d)
    out = None
    for deltap in (1.0, 0.5):
        p = step.Params(deltap=deltap)
        x = step.strength_update(m, step.dominance_update(s, m, p), p).select(F.lit(deltap).alias("deltap"), "pid", F.round("strength", 6).alias("strength"))
        out = x if out is None else out.union(x)
    return out


def q26(spark, d):
    s, m = moves_at(spark, d)
    return step.distance_relax(s, m)


def _moved(spark, d):
    s, m = moves_at(spark, d)
    nodes = step.dominance_update(s, m, step.Params())
    return s, nodes, step.strength_update(m, nodes, step.Params())


def q27(spark, d):
    _, nodes, moved = _moved(spark, d)
    return long_form(step.owndeg_accumulate(nodes, moved), "own", "own")


def q27b(spark, d):
    _, nodes, moved = _moved(spark, d)
    return long_form(step.owndeg_normalize(step.owndeg_accumulate(nodes, moved)), "own", "own")


def q28(spark, d):
    s, _, moved = _moved(spark, d)
    return step.shock_move(s, moved).select("pid", "home", "cur", "cls", F.round("strength", 6).alias("strength"))


def after_steps(n):
    def run(spark, d):
        s = state_after(spark, d, n)
        p = s.particles.select(F.lit("particle").alias("part"), F.col("pid").alias("a"), F.col("cur").alias("b"), F.round("strength", 6).alias("x"))
        own = long_form(s.nodes, "own", "x").select(F.lit("own"), F.col("node_id"), F.col("class_idx").cast("long"), "x")
        dom = long_form(s.nodes, "dom", "x").select(F.lit("dominance"), F.col("node_id"), F.col("class_idx").cast("long"), "x")
        dist = s.dist.select(F.lit("distance"), "pid", "node_id", F.col("d").cast("double"))
        return p.union(own).union(dom).union(dist)

    return run


def q30(spark, d):
    return step.mean_max_potential(state_after(spark, d, STEPS + 1).nodes).select(F.round("potential", 6).alias("potential"))


def predicted(spark, d):
    return prep.decode_labels(step.hard_labels(state_after(spark, d, STEPS + 1).nodes), classes(spark, d))


def q31(spark, d):
    return predicted(spark, d)


def q32(spark, d):
    return xorshift_stream(spark, 50).select("i", "x", F.round("u", 9).alias("u"))


# --- evaluation


def pairs(spark, d):
    return metrics.scored(predicted(spark, d), truth(spark, d), masked(spark, d))


def q33(spark, d):
    return metrics.accuracy(pairs(spark, d)).select(F.round("accuracy", 6).alias("accuracy"))


def q34(spark, d):
    return metrics.confusion(pairs(spark, d))


def q35(spark, d):
    r = metrics.class_report(pairs(spark, d))
    return r.select("name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("long").alias("support"))


def event_runs(spark, d):
    """Events as if each were a timed run of one of a few modes."""
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("mode"), F.col("value").alias("seconds"), (F.pmod("user_id", F.lit(100)) / 100).alias("accuracy"))


def q36(spark, d):
    r = metrics.run_summary(event_runs(spark, d))
    return r.select("mode", "runs", *[F.round(c, 5).alias(c) for c in ("mean_seconds", "std_seconds", "mean_accuracy", "std_accuracy")])


def q37(spark, d):
    return metrics.speedups(metrics.run_summary(event_runs(spark, d))).select("slow", "fast", F.round("ratio", 5).alias("ratio"))


# --- fits: a few steps, and until they stop


def _fit(spark, d, mode, seed=None, **more):
    model = GraphLabeler(mode, seed)
    model.set_graph(edges(spark, d), vectors(spark, d), K)
    return model, model.fit_predict(masked(spark, d), **more)


def first_steps(mode, n, seed=None):
    """What a fit's kernel has made of dominance and own shares after n steps."""

    def run(spark, d):
        r = _fit(spark, d, mode, seed, max_iter=n, early_stop=False)[0].result
        return long_form(r, "dom", "dominance").join(long_form(r, "own", "own"), ["node_id", "class_idx"]).join(r.select("node_id", "cls"), "node_id")

    return run


def q38(spark, d):
    return _fit(spark, d, "sequential")[1]


def q39(spark, d):
    return _fit(spark, d, "batch", seed=1)[1]


def q40(spark, d):
    """How long fits take to stop: iterations for three patience settings, side by side."""
    out = None
    for most in (1, 3, 5):
        runs = coded(spark, d).withColumn("run", F.lit(most))
        r = fit_runs(edges(spark, d), runs, classes(spark, d).count(), {most: 1}, "batch", most, max_iter=20_000)
        r = r.groupBy("run").agg(F.max("iterations").alias("iterations")).withColumnRenamed("run", "stop_max")
        out = r if out is None else out.union(r)
    return out


def q41(spark, d):
    return repeated_runs(edges(spark, d), truth(spark, d), K).select("run", F.round("accuracy", 6).alias("accuracy"), "iterations")


def q42(spark, d):
    """Soft labels: shares of each class by random visits, after a fit."""
    model, _ = _fit(spark, d, "batch", seed=1)
    r = model.result
    return long_form(r, "dom", "dominance").join(long_form(r, "own", "own"), ["node_id", "class_idx"])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-neighbour graph, a tenth of the labels, a sequential fit: predicted labels of all nodes."""
    model = GraphLabeler("sequential").build_graph(vectors(spark, d), K)
    return model.fit_predict(prep.seed_mask_stratified(truth(spark, d), FRACTION, SEED))


QUERIES = {
    "q01_seed_mask_global": q01, "q02_seed_mask_stratified": q02, "q03_class_dictionary": q03, "q04_label_encode_decode": q04, "q05_standard_scale": q05,
    "q06_knn_euclid": knn_by("minkowski", 2), "q07_knn_manhattan": knn_by("manhattan"), "q08_knn_cosine": knn_by("cosine"), "q08b_knn_chebyshev": knn_by("chebyshev"), "q08c_knn_minkowski3": knn_by("minkowski", 3),
    "q09_knn_symmetric": q09, "q10_edge_graph": q10, "q11_degree": q11, "q11b_max_degree": q11b, "q12_neighbor_list_padded": q12,
    "q13_particles_init": q13, "q14_dominance_init": q14, "q15_distance_init": q15, "q16_distance_weights": q16, "q17_stop_threshold": q17,
    "q18_mode_draw": q18, "q19_greedy_weights": q19, "q20_cumulative_slices": q20, "q21_roulette_pick": q21, "q22_random_walk": q22, "q23_zero_mass_fallback": q23,
    "q24_dominance_update": q24, "q25_strength_update": q25, "q26_distance_relax": q26, "q27_owndeg_accumulate": q27, "q27b_owndeg_normalize": q27b, "q28_shock_move": q28,
    "q29_superstep_1": after_steps(1), "q29_superstep_3": after_steps(3), "q30_mean_max_potential": q30, "q31_hard_labels": q31, "q32_xorshift_stream": q32,
    "q33_accuracy": q33, "q34_confusion": q34, "q35_class_report": q35, "q36_run_summary": q36, "q37_speedups": q37,
    "q38_fit_predict_sequential": q38, "q38b_sequential_steps": first_steps("sequential", 2), "q39_fit_predict_batch": q39, "q39b_batch_steps": first_steps("batch", 3, 1), "q40_early_stop_trace": q40, "q41_repeated_runs": q41, "q42_soft_labels": q42,
}
