"""The estimator: a graph once, any number of fits on it."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.functions.draws import XORSHIFT_SEED
from starling.functions.kernels import CHECK_EVERY, fit_column
from starling.functions.storage import written
from starling.operators import graph, prep, state, step
from starling.sources.tables import UNLABELLED, ready_graph

MODES = ("auto", "sequential", "batch", "steps")

#: Largest graph for a fit in one task: its edges are broadcast as one row of 16 bytes an edge.
MAX_EDGES = 20_000_000


class GraphLabeler:
    """Spreads a few known labels over a graph by competing and cooperating particles.

    ``mode``: "sequential" (particles move one by one; the default, "auto"), "batch" (all at
    once), both in one task; or "steps" ("batch" with each step as a DataFrame plan, for
    graphs that fit no task, with a small ``max_iter``).
    """

    def __init__(self, mode: str = "auto", seed: int | None = None):
        if isinstance(mode, str) and mode.lower() not in MODES:
            warnings.warn(f"unknown mode {mode!r}; using auto", stacklevel=2)
        mode = mode.lower() if isinstance(mode, str) and mode.lower() in MODES else "auto"
        self.mode = "sequential" if mode == "auto" else mode
        self.seed = seed
        self.edges: DataFrame | None = None
        self.nodes: DataFrame | None = None
        self.k_nn: int | None = None
        self.result: DataFrame | None = None
        self.classes: DataFrame | None = None

    def build_graph(self, points: DataFrame, k_nn: int = 10, metric: str | Callable = "minkowski", p: float = 2) -> GraphLabeler:
        """Exact k-nearest-neighbour graph of ``points`` (``node_id, features``)."""
        self.nodes, self.k_nn = points.select("node_id"), k_nn
        self.edges = written(graph.knn_graph(points, k_nn, metric, p), "edges")
        return self

    def set_graph(self, edges: DataFrame, nodes: DataFrame | None = None, k_nn: int | None = None) -> GraphLabeler:
        """A ready graph: edges ``src, dst`` in any direction, or a table ``node_id, neighbors``; ``nodes`` adds isolated ones."""
        if "neighbors" in edges.columns:
            nodes = edges.select("node_id") if nodes is None else nodes
            edges = ready_graph(edges)
        self.edges = written(graph.edge_graph(edges), "edges")
        self.nodes = (self.edges.select(F.col("src").alias("node_id")).distinct() if nodes is None else nodes).select("node_id")
        self.k_nn = k_nn or graph.max_degree(graph.degrees(self.nodes, self.edges)).first()[0]
        return self

    def fit_predict(self, labels: DataFrame, p_grd: float = 0.5, delta_v: float = 0.1, deltap: float = 1.0, dexp: float = 2.0, max_iter: int = 500_000, early_stop: bool = True, es_chk: int = 2000) -> DataFrame:
        """``node_id, label`` of every node; ``labels`` (``node_id, label``) has -1 or no row for unknown ones.

        Afterwards ``result`` has ``node_id, cls, dom, own, iterations`` too, and ``classes`` the dictionary.
        """
        if self.edges is None:
            raise ValueError("build_graph or set_graph comes before fit_predict")
        if labels.groupBy("node_id").count().where("count > 1").limit(1).count():
            raise ValueError("a node has more than one row of labels")
        known = self.nodes.join(labels, "node_id", "left").select("node_id", F.coalesce("label", F.lit(UNLABELLED)).alias("label"))
        self.classes = written(prep.class_dictionary(known), "classes")
        c = self.classes.count()
        if c < 2:
            warnings.warn("fewer than two classes: labels are returned as they are", stacklevel=2)
            return labels
        coded = written(prep.encode_labels(known, self.classes), "coded")
        n, n_particles = coded.count(), coded.where("cls <> -1").count()
        most = state.stop_threshold(n, n_particles, self.k_nn, es_chk)
        if self.mode == "steps":
            self.result = self._by_steps(coded, c, n, most, p_grd, delta_v, deltap, dexp, max_iter, early_stop)
        else:
            runs = coded.withColumn("run", F.lit(0))
            self.result = written(fit_runs(self.edges, runs, c, {0: self.seed}, self.mode, most, p_grd, delta_v, deltap, dexp, max_iter, early_stop), "fit")
        return prep.decode_labels(self.result.select("node_id", "cls"), self.classes)

    def _by_steps(self, coded, c, n, most, p_grd, delta_v, deltap, dexp, max_iter, early_stop) -> DataFrame:
        params = step.Params(float(p_grd), float(delta_v), float(deltap), float(dexp), 1 if self.seed is None else self.seed)
        s = state.initial_state(written(graph.neighbor_lists(self.edges), "adjacency"), coded, c, n)
        s, it, best, idle = s.mapped(written), -1, 0.0, 0
        for it in range(max_iter):
            s = step.superstep(s, params, it, written).mapped(written)  # each step's tables end the lineage
            if early_stop and it % CHECK_EVERY == 0:
                potential = step.mean_max_potential(s.nodes).first()[0]
                best, idle = (potential, 0) if potential > best else (best, idle + 1)
                if idle > most:
                    break
        hard = step.hard_labels(s.nodes)
        return s.nodes.select("node_id", "dom").join(hard, "node_id").join(step.owndeg_normalize(s.nodes), "node_id").select("node_id", "cls", "dom", "own", F.lit(it + 1).alias("iterations"))


def fit_runs(edges: DataFrame, coded: DataFrame, c: int, seeds: dict[int, int | None], mode: str, most: int, p_grd: float = 0.5, delta_v: float = 0.1, deltap: float = 1.0, dexp: float = 2.0, max_iter: int = 500_000, early_stop: bool = True) -> DataFrame:
    """Several fits on one graph side by side, one task each; ``coded`` has ``run, node_id, cls`` of every node.

    ``run, node_id, cls, dom, own, iterations, seconds``.  A graph whose fit is to converge has to fit in
    one task: more than MAX_EDGES edges are an error (mode "steps" takes any number).
    """
    spark = edges.sparkSession
    if edges.count() > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges; mode 'steps' takes any number")
    order = sorted(seeds)
    usual = XORSHIFT_SEED if mode == "sequential" else 1
    at = lambda values: F.create_map(*[F.lit(x) for run, v in zip(order, values) for x in (run, v)])[F.col("run")]
    every = F.array_sort(F.collect_list(F.struct("node_id", F.col("cls").cast("long").alias("cls"))))
    runs = coded.groupBy("run").agg(every.alias("v")).select("run", "v", at([usual if seeds[r] is None else seeds[r] for r in order]).cast("long").alias("seed"))
    # a place of its own for each run, so that neither hashing nor coalescing puts fits behind each other
    runs = runs.withColumn("place", at(list(range(len(order))))).repartitionById(len(order), F.col("place"))
    graph_row = edges.agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("e"))  # one row of a checked size
    fit = fit_column(spark, mode, c, state.distance_weights(float(dexp)), most, early_stop, float(p_grd), float(delta_v), float(deltap), max_iter, F.col("v.node_id"), F.col("v.cls"), F.col("e.src"), F.col("e.dst"), F.col("seed"))
    done = runs.join(F.broadcast(graph_row)).select("run", F.col("v.node_id").alias("ids"), fit.alias("f"))
    rows = done.select("run", "f.iterations", "f.seconds", F.inline(F.arrays_zip(F.col("ids").alias("node_id"), F.col("f.cls").alias("cls"), F.col("f.dom").alias("dom"), F.col("f.own").alias("own"))))
    return rows.select(F.col("run").cast("int").alias("run"), "node_id", "cls", "dom", "own", "iterations", "seconds")


def repeated_runs(edges: DataFrame, truth: DataFrame, k_nn: int, n_runs: int = 10, fraction: float = 0.1, mode: str = "batch", es_chk: int = 2000, **params) -> DataFrame:
    """``run, accuracy, seconds, iterations`` of fits with different seed masks, all at once; ``truth``: ``node_id, label``."""
    classes = prep.class_dictionary(truth)
    masks = prep.seed_masks_global(truth, fraction, n_runs)
    coded = masks.join(classes, "label", "left").select("run", "node_id", F.coalesce("idx", F.lit(-1)).alias("cls"))
    n = truth.count()
    most = state.stop_threshold(n, max(1, int(n * fraction)), k_nn, es_chk)
    coded = written(coded, "masks")
    out = written(fit_runs(edges, coded, classes.count(), {r: r + 1 for r in range(n_runs)}, mode, most, **params), "runs")
    real = truth.join(classes, "label").select("node_id", F.col("idx").alias("real"))
    hidden = coded.where("cls = -1").select("run", "node_id")
    d = out.join(hidden, ["run", "node_id"]).join(real, "node_id")
    return d.groupBy("run").agg(F.avg((F.col("cls") == F.col("real")).cast("double")).alias("accuracy"), F.max("seconds").alias("seconds"), F.max("iterations").alias("iterations"))
