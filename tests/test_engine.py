"""Hand-worked graphs, invariants and error paths of the engine."""

import random
import threading

import numpy as np
import pyarrow as pa
import pytest

from starling.functions.draws import XORSHIFT_SEED, xorshift32
from starling.operators import graph, prep, state, step
from starling.plans import queries
from starling.plans.estimator import GraphLabeler, fit_runs, repeated_runs
from starling.sources import tables


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def csr(n, pairs):
    nb = [set() for _ in range(n)]
    for a, b in pairs:
        if a != b:
            nb[a].add(b)
            nb[b].add(a)
    flat = [j for x in nb for j in sorted(x)]
    return np.cumsum([0, *map(len, nb)]), np.array(flat, dtype=np.int64)


def plain_sequential(n, pairs, cls, c, iterations):
    """The sequential rules written down once more, as plainly as possible."""
    nbs = [[] for _ in range(n)]
    begin, flat = csr(n, pairs)
    for i in range(n):
        nbs[i] = list(flat[begin[i] : begin[i + 1]])
    dom = [[1 / c] * c if k == -1 else [float(i == k) for i in range(c)] for k in cls]
    own = [[0.0] * c for _ in range(n)]
    ps = [{"at": i, "k": k, "s": 1.0, "d": {i: 0}} for i, k in enumerate(cls) if k != -1]
    x = XORSHIFT_SEED

    def word():
        nonlocal x
        x = xorshift32(x)
        return x

    def dist(p, j):
        return p["d"].get(j, min(n - 1, 255))

    for _ in range(iterations):
        for p in ps:
            nb, k = nbs[p["at"]], p["k"]
            if not nb:
                continue
            choice, greedy = None, word() / 4294967295 < 0.5
            if greedy:
                sums, total = [], 0.0
                for j in nb:
                    total += dom[j][k] / ((dist(p, j) + 1.0) * (dist(p, j) + 1.0))
                    sums.append(total)
                if total > 0:
                    r = word() / 4294967295 * total
                    choice = next((j for j, v in zip(nb, sums) if r <= v), nb[0])
            random_walk = choice is None
            if random_walk:
                choice = nb[word() % len(nb)]
            if cls[choice] == -1:
                stepsize = p["s"] * (0.1 / (c - 1))
                cuts = [min(v, stepsize) for v in dom[choice]]
                dom[choice] = [v - q for v, q in zip(dom[choice], cuts)]
                total = 0.0
                for q in cuts:
                    total += q
                dom[choice][k] += total
            p["s"] = dom[choice][k]
            if dist(p, p["at"]) < 255 and dist(p, choice) > dist(p, p["at"]) + 1:
                p["d"][choice] = dist(p, p["at"]) + 1
            if random_walk:
                own[choice][k] += p["s"]
            if dom[choice][k] == max(dom[choice]):
                p["at"] = choice
    return np.array(dom), np.array(own)


def test_xorshift_known_numbers(spark):
    x, seen = XORSHIFT_SEED, []
    for _ in range(5):
        x = xorshift32(x)
        seen.append(x)
    assert seen == [2714967881, 2238813396, 1250077441, 3820100336, 3177519686]


def fit(spark, n, pairs, cls, c, mode, iterations, **more):
    """Classes, dominance and own shares of nodes 0 to n - 1."""
    edges = graph.edge_graph(spark.createDataFrame(pairs, "src long, dst long"))
    coded = spark.createDataFrame([(0, i, int(k)) for i, k in enumerate(cls)], "run int, node_id long, cls int")
    rows = fit_runs(edges, coded, c, {0: None}, mode, 1, max_iter=iterations, early_stop=False, **more).orderBy("node_id").collect()
    assert [r.node_id for r in rows] == list(range(n)) and {r.iterations for r in rows} == {iterations}
    return [r.cls for r in rows], np.array([r.dom for r in rows]), np.array([r.own for r in rows])


@pytest.mark.parametrize("seed", range(6))
def test_sequential_equals_plain_rules(spark, seed):
    r = random.Random(seed)
    n, c = r.randint(5, 25), r.randint(2, 4)
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(3 * n)]
    cls = np.array([r.choice([-1, -1, r.randrange(c)]) for _ in range(n)])
    cls[:c] = range(c)
    hard, dom, own = fit(spark, n, pairs, cls, c, "sequential", 60)
    want, visits = plain_sequential(n, pairs, cls, c, 60)
    total = np.cumsum(visits, axis=1)[:, -1:]
    assert np.array_equal(dom, want) and np.array_equal(own, visits / np.where(total == 0, 1, total))
    assert hard == np.where(cls == -1, want.argmax(1), cls).tolist()


def test_many_walkers_equal_plain_rules(spark):
    """More walkers than are looked at together, isolated ones among them, each with more distances than its first table takes."""
    r = random.Random(11)
    n, c = 260, 3
    pairs = [(r.randrange(n - 10), r.randrange(n - 10)) for _ in range(900)]
    cls = np.array([i % c if i % 3 == 0 or i >= n - 5 else -1 for i in range(n)])
    _, dom, own = fit(spark, n, pairs, cls, c, "sequential", 150)
    want, visits = plain_sequential(n, pairs, cls, c, 150)
    total = np.cumsum(visits, axis=1)[:, -1:]
    assert np.array_equal(dom, want) and np.array_equal(own, visits / np.where(total == 0, 1, total))


@pytest.mark.parametrize("deltap", [1.0, 0.5])
def test_batch_equals_the_steps_of_the_plan(spark, deltap):
    """The kernel and the DataFrame operators: the same bits, isolated nodes and labelled neighbours included."""
    r = random.Random(8)
    n, c = 30, 3
    pairs = [(r.randrange(n - 2), r.randrange(n - 2)) for _ in range(40)]
    lab = spark.createDataFrame([(i, i % c) for i in [*range(0, n, 4), n - 1]], "node_id long, label long")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node_id long")
    got = []
    for mode in ("batch", "steps"):
        model = GraphLabeler(mode, seed=5).set_graph(frame(spark, pairs), nodes, 4)
        model.fit_predict(lab, deltap=deltap, delta_v=0.9, max_iter=2, early_stop=False)
        got.append({x.node_id: (x.cls, x.dom, x.own, x.iterations) for x in model.result.collect()})
    assert got[0] == got[1] and any(min(x[1]) < 0 for x in got[0].values())


@pytest.mark.parametrize("mode", ["sequential", "batch"])
def test_invariants(spark, mode):
    r = random.Random(3)
    n, c = 600, 3  # more than one page of distances
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(1800)]
    cls = np.array([i if i < c else -1 for i in range(n)])
    _, dom, own = fit(spark, n, pairs, cls, c, mode, 200)
    assert np.allclose(dom.sum(1), 1)
    assert np.array_equal(dom[:c], np.eye(c))
    if mode == "sequential":
        assert (dom >= 0).all()
    assert np.allclose(np.where(own.sum(1) > 0, own.sum(1), 1), 1)


def test_two_labelled_neighbours_refuse_each_other(spark):
    for mode in ("sequential", "batch"):
        _, dom, own = fit(spark, 2, [(0, 1)], [0, 1], 2, mode, 20)
        assert np.array_equal(dom, np.eye(2)) and not own.any()


def test_fits_refuse_odd_input(spark):
    lab = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "node_id long, label long")
    with pytest.raises(ValueError):
        GraphLabeler().set_graph(frame(spark, [(0, 1)])).fit_predict(lab)
    with pytest.raises(Exception, match="no node"):
        fit(spark, 2, [(0, 9)], [0, 1], 2, "batch", 1)


def test_batch_collisions_add_up_below_zero(spark):
    """Two particles of class 1 hit the hub at once: both reduce the same row."""
    adj = graph.neighbor_lists(graph.edge_graph(frame(spark, [(0, 1), (0, 2)])))
    coded = spark.createDataFrame([(0, -1), (1, 1), (2, 1), (3, 0)], "node_id long, cls int")
    s = state.initial_state(adj, coded, 2)
    hub = spark.createDataFrame([(0, -1, [0.02, 0.98], [0.0, 0.0])], "node_id long, cls int, dom array<double>, own array<double>")
    s.nodes = s.nodes.where("node_id <> 0").union(hub)
    p = step.Params(p_grd=0.0)
    moves = step.targets(s, p, 0)
    assert {r.target for r in moves.collect()} == {0}
    row = step.dominance_update(s, moves, p).where("node_id = 0").first()
    assert np.allclose(row.dom, [-0.02, 1.02])


def test_isolated_particle_stays(spark):
    adj = graph.neighbor_lists(graph.edge_graph(frame(spark, [(0, 1), (1, 2)])))
    coded = spark.createDataFrame([(0, 0), (1, -1), (2, -1), (3, 1)], "node_id long, cls int")
    s = step.superstep(state.initial_state(adj, coded, 2), step.Params(), 0)
    assert {r.home: r.cur for r in s.particles.collect()}[3] == 3


def test_greedy_without_mass_walks_at_random(spark):
    """All neighbours belong to another class for good: weights are zero, the move is a random one and is refused."""
    adj = graph.neighbor_lists(graph.edge_graph(frame(spark, [(0, 1), (0, 2)])))
    coded = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "node_id long, cls int")
    s = state.initial_state(adj, coded, 2)
    p = step.Params(p_grd=1.0)
    moves = {r.pid: r for r in step.targets(s, p, 0).collect()}
    assert moves[0].greedy and not moves[0].picked and moves[0].target in (1, 2)
    after = {r.pid: r for r in step.superstep(s, p, 0).particles.collect()}
    assert after[0].cur == 0 and after[0].strength == 0.0


def test_path_distances_grow_by_one(spark):
    adj = graph.neighbor_lists(graph.edge_graph(frame(spark, [(0, 1), (1, 2), (2, 3), (3, 4)])))
    coded = spark.createDataFrame([(0, 0), (1, -1), (2, -1), (3, -1), (4, 1)], "node_id long, cls int")
    s = state.initial_state(adj, coded, 2)
    assert s.far == 4
    s = step.superstep(s, step.Params(), 0)
    known = {(r.pid, r.node_id): r.d for r in s.dist.collect()}
    assert known == {(0, 0): 0, (0, 1): 1, (1, 4): 0, (1, 3): 1}
    dom = {r.node_id: r.dom for r in s.nodes.collect()}
    assert np.allclose(dom[1], [0.6, 0.4]) and np.allclose(dom[3], [0.4, 0.6]) and dom[2] == [0.5, 0.5]


def test_component_without_seeds_gets_the_smallest_class(spark):
    edges = frame(spark, [(0, 1), (1, 2), (10, 11)])
    lab = spark.createDataFrame([(0, 5), (2, 7)], "node_id long, label long")
    for mode in ("sequential", "batch", "steps"):
        out = {r.node_id: r.label for r in GraphLabeler(mode).set_graph(edges).fit_predict(lab, max_iter=2, early_stop=False).collect()}
        assert out[0] == 5 and out[2] == 7 and out[10] == out[11] == 5


def test_long_path_caps_distance(spark):
    n = 300
    cls = np.full(n, -1)
    cls[0], cls[-1] = 0, 1
    pairs = [(i, i + 1) for i in range(n - 1)]
    want, _ = plain_sequential(n, pairs, cls, 2, 500)
    assert np.array_equal(fit(spark, n, pairs, cls, 2, "sequential", 500)[1], want)


def test_masks_of_many_runs(spark):
    lab = spark.createDataFrame([(i, i % 3) for i in range(101)], "node_id long, label long")
    many = {(r.run, r.node_id): r.label for r in prep.seed_masks_global(lab, 0.1, 4).collect()}
    for run in range(4):
        one = {(run, r.node_id): r.label for r in prep.seed_mask_global(lab, 0.1, run).collect()}
        assert one == {k: v for k, v in many.items() if k[0] == run} and sum(v >= 0 for v in one.values()) == 10


def test_edge_graph_drops_loops_and_repeats(spark):
    pairs = [(0, 0)] + [(0, 1)] * 256 + [(1, 0)]
    assert sorted(map(tuple, graph.edge_graph(frame(spark, pairs)).collect())) == [(0, 1), (1, 0)]
    assert graph.edge_graph(frame(spark, pairs), 0).count() == 0
    with pytest.raises(ValueError):
        graph.edge_graph(frame(spark, [(0, 9)]), 3)
    with pytest.raises(ValueError):
        graph.edge_graph(spark.createDataFrame([(1,)], "a long"))


def test_knn_guards_and_ties(spark):
    pts = tables.matrix(spark, [[0.0], [0.0], [0.0], [1.0]])
    for k in (0, 4, True, 1.5):
        with pytest.raises(ValueError):
            graph.knn(pts, k)
    near = {(r.src, r.rank): r.dst for r in graph.knn(pts, 2).collect()}
    assert near[0, 1] == 1 and near[1, 1] == 0 and near[2, 1] == 0 and near[3, 2] == 1
    own = graph.knn(pts, 1, metric=lambda a, b: abs(a - b).sum())
    assert {r.src: r.dst for r in own.collect()}[0] == 1
    with pytest.raises(ValueError):
        graph.distances(np.zeros((1, 1)), np.zeros((1, 1)), "unheard-of", 2)


def test_blocks_do_not_change_neighbours(spark):
    rng = np.random.default_rng(1)
    pts = tables.matrix(spark, rng.normal(size=(60, 5)))
    rows = lambda b: sorted((r.src, r.rank, r.dst) for r in graph.knn(pts, 4, block=b).collect())
    assert rows(7) == rows(1000)


@pytest.mark.parametrize("metric, p", [("minkowski", 2), ("minkowski", 3), ("chebyshev", 2), ("manhattan", 2), ("cosine", 2)])
def test_sieve_lets_every_near_pair_through_and_few_others(metric, p):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 64)) + 30, rng.normal(size=(900, 64)) + 30
    d = graph.distances(a, b, metric, p)
    limit = np.sort(d, axis=1)[:, 10]
    i, j = graph.sieve(a, b, limit, metric, p)
    assert set(zip(*(x.tolist() for x in np.nonzero(d <= limit[:, None])))) <= set(zip(i.tolist(), j.tolist()))
    assert len(i) < d.size / 3


@pytest.mark.parametrize("metric, p", [("minkowski", 2), ("chebyshev", 2)])
def test_sieve_is_sharp_far_from_the_origin(metric, p):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 64)) + 1e7, rng.normal(size=(901, 64)) + 1e7
    d = graph.distances(a, b, metric, p)
    limit = np.sort(d, axis=1)[:, 10]
    i, j = graph.sieve(a, b, limit, metric, p)
    assert set(zip(*(x.tolist() for x in np.nonzero(d <= limit[:, None])))) <= set(zip(i.tolist(), j.tolist()))
    assert len(i) < d.size / 3


@pytest.mark.parametrize("metric, p", [("minkowski", 2), ("minkowski", 3), ("chebyshev", 2), ("cosine", 2)])
@pytest.mark.parametrize("scale", [1e-25, 1e12])
def test_sieve_of_tiny_and_huge_vectors(metric, p, scale):
    """Values beyond single precision's range for squares, ties at the limit, a zero vector, and rows without a limit yet."""
    rng = np.random.default_rng(7)
    a, b = np.round(rng.normal(size=(20, 5)), 1) * scale, np.round(rng.normal(size=(130, 5)), 1) * scale
    b[:20], b[20] = a, 0
    d = graph.distances(a, b, metric, p)
    limit = np.sort(d, axis=1)[:, 3]
    limit[4] = np.inf
    i, j = graph.sieve(a, b, limit, metric, p)
    assert set(zip(*(x.tolist() for x in np.nonzero(d <= limit[:, None])))) <= set(zip(i.tolist(), j.tolist()))


def test_step_works_moves_out_once(spark):
    """What a step writes on its way changes nothing, and its tables come from what was written."""
    edges = frame(spark, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (1, 3)])
    coded = spark.createDataFrame([(0, 0), (1, -1), (2, -1), (3, 1), (4, -1)], "node_id long, cls int")
    s = state.initial_state(graph.neighbor_lists(graph.edge_graph(edges)), coded, 2).mapped(lambda df, name: df.localCheckpoint())
    kept = []

    def keep(df, name):
        kept.append(name)
        return spark.createDataFrame(df.collect(), df.schema)

    plain, once = step.superstep(s, step.Params(), 0), step.superstep(s, step.Params(), 0, keep)
    assert kept == ["moves", "moved"]
    for name in ("particles", "nodes", "dist"):
        assert sorted(getattr(plain, name).collect()) == sorted(getattr(once, name).collect())
    assert "neighbors" not in once.particles._jdf.queryExecution().optimizedPlan().toString()  # no move is drawn again


def test_stop_threshold_and_first_distances_need_no_graph(spark, monkeypatch):
    monkeypatch.setattr(queries, "_kept", {})
    monkeypatch.setattr(graph, "knn_graph", lambda *a: pytest.fail("a graph was built"))
    assert queries.q17(spark, "/root/testdata/sf0.001").count() == 1
    assert queries.q15(spark, "/root/testdata/sf0.001").count() == 50


def test_labels_are_made_ready_while_the_graph_is_built(spark, monkeypatch):
    monkeypatch.setattr(queries, "_kept", {})
    ready, knn, first = threading.Event(), graph.knn, state.initial_state
    seen = []
    monkeypatch.setattr(graph, "knn", lambda *a: seen.append(ready.wait(60)) or knn(*a))
    monkeypatch.setattr(state, "initial_state", lambda *a: ready.set() or first(*a))
    s = queries.state_after(spark, "/root/testdata/sf0.001", 0)
    assert seen == [True] and s.adjacency.count() == s.nodes.count() == 500


def test_different_vectors_need_no_ranking_after_the_search(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    near = graph.knn(tables.matrix(spark, x), 5, block=20)
    assert "Window" not in near._jdf.queryExecution().optimizedPlan().toString()
    d = graph.distances(x, x, "minkowski", 2)
    d[range(300), range(300)] = np.inf
    want = [(i, int(j), r + 1) for i in range(300) for r, j in enumerate(np.argsort(d[i])[:5])]
    assert sorted((r.src, r.dst, r["rank"]) for r in near.collect()) == sorted(want)
    lists = {r.node_id: r.neighbors for r in graph.neighbor_lists(graph.both_ways(near)).collect()}
    assert lists == {i: sorted({j for a, j, _ in want if a == i} | {a for a, j, _ in want if j == i}) for i in range(300)}


def test_points_become_blocks_in_one_pass(spark, monkeypatch):
    """Nothing is written between points and blocks; blocks are dealt once more only where copies leave them few."""
    tags, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, tag: tags.append(tag) or plain(df, tag))
    x = np.random.default_rng(4).normal(size=(200, 3))
    assert graph.knn(tables.matrix(spark, x), 3, block=9).count() == 600
    assert tags == ["blocks", "nearest"]
    tags.clear()
    assert graph.knn(tables.matrix(spark, x[np.arange(200) % 20]), 3, block=9).count() == 600
    assert tags == ["blocks", "blocks", "nearest", "members"]


def test_different_vectors_of_a_bundle():
    x = np.array([[0.0, 1.0], [-0.0, 1.0], [np.nan, 1.0], [2.0, 0.1], [np.nan, 1.0], [2.0, 0.1]])
    column = pa.array([[None if np.isnan(v) and i == 2 else v for v in row] for i, row in enumerate(x)])
    (rows,) = graph._bundled(1)([pa.RecordBatch.from_arrays([pa.array([9, 3, 8, 7, 5, 6]), column], names=["node_id", "features"])])
    ids, y = graph._unpacked(rows)
    assert rows["points"].to_pylist() == [6] and dict(zip(ids.tolist(), y.tolist()))[6] == [2.0, 0.1] and sorted(ids) == [3, 5, 6]
    for odd in ([[1.0], None], [[1.0], [1.0, 2.0]]):
        with pytest.raises(ValueError):
            graph._matrix(pa.array(odd))


@pytest.mark.parametrize("ties", [False, True])
def test_order_of_what_is_found(ties):
    rng = np.random.default_rng(8)
    row, dst = rng.integers(0, 50, 2000), rng.permutation(2000)
    dist = np.round(rng.normal(size=2000), 1) if ties else rng.normal(size=2000)
    assert graph.Nearest._sorted(row, dist, dst).tolist() == np.lexsort((dst, dist, row)).tolist()


def test_plan_of_a_step_takes_few_calls(spark, monkeypatch):
    s = queries.star(spark, "/root/testdata/sf0.001")
    calls, lit = [], step.F.lit
    monkeypatch.setattr(step.F, "lit", lambda x: calls.append(x) or lit(x))
    step.targets(s, step.Params(), 0)
    assert len(calls) < 20


def test_seed_masks_compare_rows_where_they_are(spark):
    """One cut for each class, no way back by node; quotas of nothing and of a whole class."""
    lab = spark.createDataFrame([(i, i % 3) for i in range(90)] + [(100, 5), (101, None)], "node_id long, label long")
    plan = prep.seed_mask_stratified(lab, 0.1, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    for fraction, kept in ((0.1, 9), (1.0, 91), (0.0, 0)):
        rows = prep.seed_mask_stratified(lab, fraction, 1).collect()
        assert len(rows) == 92 and sum(r.label != -1 for r in rows) == kept
    rows = prep.seed_masks_global(lab.where("label is not null"), 0.5, 2).collect()
    assert [sum(r.run == k and r.label != -1 for r in rows) for k in (0, 1)] == [45, 45]


def test_what_is_found_is_sorted_when_it_is_worth_it(monkeypatch):
    rng = np.random.default_rng(3)
    x, ids, merges, merge = rng.normal(size=(4000, 8)), np.arange(4000), [], graph.Nearest._merge
    monkeypatch.setattr(graph.Nearest, "_merge", lambda self, *a: merges.append(1) or merge(self, *a))
    best = graph.Nearest(ids[:100], x[:100], 6, "minkowski", 2)
    for k in range(0, 4000, 50):
        best.add(ids[k : k + 50], x[k : k + 50])
    rows = best.rows()
    assert len(merges) < 40
    d = graph.distances(x[:100], x, "minkowski", 2)
    assert rows.column("near").to_pylist() == np.argsort(d, axis=1)[:, :6].ravel().tolist()
    assert rows.column("rank").to_pylist()[:6] == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("metric, p", [("minkowski", 2), ("minkowski", 3), ("chebyshev", 2), ("manhattan", 2)])
def test_neighbours_of_copies_and_odd_vectors(spark, metric, p):
    """Many copies of few vectors, ties, and vectors without a finite distance, against the plain rule."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(25, 4)), 1)[rng.integers(0, 25, 300)]
    x[7, 1], x[8, 2] = np.nan, np.inf
    x[9], x[10] = 0.0, -0.0
    d, ids = graph.distances(x, x, metric, p), np.arange(300)
    d[ids, ids] = np.inf
    want = []
    for i, row in enumerate(d):
        best = np.lexsort((ids, row))[:4]
        want += [(i, int(j), r + 1, row[j]) for r, j in enumerate(best) if np.isfinite(row[j])]
    got = graph.knn(tables.matrix(spark, x), 4, metric, p, block=10).select("src", "dst", "rank", "distance").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_labels_and_scaling(spark):
    lab = spark.createDataFrame([(0, -5), (1, -1), (2, 0), (3, 7), (4, None)], "id long, y long")
    lab = tables.labels(lab, "id", "y")
    assert [(r.label, r.idx) for r in prep.class_dictionary(lab).orderBy("idx").collect()] == [(-5, 0), (0, 1), (7, 2)]
    pts = prep.standard_scale(tables.matrix(spark, [[1.0, 4.0], [3.0, 4.0]]))
    assert [r.features for r in pts.orderBy("node_id").collect()] == [[-1.0, 0.0], [1.0, 0.0]]


def test_error_paths(spark):
    lab = spark.createDataFrame([(0, 1), (1, 1)], "node_id long, label long")
    with pytest.raises(ValueError):
        GraphLabeler().fit_predict(lab)
    with pytest.warns(UserWarning):
        assert GraphLabeler("no such mode").mode == "sequential"
    model = GraphLabeler().set_graph(frame(spark, [(0, 1)]))
    with pytest.warns(UserWarning):
        assert model.fit_predict(lab) is lab
    with pytest.raises(ValueError):
        state.stop_threshold(10, 0, 10)
    assert [state.stop_threshold(*x) for x in ((178, 17, 10), (1797, 179, 10), (500, 50, 10), (2000, 200, 10))] == [209, 201, 200, 200]


def test_planted_blocks_are_found(spark):
    rng = np.random.default_rng(5)
    n, size = 200, 100
    pairs = [(i, j) for i in range(n) for j in range(i) if rng.random() < (0.2 if i // size == j // size else 0.01)]
    truth = spark.createDataFrame([(i, i // size) for i in range(n)], "node_id long, label long")
    edges = graph.edge_graph(frame(spark, pairs))
    for mode in ("sequential", "batch"):
        runs = repeated_runs(edges, truth, 10, n_runs=2, mode=mode, max_iter=300).collect()
        assert min(r.accuracy for r in runs) > 0.9


def test_registered_fits_run_until_they_stop(spark, monkeypatch):
    sf, most, given = "/root/testdata/sf0.001", 500_000, []
    runs = queries.q41(spark, sf).collect()
    assert len(runs) == 10 and all(2010 <= r.iterations < most for r in runs)
    fit = GraphLabeler.fit_predict
    monkeypatch.setattr(GraphLabeler, "fit_predict", lambda self, *a, **more: given.append((self, fit(self, *a, **more))) or given[-1][1])
    for query in (queries.q38, queries.q39, queries.q42, queries.flagship):
        assert query(spark, sf).count() > 0
        assert 2010 <= given[-1][0].result.first().iterations < most
    assert len(given) == 4
