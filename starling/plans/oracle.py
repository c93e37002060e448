"""DuckDB SQL for the queries; steps are chains of common table expressions."""

from __future__ import annotations

from starling.functions.draws import PURPOSES, XORSHIFT_MAX, XORSHIFT_SEED, XORSHIFT_SHIFTS, uniform_sql
from starling.operators.state import distance_weights
from starling.plans.queries import FRACTION, K, SEED, STEPS, SUPPLIER_OFFSET

VEC = "v AS (SELECT vec_id::BIGINT AS node_id, embedding::DOUBLE[] AS x FROM embeddings)"
TRUTH = "truth AS (SELECT vec_id::BIGINT AS node_id, label::BIGINT AS label FROM embeddings)"
LUT = "[" + ", ".join(f"{w!r}::DOUBLE" for w in distance_weights()) + "]"
FOLD = "coalesce(list_reduce({0}, lambda a, b: a + b, 0::DOUBLE), 0)"

METRICS = {
    "euclid": "list_distance(a.x, b.x)",
    "manhattan": "list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2])))",
    "chebyshev": "list_max(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2])))",
    "minkowski3": "pow(list_sum(list_transform(list_zip(a.x, b.x), lambda z: pow(abs(z[1] - z[2]), 3))), 1.0 / 3)",
    "cosine": "list_cosine_distance(a.x, b.x)",
}


def knn(metric: str) -> str:
    return f"""knn AS (SELECT src, dst, distance, rank FROM (
      SELECT src, dst, distance, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank
      FROM (SELECT a.node_id AS src, b.node_id AS dst, {METRICS[metric]} AS distance FROM v a, v b WHERE a.node_id <> b.node_id)) WHERE rank <= {K})"""


EDGES = f"{VEC}, {knn('euclid')}, edges AS MATERIALIZED (SELECT src, dst FROM knn UNION SELECT dst, src FROM knn)"
MASK = f"""{TRUTH}, masked AS MATERIALIZED (
  SELECT node_id, CASE WHEN k <= round_even(n * {FRACTION}, 0) THEN label ELSE -1 END AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', {SEED}, node_id))) AS k, count(*) OVER (PARTITION BY label) AS n FROM truth))"""
CODED = f"""{MASK}, classes AS MATERIALIZED (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS idx FROM (SELECT DISTINCT label FROM masked WHERE label <> -1)),
coded AS MATERIALIZED (SELECT node_id, coalesce(idx, -1)::INTEGER AS cls FROM masked LEFT JOIN classes USING (label)),
size AS MATERIALIZED (SELECT (SELECT count(*) FROM coded) AS n, (SELECT count(*) FROM classes) AS c)"""
PARTICLES = "p0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY node_id) - 1 AS pid, node_id AS home, node_id AS cur, cls, 1::DOUBLE AS strength FROM coded WHERE cls <> -1)"
NODES = """n0 AS MATERIALIZED (SELECT node_id, cls, list_transform(range(c), lambda i: CASE WHEN cls = -1 THEN 1.0::DOUBLE / c WHEN i = cls THEN 1::DOUBLE ELSE 0::DOUBLE END) AS dom,
  list_transform(range(c), lambda i: 0::DOUBLE) AS own FROM coded, size)"""
DIST = "d0 AS MATERIALIZED (SELECT pid, home AS node_id, 0 AS d FROM p0)"
START = f"{EDGES}, adj AS MATERIALIZED (SELECT src AS node_id, list(dst ORDER BY dst) AS nb FROM edges GROUP BY src), {CODED}, {PARTICLES}, {NODES}, {DIST}, far AS (SELECT least(n - 1, 255) AS far FROM size)"


def draw(it: int, purpose: str) -> str:
    return uniform_sql("1", str(it), "pid", str(PURPOSES[purpose]))


def moves(t, it: int | None = None, on: str = "") -> str:
    """Tables of step t up to the targets: mode, weights, slices, picks, moves; ``on`` names another fixture's adj, far and size."""
    it = t if it is None else it
    return f"""mode{t} AS MATERIALIZED (SELECT p.*, nb, {draw(it, 'mode')} < 0.5 AS greedy FROM p{t} p JOIN adj{on} adj ON adj.node_id = p.cur),
w{t} AS MATERIALIZED (SELECT g.pid, g.pos, g.nb, dom[g.cls + 1] * {LUT}[coalesce(d, far) + 1] AS w
  FROM (SELECT pid, cls, unnest(nb) AS nb, unnest(range(len(nb))) AS pos FROM mode{t} WHERE greedy) g
  JOIN n{t} n ON n.node_id = g.nb LEFT JOIN d{t} d ON d.pid = g.pid AND d.node_id = g.nb, far{on}),
wl{t} AS (SELECT pid, list(nb ORDER BY pos) AS nbs, list(w ORDER BY pos) AS ws FROM w{t} GROUP BY pid),
s{t} AS MATERIALIZED (SELECT pid, nbs, list_transform(range(1, len(ws) + 1), lambda i: {FOLD.format('ws[1:i]')}) AS slices FROM wl{t}),
k{t} AS MATERIALIZED (SELECT pid, CASE WHEN slices[-1] > 0 THEN nbs[least(len(list_filter(slices, lambda x: x < {draw(it, 'pick')} * slices[-1])), len(nbs) - 1) + 1] END AS pick FROM s{t}),
m{t} AS MATERIALIZED (SELECT m.pid, cur, cls, strength, greedy, pick IS NOT NULL AS picked,
  coalesce(pick, nb[floor({draw(it, 'walk').replace('pid', 'm.pid')} * len(nb))::INTEGER + 1]) AS target FROM mode{t} m LEFT JOIN k{t} USING (pid))"""


def dominance(t, on: str = "", delta: str = "0.1") -> str:
    """Table u of step t: dominance after all reductions and gains."""
    return f"""v{t} AS (SELECT m.target AS node_id, list({{'pid': m.pid, 'k': m.cls, 'step': strength * ({delta}::DOUBLE / (c - 1)),
    'total': {FOLD.format(f"list_transform(n.dom, lambda y: least(y, strength * ({delta}::DOUBLE / (c - 1))))")}}} ORDER BY m.pid) AS visits
  FROM m{t} m JOIN n{t} n ON n.node_id = m.target AND n.cls = -1, size{on} size GROUP BY m.target),
u{t} AS MATERIALIZED (SELECT n.node_id, n.cls, own, CASE WHEN visits IS NULL THEN dom ELSE list_transform(dom, lambda y, i:
    list_reduce(list_transform(list_filter(visits, lambda q: q.k = i - 1), lambda q: q.total), lambda a, b: a + b,
      list_reduce(list_transform(visits, lambda q: least(y, q.step)), lambda a, b: a - b, y))) END AS dom
  FROM n{t} n LEFT JOIN v{t} v ON v.node_id = n.node_id)"""


def updates(t: int, deltap: str = "1") -> str:
    """Tables of step t after the targets: dominance u, moved particles x, own degrees o, distances and particles."""
    strength = "dom[m.cls + 1]" if deltap == "1" else f"strength + (dom[m.cls + 1] - strength) * {deltap}"
    return f"""{dominance(t)},
x{t} AS MATERIALIZED (SELECT m.pid, m.cur, m.cls, m.picked, m.target, u.dom, {strength} AS strength FROM m{t} m JOIN u{t} u ON u.node_id = m.target),
a{t} AS (SELECT target AS node_id, list({{'pid': pid, 'k': cls, 'w': strength}} ORDER BY pid) AS adds FROM x{t} WHERE NOT picked GROUP BY target),
n{t + 1} AS MATERIALIZED (SELECT u.node_id, u.cls, u.dom, CASE WHEN adds IS NULL THEN own ELSE list_transform(own, lambda y, i:
    list_reduce(list_transform(list_filter(adds, lambda q: q.k = i - 1), lambda q: q.w), lambda a, b: a + b, y)) END AS own
  FROM u{t} u LEFT JOIN a{t} a ON a.node_id = u.node_id),
p{t + 1} AS MATERIALIZED (SELECT p.pid, p.home, CASE WHEN x.dom[x.cls + 1] = list_max(x.dom) THEN x.target ELSE p.cur END AS cur, p.cls, coalesce(x.strength, p.strength) AS strength
  FROM p{t} p LEFT JOIN x{t} x ON x.pid = p.pid),
r{t} AS (SELECT m.pid, m.target AS node_id, coalesce(dc.d, far) + 1 AS d FROM m{t} m LEFT JOIN d{t} dc ON dc.pid = m.pid AND dc.node_id = m.cur
  LEFT JOIN d{t} dt ON dt.pid = m.pid AND dt.node_id = m.target, far WHERE coalesce(dc.d, far) < 255 AND coalesce(dt.d, far) > coalesce(dc.d, far) + 1),
d{t + 1} AS MATERIALIZED (SELECT pid, node_id, min(d)::INTEGER AS d FROM (SELECT pid, node_id, d FROM d{t} UNION ALL SELECT pid, node_id, d FROM r{t}) GROUP BY ALL)"""


def chain(steps: int) -> str:
    """All tables up to the state after ``steps`` steps."""
    return ", ".join([START, *[x for t in range(steps) for x in (moves(t), updates(t))]])


def long_form(table: str, column: str, value: str) -> str:
    return f"SELECT node_id, (i - 1)::INTEGER AS class_idx, round({column}[i], 6) AS {value} FROM {table}, size, unnest(range(1, c + 1)) AS t(i)"


def next_word(x: str) -> str:
    a, b, c = XORSHIFT_SHIFTS
    s1 = f"xor({x}, ({x} << {a}) & {XORSHIFT_MAX})"
    s2 = f"xor({s1}, {s1} >> {b})"
    return f"xor({s2}, ({s2} << {c}) & {XORSHIFT_MAX})"


def xorshift() -> str:
    return f"""WITH RECURSIVE s(i, x) AS (SELECT 0, {XORSHIFT_SEED}::BIGINT UNION ALL SELECT i + 1, {next_word('x')} FROM s WHERE i < 50)
SELECT i, x, round(x / {XORSHIFT_MAX}.0::DOUBLE, 9) AS u FROM s WHERE i > 0"""


AT = f"{chain(STEPS)}, {moves(STEPS)}"
AFTER = f"{AT}, {updates(STEPS)}"
PREDICTED = f"{AFTER}, hard AS (SELECT node_id, CASE WHEN cls = -1 THEN list_position(dom, list_max(dom)) - 1 ELSE cls END AS idx FROM n{STEPS + 1}), predicted AS (SELECT node_id, classes.label FROM hard JOIN classes USING (idx))"
PAIRS = f"{PREDICTED}, pairs AS (SELECT t.label AS truth, p.label AS pred FROM predicted p JOIN truth t USING (node_id) JOIN masked m USING (node_id) WHERE m.label = -1)"
REPORT = """, d AS (SELECT c.class, coalesce(support, 0) AS support, coalesce(said, 0) AS said, coalesce(hit, 0) AS hit
  FROM (SELECT truth AS class FROM pairs UNION SELECT pred FROM pairs) c
  LEFT JOIN (SELECT truth AS class, count(*) AS support, count(*) FILTER (truth = pred) AS hit FROM pairs GROUP BY 1) USING (class)
  LEFT JOIN (SELECT pred AS class, count(*) AS said FROM pairs GROUP BY 1) USING (class)),
e AS (SELECT *, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM d),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM e),
o AS (SELECT class::VARCHAR AS name, precision, recall, f1, support FROM f
  UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM o"""
SUMMARY = """s AS (SELECT event_type AS mode, count(*) AS runs, avg(value) AS mean_seconds, stddev_pop(value) AS std_seconds, avg((user_id % 100) / 100.0) AS mean_accuracy, stddev_pop((user_id % 100) / 100.0) AS std_accuracy FROM events GROUP BY 1)"""


def after_steps(n: int) -> str:
    return f"""WITH {chain(n)} SELECT 'particle' AS part, pid AS a, cur AS b, round(strength, 6) AS x FROM p{n}
UNION ALL SELECT 'own', node_id, class_idx, x FROM ({long_form(f'n{n}', 'own', 'x')})
UNION ALL SELECT 'dominance', node_id, class_idx, x FROM ({long_form(f'n{n}', 'dom', 'x')})
UNION ALL SELECT 'distance', pid, node_id, d FROM d{n}"""


def both(table: str) -> str:
    return f"SELECT node_id, class_idx, dominance, own FROM ({long_form(table, 'dom', 'dominance')}) JOIN ({long_form(table, 'own', 'own')}) USING (node_id, class_idx)"


def near(metric: str) -> str:
    return f"WITH {VEC}, {knn(metric)} SELECT src, dst, rank::INTEGER AS rank, round(distance, 6) AS distance FROM knn"


SHARES = f"list_transform(own, lambda y: y / CASE WHEN {FOLD.format('own')} = 0 THEN 1 ELSE {FOLD.format('own')} END)"
HARD = "CASE WHEN cls = -1 THEN list_position(dom, list_max(dom)) - 1 ELSE cls END"


def fitted(table: str) -> str:
    """Dominance, own shares and class of all nodes."""
    return f"""SELECT node_id, (i - 1)::INTEGER AS class_idx, round(dom[i], 6) AS dominance, round(shares[i], 6) AS own, hard::INTEGER AS cls
FROM (SELECT node_id, dom, {SHARES} AS shares, {HARD} AS hard FROM {table}), size, unnest(range(1, c + 1)) AS t(i)"""


def sequential(steps: int) -> str:
    """Moves one after the other: each row of the recursion is the whole state after a move; lists go by the nodes' order."""
    u = f"{XORSHIFT_MAX}.0::DOUBLE"
    put = lambda whole, i, new: f"list_transform({whole}, lambda y, i: CASE WHEN i = {i} THEN {new} ELSE y END)"
    return f"""WITH RECURSIVE {START},
idx AS MATERIALIZED (SELECT node_id, row_number() OVER (ORDER BY node_id) AS i FROM n0),
g AS MATERIALIZED (SELECT (SELECT list(coalesce(nb, []) ORDER BY i) FROM idx LEFT JOIN (SELECT adj.node_id, list(x.i ORDER BY x.i) AS nb FROM (SELECT node_id, unnest(nb) AS v FROM adj) adj JOIN idx x ON x.node_id = v GROUP BY 1) USING (node_id)) AS adj,
  (SELECT list(cls ORDER BY i) FROM n0 JOIN idx USING (node_id)) AS cls, (SELECT list(cls ORDER BY pid) FROM p0) AS kind, (SELECT count(*) FROM p0) AS np, c, far FROM size, far),
s(m, x, cur, strength, dom, own, dist) AS (
  SELECT 0, {XORSHIFT_SEED}::BIGINT, (SELECT list(i ORDER BY pid) FROM p0 JOIN idx ON node_id = home), (SELECT list(1::DOUBLE ORDER BY pid) FROM p0), (SELECT list(dom ORDER BY i) FROM n0 JOIN idx USING (node_id)), (SELECT list(own ORDER BY i) FROM n0 JOIN idx USING (node_id)),
    (SELECT list(d ORDER BY pid) FROM (SELECT pid, list(CASE WHEN idx.node_id = home THEN 0 ELSE far END ORDER BY i) AS d FROM p0, idx, far GROUP BY pid))
  UNION ALL
  SELECT m + 1, x2, CASE WHEN late[k] = list_max(late) THEN {put('cur', 'p', 'aim')} ELSE cur END, {put('strength', 'p', 'late[k]')}, {put('dom', 'aim', 'late')},
    CASE WHEN picked THEN own ELSE {put('own', 'aim', put('own[aim]', 'k', 'own[aim][k] + late[k]'))} END,
    CASE WHEN here < 255 AND dist[p][aim] > here + 1 THEN {put('dist', 'p', put('dist[p]', 'aim', 'here + 1'))} ELSE dist END
  FROM (SELECT *, dist[p][spot] AS here, CASE WHEN loose THEN list_transform(cut, lambda y, i: CASE WHEN i = k THEN y + {FOLD.format('list_transform(dom[aim], lambda z: least(z, step))')} ELSE y END) ELSE dom[aim] END AS late
  FROM (SELECT *, list_transform(dom[aim], lambda y: y - least(y, step)) AS cut
  FROM (SELECT *, cls[aim] = -1 AS loose, strength[p] * (0.1::DOUBLE / (c - 1)) AS step
  FROM (SELECT *, CASE WHEN picked THEN nb[CASE WHEN slices[-1] >= x2 / {u} * slices[-1] THEN len(list_filter(slices, lambda y: y < x2 / {u} * slices[-1])) + 1 ELSE 1 END] ELSE nb[x2 % len(nb) + 1] END AS aim
  FROM (SELECT *, greedy AND slices[-1] > 0 AS picked
  FROM (SELECT *, {next_word('x1')} AS x2, x1 / {u} < 0.5 AS greedy, list_transform(range(1, len(nb) + 1), lambda j: {FOLD.format(f"list_transform(nb[1:j], lambda v: dom[v][k] * {LUT}[dist[p][v] + 1])")}) AS slices
  FROM (SELECT *, {next_word('x')} AS x1, adj[spot] AS nb
  FROM (SELECT *, cur[p] AS spot, kind[p] + 1 AS k FROM (SELECT *, m % np + 1 AS p FROM s, g WHERE m < {steps} * np)))))))))),
fit AS (SELECT i, dom[i] AS dom, own[i] AS own FROM (SELECT * FROM s, g WHERE m = {steps} * np), idx),
nodes AS (SELECT node_id, cls, fit.dom, fit.own FROM fit JOIN idx USING (i) JOIN n0 USING (node_id))
{fitted('nodes')}"""


#: The star of queries.star: its tables as those of step "s", with delta_v 0.4.
STAR = f"""nat AS (SELECT n_nationkey::BIGINT AS node_id, n_regionkey + 100::BIGINT AS hub FROM nation),
coded_s AS (SELECT node_id, (node_id % 2)::INTEGER AS cls FROM nat UNION ALL SELECT DISTINCT hub, CASE WHEN hub = 102 THEN 0 ELSE -1 END FROM nat),
size_s AS (SELECT count(*) AS n, 2 AS c FROM coded_s), far_s AS (SELECT least(n - 1, 255) AS far FROM size_s),
ends_s AS (SELECT node_id AS a, hub AS b FROM nat WHERE hub <> 104), adj_s AS (SELECT a AS node_id, list(b ORDER BY b) AS nb FROM (SELECT a, b FROM ends_s UNION SELECT b, a FROM ends_s) GROUP BY a),
ps AS ({PARTICLES[PARTICLES.index('(') + 1:-1].replace('coded', 'coded_s')}), ds AS (SELECT pid, home AS node_id, 0 AS d FROM ps),
ns AS (SELECT node_id, cls, CASE WHEN cls = -1 THEN [0.5::DOUBLE, 0.5] ELSE [(cls = 0)::INTEGER::DOUBLE, (cls = 1)::INTEGER] END AS dom, [0::DOUBLE, 0] AS own FROM coded_s),
{moves('s', 0, '_s')}, {dominance('s', '_s', '0.4')}"""


def on_both(ours: str) -> str:
    """``ours`` has the placeholder ``@`` for the step in table names."""
    return f"WITH {AFTER}, {STAR} SELECT *, 'embeddings' AS fixture FROM ({ours.replace('@', str(STEPS))}) UNION ALL SELECT *, 'star' FROM ({ours.replace('@', 's').replace(', size,', ', size_s,')})"


ORDERS = "o AS (SELECT o_custkey AS a, substr(o_orderpriority, 1, 1)::BIGINT - 10 AS b FROM orders), oe AS (SELECT a, b FROM o UNION SELECT b, a FROM o)"

ORACLE = {
    "q01_seed_mask_global": f"WITH {TRUTH} SELECT node_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', {SEED}, node_id))) <= floor((count(*) OVER ()) * {FRACTION}::DOUBLE) THEN label ELSE -1 END AS label FROM truth",
    "q02_seed_mask_stratified": f"WITH {MASK} SELECT node_id, label FROM masked",
    "q03_class_dictionary": "SELECT label::BIGINT AS label, (row_number() OVER (PARTITION BY source ORDER BY label) - 1)::INTEGER AS idx, source FROM (SELECT DISTINCT quality AS label, 'quality' AS source FROM labels WHERE quality <> -1 UNION ALL SELECT DISTINCT label, 'embeddings' FROM embeddings WHERE label <> -1)",
    "q04_label_encode_decode": f"WITH {CODED} SELECT node_id, cls, coalesce(classes.label, -1) AS label FROM coded LEFT JOIN classes ON idx = cls",
    "q05_standard_scale": f"""WITH {VEC}, r AS (SELECT 'embeddings' AS source, node_id, unnest(x) AS x, unnest(range(len(x))) AS i FROM v
UNION ALL SELECT 'part', p_partkey, p_size, 0 FROM part UNION ALL SELECT 'part', p_partkey, p_retailprice, 1 FROM part),
s AS (SELECT source, i, avg(x) AS m, stddev_pop(x) AS s FROM r GROUP BY ALL)
SELECT source, node_id, i::INTEGER AS i, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 5) AS x FROM r JOIN s USING (source, i)""",
    "q06_knn_euclid": near("euclid"),
    "q07_knn_manhattan": near("manhattan"),
    "q08_knn_cosine": near("cosine"),
    "q08b_knn_chebyshev": near("chebyshev"),
    "q08c_knn_minkowski3": near("minkowski3"),
    "q09_knn_symmetric": f"WITH {EDGES} SELECT src, dst FROM edges",
    "q10_edge_graph": f"WITH p AS (SELECT l_partkey AS a, l_suppkey + {SUPPLIER_OFFSET} AS b FROM lineitem) SELECT a AS src, b AS dst FROM p UNION SELECT b, a FROM p",
    "q11_degree": f"WITH {ORDERS} SELECT c_custkey AS node_id, count(b) AS degree FROM customer LEFT JOIN oe ON a = c_custkey GROUP BY 1",
    "q11b_max_degree": f"WITH {EDGES} SELECT max(n) AS max_degree FROM (SELECT count(*) AS n FROM edges GROUP BY src)",
    "q12_neighbor_list_padded": f"""WITH {EDGES}, l AS (SELECT node_id, list(dst ORDER BY dst) FILTER (dst IS NOT NULL) AS nb FROM v LEFT JOIN edges ON src = node_id GROUP BY 1),
w AS (SELECT greatest(max(coalesce(len(nb), 0)), 1) AS w FROM l)
SELECT node_id, array_to_string(list_concat(coalesce(nb, []), list_transform(range(w - coalesce(len(nb), 0)), lambda i: -1)), ',') AS neighbors FROM l, w""",
    "q13_particles_init": f"WITH {CODED}, {PARTICLES} SELECT * FROM p0",
    "q14_dominance_init": f"WITH {CODED}, {NODES} {both('n0')}",
    "q15_distance_init": f"WITH {CODED}, {PARTICLES}, {DIST} SELECT pid, node_id, d, (SELECT least(n - 1, 255) FROM size)::INTEGER AS far FROM d0",
    "q16_distance_weights": "SELECT d, 1::DOUBLE / ((d + 1) * (d + 1)) AS w FROM range(257) t(d)",
    "q17_stop_threshold": f"WITH {CODED}, {PARTICLES} SELECT greatest(1, round_even(n / ((SELECT count(*) FROM p0) * {K}) * round_even(2000 * 0.1, 0), 0))::BIGINT AS stop_max FROM size",
    "q18_mode_draw": on_both("SELECT pid, cur, greedy, len(nb)::INTEGER AS degree FROM mode@"),
    "q19_greedy_weights": f"WITH {AT} SELECT pid, pos::INTEGER AS pos, nb, round(w, 6) AS w FROM w{STEPS}",
    "q20_cumulative_slices": f"WITH {AT} SELECT pid, i::INTEGER AS pos, round(slices[i + 1], 6) AS slice FROM s{STEPS}, unnest(range(len(slices))) AS t(i)",
    "q21_roulette_pick": on_both("SELECT pid, pick FROM k@"),
    "q22_random_walk": f"WITH {AT} SELECT pid, target FROM m{STEPS} WHERE NOT greedy",
    "q23_zero_mass_fallback": on_both("SELECT pid, greedy AND NOT picked AS fell_back, target FROM m@"),
    "q24_dominance_update": on_both(long_form("u@", "dom", "dominance")),
    "q25_strength_update": f"""WITH {AFTER} SELECT 1.0::DOUBLE AS deltap, pid, round(strength, 6) AS strength FROM x{STEPS}
UNION ALL SELECT 0.5, m.pid, round(m.strength + (u.dom[m.cls + 1] - m.strength) * 0.5, 6) FROM m{STEPS} m JOIN u{STEPS} u ON u.node_id = m.target""",
    "q26_distance_relax": f"WITH {AFTER} SELECT pid, node_id, d FROM d{STEPS + 1}",
    "q27_owndeg_accumulate": f"WITH {AFTER} {long_form(f'n{STEPS + 1}', 'own', 'own')}",
    "q27b_owndeg_normalize": f"""WITH {AFTER}, z AS (SELECT node_id, {FOLD.format('own')} AS t, own FROM n{STEPS + 1})
SELECT node_id, (i - 1)::INTEGER AS class_idx, round(own[i] / CASE WHEN t = 0 THEN 1 ELSE t END, 6) AS own FROM z, size, unnest(range(1, c + 1)) AS u(i)""",
    "q28_shock_move": f"WITH {AFTER} SELECT pid, home, cur, cls, round(strength, 6) AS strength FROM p{STEPS + 1}",
    "q29_superstep_1": after_steps(1),
    "q29_superstep_3": after_steps(3),
    "q30_mean_max_potential": f"WITH {AFTER} SELECT round(avg(list_max(dom)), 6) AS potential FROM n{STEPS + 1}",
    "q31_hard_labels": f"WITH {PREDICTED} SELECT node_id, label FROM predicted",
    "q32_xorshift_stream": xorshift(),
    "q33_accuracy": f"WITH {PAIRS} SELECT round(avg((truth = pred)::INTEGER), 6) AS accuracy FROM pairs",
    "q34_confusion": f"WITH {PAIRS} SELECT truth, pred, count(*) AS n FROM pairs GROUP BY ALL",
    "q35_class_report": f"WITH {PAIRS} {REPORT}",
    "q38b_sequential_steps": sequential(2),
    "q39b_batch_steps": f"WITH {chain(3)} {fitted('n3')}",
    "q36_run_summary": f"WITH {SUMMARY} SELECT mode, runs, round(mean_seconds, 5) AS mean_seconds, round(std_seconds, 5) AS std_seconds, round(mean_accuracy, 5) AS mean_accuracy, round(std_accuracy, 5) AS std_accuracy FROM s",
    "q37_speedups": f"WITH {SUMMARY} SELECT a.mode AS slow, b.mode AS fast, round(a.mean_seconds / b.mean_seconds, 5) AS ratio FROM s a JOIN s b ON a.mode > b.mode",
}
