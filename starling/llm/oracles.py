"""DuckDB SQL of the similarity queries: all pairs, then the smallest id that each row reaches."""

from __future__ import annotations

_REACH = """reach(node, c) AS (SELECT id, id FROM ids UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.node WHERE r.c < l.b),
least_id AS (SELECT node, min(c) AS component_id FROM reach GROUP BY node)"""

OP6_SQL = f"""
WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings),
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda y: (y IS NULL OR NOT isfinite(y))::INTEGER)) = 0
      AND list_sum(list_transform(embedding, lambda y: abs(y))) > 0),
links AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM v p, v q WHERE p.id <> q.id AND list_cosine_similarity(p.x, q.x) >= 0.9),
{_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM ids JOIN least_id ON node = id
"""

OP10_SQL = rf"""
WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents),
w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT id, hash(shingle) AS h, shingle FROM (
  SELECT id, words[i] || ' ' || words[i + 1] AS shingle FROM w, unnest(range(1, len(words))) AS t(i) UNION ALL SELECT id, words[1] FROM w WHERE len(words) = 1)),
n AS MATERIALIZED (SELECT id, count(*) AS n FROM s GROUP BY id),
k AS MATERIALIZED (SELECT s.id, h, shingle, n FROM s JOIN n USING (id)),
common AS (SELECT p.id AS a, q.id AS b, p.n AS na, q.n AS nb, count(*) AS c FROM k p JOIN k q ON p.h = q.h AND p.shingle = q.shingle AND p.id < q.id AND 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n) GROUP BY ALL),
one_way AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
links AS MATERIALIZED (SELECT a, b FROM one_way UNION ALL SELECT b, a FROM one_way),
{_REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM ids JOIN least_id ON node = id LEFT JOIN n USING (id)
"""
