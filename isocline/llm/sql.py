"""DuckDB SQL of the searches and similarity joins, by brute force over whole tables."""

from __future__ import annotations

from .common import LOWER, UPPER

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

TOP_INNER_PRODUCTS = f"""
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.n AS q, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.n <> v.n AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(k AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s) WHERE k <= 20"""

NEAR_VECTORS = f"""
WITH RECURSIVE every AS (SELECT row_number() OVER () AS n, vec_id, label, embedding FROM embeddings),
v AS (SELECT n, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM every WHERE {_FINITE} AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.n AS a, b.n AS b FROM v a JOIN v b ON a.label = b.label AND a.n <> b.n AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(n, vec_id) AS (SELECT n, vec_id FROM every UNION SELECT links.b, reach.vec_id FROM reach JOIN links ON links.a = reach.n),
low AS (SELECT n, min(vec_id) AS component_id FROM reach GROUP BY n), degree AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM every JOIN low USING (n) LEFT JOIN degree USING (n)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT n, doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM docs),
one AS (SELECT n, unnest(s) AS x FROM sets), size AS (SELECT n, len(s) AS k FROM sets),
shared AS (SELECT a.n AS a, b.n AS b, count(*) AS c FROM one a JOIN one b USING (x) WHERE a.n <> b.n GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN size p ON p.n = a JOIN size q ON q.n = b WHERE 100 * c >= 80 * (p.k + q.k - c)),
reach(n, doc_id) AS (SELECT n, doc_id FROM docs UNION SELECT links.b, reach.doc_id FROM reach JOIN links ON links.a = reach.n),
low AS (SELECT n, min(doc_id) AS component_id FROM reach GROUP BY n)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM sets JOIN low USING (n)"""
