"""The queries of this subpackage, each over the whole of its table, and the SQL that gives the same rows.

The other queries learn a model, draw coins or run a tokenizer, which SQL cannot express; tests hold them against brute
force, round trips and held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doclake.llm import queries as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in vars(q).items() if name.startswith("op")}

ORACLES: dict[str, str] = {
    "op3_norm_sorted_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS i FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.i, c.i)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p QUALIFY rank <= 20""",
    "op4_pivot_permutation": """WITH RECURSIVE links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id""",
    "op9_dart_minhash": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: md5(array_to_string(w[i:i+4], ' ')))) AS g FROM w WHERE len(w) > 0),
m AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS n FROM m GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS both_ FROM m a JOIN m b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE both_ / (x.n + y.n - both_) >= 0.8),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT a AS doc_id, min(b) AS component_id, a = min(b) AS kept FROM reach GROUP BY a""",
    "op12_filter_cube": r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) = 1 AS good, coalesce(bad, 0) = 1 AS bad,
  CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || e.x || f.x AS filter_order FROM x a, x b, x c, x e, x f WHERE len(list_distinct([a.x, b.x, c.x, e.x, f.x])) = 5),
g AS (SELECT d.*, filter_order, coalesce(list_min(list_filter(range(1, 6), lambda p: contains(fails, substr(filter_order, p, 1)))), 6) AS gone FROM d, o),
s AS (SELECT part, filter_order, step::INT AS step, substr(filter_order, step, 1) AS f, count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
  count(*) FILTER (gone < step AND contains(fails, substr(filter_order, step, 1))) AS redundant, count(*) FILTER (fails = substr(filter_order, step, 1)) AS unique_fails,
  count(*) FILTER (gone = step AND good) AS good_lost, count(*) FILTER (gone = step AND bad) AS toxic_lost FROM g, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM s""",
}
