"""The same rows in DuckDB SQL, written apart from the Spark plans."""

from __future__ import annotations

BLOCKS = """
lines AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
numbered AS (SELECT doc_id, unnest(s) AS text, (generate_subscripts(s, 1) - 1)::INT AS ord FROM lines),
blocks AS (
  SELECT doc_id, ord, 'b_' || lpad(ord::VARCHAR, 4, '0') AS block_id, text, (1 + ord % 3)::INT AS level,
         CASE WHEN ord = 0 THEN 'title' WHEN ord = 1 THEN 'abstract' WHEN length(text) < 80 THEN 'heading' ELSE 'paragraph' END AS type
  FROM numbered)"""
ANCHORS = BLOCKS + """,
anchored AS (
  SELECT *, (ord // 10)::INT AS page, 72.0::DOUBLE AS x0, 540.0::DOUBLE AS x1, ((ord % 10) * 79.2::DOUBLE) AS y0, ((ord % 10 + 1) * 79.2::DOUBLE - 4.0::DOUBLE) AS y1 FROM blocks)"""
PREDICTED = ANCHORS + """,
pred AS (SELECT doc_id, page, ord, CASE WHEN ord % 9 = 4 THEN 'other' ELSE type END AS type, x0, x1, y0 + (doc_id % 5) * 4.0::DOUBLE AS y0, y1 + (doc_id % 5) * 4.0::DOUBLE AS y1 FROM anchored),
pairs AS (
  SELECT * FROM (
    SELECT g.doc_id, g.page, g.ord AS g, p.ord AS p, g.type AS g_type, p.type AS p_type,
      greatest(0.0::DOUBLE, least(g.x1, p.x1) - greatest(g.x0, p.x0)) * greatest(0.0::DOUBLE, least(g.y1, p.y1) - greatest(g.y0, p.y0)) AS both_,
      (g.x1 - g.x0) * (g.y1 - g.y0) + (p.x1 - p.x0) * (p.y1 - p.y0) AS total
    FROM anchored g JOIN pred p ON g.doc_id = p.doc_id AND g.page = p.page))
, good AS (SELECT doc_id, page, g, p, g_type, p_type, round(CASE WHEN both_ <= 0 THEN 0.0::DOUBLE ELSE both_ / (total - both_) END, 6) AS iou FROM pairs)"""
TOKENS = r"((length(text) - length(regexp_replace(text, '[^\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}]', '', 'g'))) + 3) // 4 + length(regexp_replace(text, '[^\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}]', '', 'g'))"
NEW = """,
fresh AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1)::INT AS new_ord,
         CASE WHEN ord % 11 = 5 THEN text || ' (edited)' ELSE text END AS text FROM blocks WHERE ord % 7 <> 3),
mapped AS (
  SELECT a.doc_id, a.ord, b.new_ord FROM
    (SELECT doc_id, ord, text, row_number() OVER (PARTITION BY doc_id, text ORDER BY ord) AS k FROM blocks) a
    JOIN (SELECT doc_id, new_ord, text, row_number() OVER (PARTITION BY doc_id, text ORDER BY new_ord) AS k FROM fresh) b
    ON a.doc_id = b.doc_id AND a.text = b.text AND a.k = b.k)"""
BM25 = BLOCKS + """,
freq AS (
  SELECT *, greatest(length(text) - 2, 0)::DOUBLE AS dl,
    ((length(lower(text)) - length(replace(lower(text), 'ing', ''))) // 3)::DOUBLE AS f0,
    ((length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4)::DOUBLE AS f1 FROM blocks),
stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, (count(*) FILTER (f0 > 0))::DOUBLE AS d0, (count(*) FILTER (f1 > 0))::DOUBLE AS d1 FROM freq),
bm AS (
  SELECT doc_id, block_id, ord, type, text, round(
    ln(1 + (n - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * f0 * 2.2::DOUBLE / (f0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) +
    ln(1 + (n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)), 9) AS score
  FROM freq, stats WHERE f0 > 0 OR f1 > 0),
hits AS (SELECT * FROM bm ORDER BY score DESC, doc_id, ord LIMIT 50)"""
NEAR = "near AS (SELECT e.vec_id, e.label, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
TREE = "turns AS (SELECT conv_id, turn AS node, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent FROM conversations)"
UP = "RECURSIVE " + TREE + """,
up AS (SELECT conv_id, node, parent AS ancestor, 1 AS distance FROM turns WHERE parent IS NOT NULL
  UNION ALL SELECT u.conv_id, u.node, t.parent, u.distance + 1 FROM up u JOIN turns t ON t.conv_id = u.conv_id AND t.node = u.ancestor WHERE t.parent IS NOT NULL)"""
REL = "rel AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_returnflag AS type, l_orderkey AS block, l_linenumber AS seq, 1.0::DOUBLE - l_discount AS confidence FROM lineitem)"
SCORES = REL + ", scores AS (SELECT node, (2 * count(*) + count(DISTINCT block))::BIGINT AS score FROM (SELECT src AS node, block FROM rel UNION ALL SELECT dst, block FROM rel) GROUP BY node)"
CALLS = "calls AS (SELECT ts, event_type AS task, event_type || '@' || (user_id % 3) AS prompt, floor(value)::BIGINT AS input, floor(value * 0.3::DOUBLE)::BIGINT AS cached, event_id % 4 = 0 AS cache_hit FROM events)"
STATES = """changes AS (SELECT user_id AS job, 'k' || (user_id % 4) AS kind, event_id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS status, CASE WHEN user_id % 3 <> 0 THEN user_id - 1 END AS depends_on FROM events),
states AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS rn, min(ts) OVER (PARTITION BY job) AS created FROM changes) WHERE rn = 1)"""
ITEMS = "items AS (SELECT c_custkey AS item_id, c_name AS title, c_nationkey AS collection_id, c_acctbal AS balance, CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'archived' END AS status FROM customer)"
PARENTS = BLOCKS + """,
heads AS (SELECT doc_id, ord, level FROM blocks WHERE type = 'heading'),
parents AS (SELECT h.doc_id, h.ord, h.level, (SELECT max(e.ord) FROM heads e WHERE e.doc_id = h.doc_id AND e.ord < h.ord AND e.level < h.level)::INT AS parent FROM heads h)"""

ORACLES = {
    "search_bm25": f"WITH {BM25} SELECT doc_id, block_id, score FROM hits",
    "search_like_fallback": f"WITH {BLOCKS} SELECT doc_id, block_id, ord FROM blocks WHERE contains(lower(text), 'ou') AND contains(lower(text), 'ñ')",
    "search_knn": f"WITH {NEAR} SELECT vec_id, distance FROM near ORDER BY distance, vec_id LIMIT 50",
    "search_knn_partitioned": f"WITH {NEAR} SELECT label, vec_id, distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM near) WHERE rank <= 5",
    "search_hybrid_topk": f"""WITH {BM25}, {NEAR},
close AS (SELECT vec_id, row_number() OVER (ORDER BY distance, vec_id) AS hit FROM (SELECT * FROM near ORDER BY distance, vec_id LIMIT 50)),
ranked AS (
  SELECT 0 AS source, row_number() OVER (ORDER BY score DESC, doc_id, ord) AS pos, doc_id, ord FROM hits
  UNION ALL SELECT 1, hit * 3 + o, vec_id, o FROM close, (SELECT unnest([0, 1, 2]) AS o)),
firsts AS (SELECT source, doc_id, ord, row_number() OVER (PARTITION BY source ORDER BY min(pos)) AS rank FROM ranked GROUP BY source, doc_id, ord),
fused AS (SELECT doc_id, ord, sum(1.0::DOUBLE / (60 + rank)) AS score, count(*) AS n, min(source * 1000 + rank) AS tie FROM firsts GROUP BY doc_id, ord),
top AS (SELECT * FROM fused ORDER BY round(score, 12) DESC, tie, doc_id, ord LIMIT 20)
SELECT b.doc_id, b.block_id, b.type, (b.ord // 10)::INT AS page, round(t.score, 9) AS score, t.n::INT AS n_sources, substring(b.text, 1, 160) AS snippet
FROM top t JOIN blocks b ON b.doc_id = t.doc_id AND b.ord = t.ord""",
    "approx_tokens_by_lang": f"SELECT lang, sum({TOKENS})::BIGINT AS tokens, count(*) AS n FROM documents GROUP BY lang",
    "lang_cjk_ratio": r"SELECT source, CASE WHEN sum(length(regexp_replace(text, '[^\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}]', '', 'g'))) / sum(length(text)) > 0.2 THEN 'zh' ELSE 'en' END AS language, sum(length(text))::BIGINT AS n FROM documents GROUP BY source",
    "html_plain_text": r"""WITH t AS (
  SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?i)</(td|th|tr|p|div|li|h[1-6])>|<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) AS p FROM pages)
SELECT page_id, md5(p) AS digest, length(p)::INT AS n_chars FROM t""",
    "content_hash_dupes": "SELECT 'sha256:' || sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1",
    "section_assign": f"WITH {BLOCKS} SELECT doc_id, block_id, max(CASE WHEN type = 'heading' THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS section FROM blocks",
    "section_tree_parent": f"WITH {PARENTS} SELECT doc_id, ord, level, parent FROM parents",
    "section_root": f"""WITH RECURSIVE {PARENTS}, climb AS (
  SELECT doc_id, ord, ord AS top_, parent FROM parents
  UNION ALL SELECT c.doc_id, c.ord, p.ord, p.parent FROM climb c JOIN parents p ON p.doc_id = c.doc_id AND p.ord = c.parent)
SELECT doc_id, ord, top_ AS root FROM climb WHERE parent IS NULL""",
    "block_ranges": f"""WITH {BLOCKS}, s AS (SELECT *, max(CASE WHEN type = 'heading' THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS section FROM blocks)
SELECT doc_id, section, arg_min(block_id, ord) AS first_id, arg_max(block_id, ord) AS last_id, count(*) AS n_blocks FROM s GROUP BY doc_id, section""",
    "section_groups": f"""WITH {BLOCKS}, c AS (SELECT *, {TOKENS} + 4 AS cost, ord - row_number() OVER (PARTITION BY doc_id, type ORDER BY ord) AS grp FROM blocks),
g AS (SELECT doc_id, type, grp, min(ord) AS first_ord, count(*) AS n_blocks, sum(cost)::BIGINT AS cost FROM c GROUP BY doc_id, type, grp)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_ord) AS run, type, first_ord, n_blocks, cost FROM g""",
    "prev_paragraph": f"""WITH {BLOCKS}, w AS (
  SELECT doc_id, ord, type, max(CASE WHEN type IN ('paragraph', 'abstract') THEN ord END) OVER r AS before, max(CASE WHEN type = 'heading' THEN ord END) OVER r AS heading
  FROM blocks WINDOW r AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, ord, CASE WHEN coalesce(heading, -1) < before THEN before END AS previous FROM w WHERE type = 'paragraph'""",
    "reference_mark": f"""WITH {BLOCKS}, h AS (SELECT b.doc_id, b.type, (SELECT contains(lower(arg_max(x.text, x.ord)), 'the') FROM blocks x WHERE x.doc_id = b.doc_id AND x.type = 'heading' AND x.ord <= b.ord) AS flag FROM blocks b)
SELECT doc_id, CASE WHEN type = 'paragraph' AND coalesce(flag, false) THEN 'reference_entry' ELSE type END AS type, count(*) AS n FROM h GROUP BY ALL""",
    "chunk_pack": f"""WITH RECURSIVE {BLOCKS},
s AS (SELECT *, coalesce(max(CASE WHEN type = 'heading' THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord), -1) AS section FROM blocks),
c AS (SELECT doc_id, ord, section, ({TOKENS})::INT AS tokens, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM s WHERE type <> 'heading'),
f AS (SELECT doc_id, ord, section, tokens, n, 0 AS chunk, tokens AS fill FROM c WHERE n = 1
  UNION ALL SELECT c.doc_id, c.ord, c.section, c.tokens, c.n,
    CASE WHEN f.fill + c.tokens > 256 OR c.tokens > 480 OR f.tokens > 480 OR c.section <> f.section THEN f.chunk + 1 ELSE f.chunk END,
    CASE WHEN f.fill + c.tokens > 256 OR c.tokens > 480 OR f.tokens > 480 OR c.section <> f.section THEN c.tokens ELSE f.fill + c.tokens END
  FROM f JOIN c ON c.doc_id = f.doc_id AND c.n = f.n + 1)
SELECT doc_id, chunk, min(ord) AS first_ord, max(ord) AS last_ord, sum(tokens)::BIGINT AS tokens FROM f GROUP BY doc_id, chunk""",
    "chunk_text_hash": f"WITH {BLOCKS} SELECT doc_id, block_id, sha256(text) AS text_hash FROM blocks",
    "decoration_repeat": rf"""WITH {ANCHORS}, k AS (SELECT doc_id, page, regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '[ \t\n\r]+', '', 'g') AS key FROM anchored WHERE y1 <= 79.2 OR y0 >= 712.8 OR x1 <= 48.96 OR x0 >= 563.04)
SELECT doc_id, key, count(DISTINCT page) AS pages FROM k GROUP BY doc_id, key HAVING count(DISTINCT page) >= 2""",
    "decoration_boilerplate": rf"""WITH {BLOCKS}, f AS (SELECT doc_id, block_id, length(text) AS n, regexp_matches(lower(text), 'https?://|www\.') AS url, regexp_matches(lower(text), 'copyright|license|all rights reserved|permission') AS rights FROM blocks)
SELECT doc_id, block_id, url, rights FROM f WHERE n <= 400 AND (url OR rights)""",
    "caption_nearest": f"""WITH {ANCHORS}, r AS (
  SELECT a.doc_id, a.ord AS caption, b.ord AS target, row_number() OVER (PARTITION BY a.doc_id, a.ord ORDER BY abs(a.y0 - b.y0) + 2 * abs(b.ord - a.ord), b.ord) AS rn
  FROM anchored a JOIN anchored b ON a.doc_id = b.doc_id AND a.page = b.page WHERE a.type = 'heading' AND b.type = 'paragraph')
SELECT doc_id, caption, target FROM r WHERE rn = 1""",
    "validate_blocks": f"""WITH {BLOCKS}
SELECT doc_id, block_id, 'empty' AS rule FROM blocks WHERE trim(text) = ''
UNION ALL SELECT doc_id, block_id, 'long' FROM blocks WHERE length(text) > 2000
UNION ALL SELECT doc_id, block_id, 'unclosed' FROM blocks WHERE length(replace(text, '(', '')) <> length(replace(text, ')', ''))""",
    "export_markdown_body": f"""WITH {BLOCKS}
SELECT doc_id, md5(string_agg(CASE type WHEN 'title' THEN '# ' || text WHEN 'heading' THEN repeat('#', level + 1) || ' ' || text ELSE text END, chr(10) || chr(10) ORDER BY ord)) AS digest FROM blocks GROUP BY doc_id""",
    "point_in_block": f"""WITH {ANCHORS}, g AS (
  SELECT doc_id, page, ord, block_id, CASE WHEN y0 <= 131 AND y1 >= 131 THEN 0 ELSE 1 END AS outside, greatest(0.0::DOUBLE, y0 - 131, 131 - y1) AS gap FROM anchored),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY outside, gap, ord DESC) AS rn FROM g WHERE outside = 0 OR gap <= 8)
SELECT doc_id, page, block_id FROM r WHERE rn = 1""",
    "span_merge": f"""WITH {BLOCKS}, sp AS (SELECT doc_id, ord * 13 AS a, (ord * 13 + length(text) % 40)::INT AS b FROM blocks),
o AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM sp),
n AS (SELECT *, sum(CASE WHEN coalesce(top, -1) < a THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM o)
SELECT doc_id, min(a)::INT AS a, max(b)::INT AS b FROM n GROUP BY doc_id, run""",
    "library_list_sorted": f"WITH {ITEMS} SELECT item_id, title, balance FROM items WHERE status = 'active' ORDER BY balance DESC NULLS LAST, title LIMIT 50 OFFSET 10",
    "library_search_ilike": f"WITH {ITEMS} SELECT item_id, title FROM items WHERE contains(lower(title), 'r#00000000')",
    "collection_counts": f"WITH {ITEMS} SELECT n_nationkey AS collection_id, n_name AS name, count(item_id) AS n_items FROM nation LEFT JOIN items ON collection_id = n_nationkey AND status = 'active' GROUP BY ALL",
    "collection_descendants": f"WITH {ITEMS} SELECT r_name, count(*) AS n_items FROM items JOIN nation ON collection_id = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "item_detail_nested": "SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS parts FROM lineitem GROUP BY l_orderkey",
    "eav_pivot": "SELECT p_partkey, p_brand AS brand, p_type AS type, p_size::VARCHAR AS size FROM part",
    "archive_anti_join": f"WITH {ITEMS} SELECT item_id, title FROM items WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = item_id)",
    "needs_parse": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('P', 'F') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')",
    "doc_status_counts": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS ready, count(*) FILTER (o_orderstatus = 'O') AS pending FROM orders GROUP BY 1",
    "snapshot_merge": """WITH o AS (SELECT c_custkey AS key, c_nationkey AS v FROM customer WHERE c_custkey % 7 <> 1), n AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 5 <> 2)
SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'archived' WHEN o.v <> n.v THEN 'updated' ELSE 'unchanged' END AS change, coalesce(n.v, o.v)::INT AS version FROM o FULL JOIN n ON o.key = n.key""",
    "incremental_changed": "SELECT o_orderkey AS key FROM orders WHERE o_orderdate::DATE > DATE '1998-06-01' UNION SELECT l_orderkey FROM lineitem WHERE l_shipdate::DATE > DATE '1998-06-01'",
    "translation_active": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1 AS is_active FROM events",
    "qa_ancestors": f"WITH {UP} SELECT conv_id, node, ancestor, distance FROM up",
    "qa_subtree": f"WITH {UP} SELECT conv_id, node, count(*) AS n FROM (SELECT conv_id, node FROM turns UNION ALL SELECT conv_id, ancestor FROM up) GROUP BY ALL",
    "qa_latest_leaf": f"WITH {TREE} SELECT conv_id, max(node) AS leaf FROM turns t WHERE NOT EXISTS (SELECT 1 FROM turns c WHERE c.conv_id = t.conv_id AND c.parent = t.node) GROUP BY conv_id",
    "qa_sessions_turns": "SELECT conv_id, count(*) FILTER (role = 'user') AS questions, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
    "qa_lag_chain": "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations",
    "citation_normalize": """SELECT conv_id, turn, array_to_string(list_filter([x1, x2, x3], lambda x, i: list_position([x1, x2, x3], x) = i), ',') AS ids
FROM (SELECT conv_id, turn, 'b_' || lpad((turn % 7)::VARCHAR, 4, '0') AS x1, 'b_' || lpad((turn % 3)::VARCHAR, 4, '0') AS x2, 'b_0012' AS x3 FROM conversations)""",
    "citation_coverage": f"WITH {BLOCKS}, t AS (SELECT doc_id, count(*) AS points, count(*) FILTER (regexp_matches(text, '[0-9]')) AS cited FROM blocks WHERE type = 'paragraph' GROUP BY doc_id) SELECT *, round(cited / points, 4) AS coverage FROM t",
    "glossary_hits": f"""WITH {BLOCKS}, terms AS (SELECT unnest(['the', 'der', 'los', 'les']) AS term)
SELECT doc_id, term, count(*) AS blocks FROM blocks, terms WHERE regexp_matches(lower(text), '(^|[^a-z])' || term || '(s|es)?([^a-z]|$)') GROUP BY ALL""",
    "glossary_override": """WITH g AS (SELECT lower(n_name) AS term, n_name AS t FROM nation), b AS (SELECT term, 0 AS s, t FROM g UNION ALL SELECT lower(r_name), 1, r_name || '!' FROM region UNION ALL SELECT term, 1, t || '?' FROM g WHERE term < 'f')
SELECT term, t AS target FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY s DESC, t) AS rn FROM b) WHERE rn = 1""",
    "placeholder_protect_counts": r"""SELECT doc_id, len(regexp_extract_all(text, 'https?://[^ \n]+'))::INT AS urls, len(regexp_extract_all(text, '\[[0-9]+\]'))::INT AS cites, len(regexp_extract_all(text, '`[^`\n]+`'))::INT AS codes FROM documents""",
    "kg_scores": f"WITH {SCORES} SELECT node, score FROM scores",
    "kg_prune": f"""WITH {SCORES}, c AS (SELECT node, score, node[1] = 's' AS concept, row_number() OVER (PARTITION BY node[1] = 's' ORDER BY score DESC, node) AS rn FROM scores)
SELECT node, score, concept FROM c WHERE NOT concept OR rn <= 15 ORDER BY score DESC, node LIMIT 60""",
    "kg_relations_best": f"WITH {REL} SELECT src, dst, type, block, seq, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, type, block ORDER BY confidence DESC, seq) AS rn FROM rel) WHERE rn = 1",
    "kg_link_bundle": f"WITH {REL} SELECT src, dst, type, count(*) AS n, round(max(confidence), 6) AS confidence, CASE WHEN count(*) > 1 THEN type || ' ×' || count(*) ELSE type END AS label FROM rel GROUP BY src, dst, type",
    "kg_numbers_in_text": "WITH f AS (SELECT doc_id, regexp_extract_all(text, '(^|[^A-Za-z0-9_.])([0-9]+)', 2) AS x FROM documents) SELECT doc_id, len(x)::INT AS n, coalesce(list_sum(list_transform(x, lambda y: length(y))), 0)::INT AS digits FROM f",
    "map_blocks_exact": f"WITH {BLOCKS}{NEW} SELECT doc_id, ord, new_ord FROM mapped",
    "lineage_translations": f"WITH {BLOCKS}{NEW} SELECT b.doc_id, count(*) FILTER (m.new_ord IS NULL) AS stale, count(m.new_ord) AS moved, sum(m.new_ord)::BIGINT AS checksum FROM blocks b LEFT JOIN mapped m ON m.doc_id = b.doc_id AND m.ord = b.ord GROUP BY b.doc_id",
    "iou_candidates": f"WITH {PREDICTED} SELECT doc_id, page, g, p, iou FROM good WHERE iou >= 0.5",
    "detection_metrics": f"""WITH {PREDICTED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, g ORDER BY iou DESC, g DESC, p DESC) AS bg, row_number() OVER (PARTITION BY doc_id, page, p ORDER BY iou DESC, g DESC, p DESC) AS bp FROM good WHERE iou >= 0.5),
m AS (SELECT doc_id % 5 AS shift, count(*) AS matched, count(*) FILTER (g_type = p_type) AS rights FROM r WHERE bg = 1 AND bp = 1 GROUP BY 1), n AS (SELECT doc_id % 5 AS shift, count(*) AS gold FROM anchored GROUP BY 1)
SELECT n.shift, gold, coalesce(matched, 0) AS matched, coalesce(rights, 0) AS "right", round(coalesce(matched, 0) / gold, 4) AS recall, CASE WHEN matched > 0 THEN round(rights / matched, 4) END AS type_accuracy FROM n LEFT JOIN m ON n.shift = m.shift""",
    "kendall_tau_pages": f"""WITH {ANCHORS}, r AS (SELECT doc_id || ':' || page AS key, ord AS x, length(text) AS y FROM anchored),
t AS (SELECT a.key, sum(sign(b.y - a.y))::BIGINT AS s, count(*) AS pairs FROM r a JOIN r b ON a.key = b.key AND a.x < b.x GROUP BY a.key) SELECT key, s, pairs, round(s / pairs, 6) AS tau FROM t""",
    "category_rollup": """WITH j AS (SELECT d.*, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id), t AS (SELECT 'all' AS category, quality, n_chars FROM j UNION ALL SELECT lang, quality, n_chars FROM j UNION ALL SELECT source, quality, n_chars FROM j)
SELECT category, count(*) AS n, round(avg(quality), 6) AS quality, median(n_chars)::DOUBLE AS median_chars FROM t GROUP BY category""",
    "consensus_votes": """WITH v AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_returnflag) AS rn FROM v)
SELECT l_partkey, l_returnflag AS vote, n >= 2 AS agreed FROM r WHERE rn = 1""",
    "startup_regression": "SELECT l_returnflag, l_linestatus, CASE WHEN count(*) >= 3 AND var_pop(l_quantity) > 0 THEN round(regr_intercept(l_extendedprice, l_quantity), 2) END AS intercept, CASE WHEN count(*) >= 3 AND var_pop(l_quantity) > 0 THEN round(regr_slope(l_extendedprice, l_quantity), 4) END AS slope FROM lineitem GROUP BY ALL",
    "usage_report": f"WITH {CALLS} SELECT task, prompt, count(*) AS n, sum(cache_hit::INT)::BIGINT AS hits, sum(input)::BIGINT AS input, sum(cached)::BIGINT AS cached, round(sum(cache_hit::INT) / count(*), 6) AS hit_share FROM calls GROUP BY GROUPING SETS ((task, prompt), ())",
    "job_latest_state": f"WITH {STATES} SELECT job, kind, status, depends_on, event_id FROM states",
    "job_claimable": f"WITH {STATES} SELECT s.job, s.kind FROM states s LEFT JOIN states d ON d.job = s.depends_on WHERE s.status = 'queued' AND (s.depends_on IS NULL OR d.status = 'done')",
    "job_admission": f"""WITH {STATES}, b AS (SELECT kind, count(*) AS busy FROM states WHERE status = 'running' GROUP BY kind), q AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY created, job) AS k FROM states WHERE status = 'queued')
SELECT job, kind FROM q LEFT JOIN b USING (kind) WHERE k <= CASE WHEN kind IN ('k0', 'k1', 'k2') THEN 1000 ELSE 1 END - coalesce(busy, 0)
ORDER BY created, job LIMIT (SELECT greatest(0, 1000 - coalesce(sum(busy), 0))::BIGINT FROM b)""",
    "usage_windows": f"WITH {CALLS} SELECT date_trunc('hour', ts) AS hour, task, count(*) AS n, sum(input)::BIGINT AS input FROM calls GROUP BY ALL",
}
