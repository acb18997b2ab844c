"""DuckDB SQL of the queries in ``wide_queries``."""

from __future__ import annotations

from doclake.functions.text import STOP_WORDS
from doclake.plans.oracles import ANCHORS, BLOCKS, CALLS, ITEMS, NEW, ORACLES, REL, STATES

SECTIONS = BLOCKS + ", s AS (SELECT *, max(CASE WHEN type = 'heading' THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS section FROM blocks)"
STOPS = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))

ORACLES |= {
    "fts_terms": rf"""WITH {BLOCKS}, w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^\s"“”‘’，。；：！？、（）]+'), lambda x: regexp_replace(x, '^[''.,;:!?()\[\]{{}}]+|[''.,;:!?()\[\]{{}}]+$', '', 'g')), lambda x: x <> '') AS w FROM blocks WHERE ord = 0),
c AS (SELECT doc_id, w, list_filter(w, lambda x: lower(x) NOT IN ({STOPS})) AS c FROM w), t AS (SELECT doc_id, CASE WHEN len(c) > 0 THEN c ELSE w END AS t FROM c)
SELECT doc_id, len(t)::INT AS n_terms, array_to_string(t, ' ') AS terms FROM t""",
    "fts_index": rf"""WITH {BLOCKS}, b AS (SELECT doc_id, block_id, trim(regexp_replace(text, '[ \t\r\f]+', ' ', 'g')) AS body FROM blocks WHERE type IN ('title', 'abstract', 'paragraph'))
SELECT doc_id, block_id, md5(body) AS digest, length(body)::INT AS n FROM b WHERE length(body) > 0""",
    "search_highlight": rf"""WITH {BLOCKS}, h AS (SELECT doc_id, block_id, text, least(nullif(strpos(lower(text), 'tion'), 0), nullif(strpos(lower(text), 'ing'), 0)) AS at_ FROM blocks), s AS (SELECT *, greatest(0, at_ - 1 - 53) AS start_ FROM h WHERE at_ IS NOT NULL)
SELECT doc_id, block_id, CASE WHEN start_ > 0 THEN '…' ELSE '' END || regexp_replace(substr(text, start_ + 1, 160), '(tion|ing)', chr(2) || '\1' || chr(3), 'gi') || CASE WHEN start_ + 160 < length(text) THEN '…' ELSE '' END AS snippet FROM s""",
    "sentence_split": rf"""WITH {BLOCKS}, p AS (SELECT doc_id, block_id, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?;])\s+', '\1␞', 'g'), '([。！？；])', '\1␞', 'g'), '␞'), lambda x: x <> '') AS p FROM blocks)
SELECT doc_id, block_id, len(p)::INT AS n, coalesce(list_max(list_transform(p, lambda x: length(x))), 0)::INT AS longest FROM p""",
    "embed_reuse": f"""WITH {BLOCKS}{NEW}, o AS (SELECT DISTINCT doc_id, text, 1 AS known FROM blocks)
SELECT f.doc_id, count(o.known) AS reused, count(*) FILTER (o.known IS NULL) AS computed FROM fresh f LEFT JOIN o ON o.doc_id = f.doc_id AND o.text = f.text GROUP BY f.doc_id""",
    "citation_validity": f"""WITH {BLOCKS}, p AS (SELECT doc_id, ord, unnest([ord * 2, ord * 3]) AS cited FROM blocks WHERE type = 'paragraph'), v AS (SELECT p.doc_id, p.ord, count(b.ord) AS valid, count(*) AS n FROM p LEFT JOIN blocks b ON b.doc_id = p.doc_id AND b.block_id = 'b_' || CASE WHEN cited < 10000 THEN lpad(cited::VARCHAR, 4, '0') ELSE left(cited::VARCHAR, 4) END GROUP BY ALL)
SELECT doc_id, count(*) AS points, count(*) FILTER (valid > 0) AS cited_points, sum(valid)::BIGINT AS valid, sum(n - valid)::BIGINT AS invalid, round(count(*) FILTER (valid > 0) / count(*), 4) AS coverage FROM v GROUP BY doc_id""",
    "answer_metrics": r"""WITH a AS (SELECT conv_id, turn, unnest(list_distinct(list_transform(regexp_extract_all(text || ' [b_' || turn || ', B-' || (turn - 1) || '; b_0' || (turn - 1) || ']', '(?i)b[_-]([0-9]+)', 1), lambda x: x::INT))) AS id FROM conversations WHERE role = 'assistant')
SELECT conv_id, count(DISTINCT turn) AS answers, count(*) AS shown, count(*) FILTER (id < turn) AS valid, count(*) FILTER (id >= turn) AS out_of_context FROM a GROUP BY conv_id""",
    "citation_split": rf"""WITH {BLOCKS} SELECT doc_id, block_id, md5(trim(regexp_replace(text || ' [b_0012, B-7；b_12]', '\s*[\[【(（]\s*(?:(?:d_[0-9a-fA-F]+#)?[bB][_-]?[0-9]+[\s,，、;；]*)+[\]】)）]', '', 'g'))) AS digest, 'b_0012,b_0007' AS ids FROM blocks""",
    "query_rewrite": "WITH t AS (SELECT conv_id, turn AS node, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, role, text FROM conversations) SELECT a.conv_id, a.node, md5(concat_ws(' ', a.text, b.text)) AS digest FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND a.parent = b.node WHERE a.role = 'user'",
    "section_change": f"WITH {SECTIONS}, l AS (SELECT doc_id, ord, section, lag(section) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM s WHERE type <> 'heading') SELECT doc_id, ord, section FROM l WHERE section IS NOT NULL AND section IS DISTINCT FROM before",
    "library_page_total": f"WITH {ITEMS} SELECT item_id, title, count(*) OVER () AS total FROM items WHERE status = 'active' ORDER BY title, item_id LIMIT 20 OFFSET 20",
    "translatable_blocks": f"WITH {BLOCKS} SELECT b.doc_id, count(*) AS n FROM blocks b JOIN documents d ON d.doc_id = b.doc_id WHERE lower(split_part(d.lang, '-', 1)) <> 'de' AND trim(b.text) <> '' GROUP BY b.doc_id",
    "job_by_payload": """WITH h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE regexp_extract(props, '"k": *([0-9]+)', 1) = '3') SELECT event_type, event_id FROM h WHERE rn = 1""",
    "parse_decision": """SELECT c_custkey, CASE WHEN c_nationkey % 3 = c_custkey % 3 AND c_acctbal >= 0 THEN 'cached' WHEN c_nationkey % 3 > c_custkey % 3 THEN 'skipped' ELSE 'parse' END AS decision FROM customer""",
    "glossary_junk": r"WITH t AS (SELECT p_partkey, trim(regexp_replace(p_name, '[ \t\n\r\f]+', ' ', 'g')) AS term FROM part) SELECT lower(term) AS term_key, min(p_partkey) AS first, count(*) AS n FROM t WHERE term <> '' AND length(term) <= 200 GROUP BY 1",
    "author_strings": "SELECT c_nationkey, array_to_string(list(c_name ORDER BY c_custkey)[1:3], '; ') || CASE WHEN count(*) > 3 THEN ' et al.' ELSE '' END AS authors FROM customer GROUP BY c_nationkey",
    "latest_summary": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS versions FROM orders) SELECT o_custkey, o_orderpriority, o_orderkey, versions FROM r WHERE rn = 1",
    "sync_truncation_guard": f"WITH {ITEMS} SELECT collection_id, count(*) AS known, count(*) FILTER (status = 'active') AS live, count(*) FILTER (status = 'active') * 2 < count(*) AS refused FROM items GROUP BY collection_id",
    "utc_strings": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS \"at\", ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAYS AS old FROM events",
    "display_fallbacks": r"""WITH f AS (SELECT doc_id, trim(regexp_replace(string_split(text, chr(10))[1], '[ \t\n\r\f]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, length(t) >= 8 AND NOT regexp_matches(lower(t), '\.(pdf|docx?|tex|dvi|ps)$') AS plausible, left(regexp_replace(lower(t), '[^a-z0-9]+', '', 'g'), 60) AS title_key FROM f""",
    "markdown_quote": "SELECT doc_id, md5('> ' || replace(text, chr(10), chr(10) || '> ')) AS digest FROM documents WHERE text IS NOT NULL",
    "kg_relation_dedupe": f"WITH {REL} SELECT src, dst, type, block, seq FROM rel WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src, dst, type, block ORDER BY confidence DESC, seq) = 1",
    "kg_read_model": f"WITH {REL} SELECT src, array_to_string(list_sort(list(DISTINCT block)), ',') AS blocks, array_to_string(list_sort(list(DISTINCT dst))[1:10], ',') AS neighbours FROM rel GROUP BY src",
    "kg_histogram": f"WITH {REL} SELECT type, count(*) AS n, count(DISTINCT block) AS docs FROM rel GROUP BY type",
    "kg_node_radius": f"WITH {REL}, v AS (SELECT dst, count(*) AS value FROM rel GROUP BY dst) SELECT dst, value, round(least(14.0::DOUBLE, 4 + 2.2::DOUBLE * sqrt(value - 1)), 6) AS radius FROM v",
    "hash_unit": "SELECT p_partkey, round(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (xor(a, c) * 16777619::BIGINT) % 4294967296::BIGINT) / 4294967296.0::DOUBLE, 9) AS unit FROM part",
    "bounding_boxes": f"WITH {ANCHORS} SELECT doc_id, page, round(min(y0), 6) AS y0, round(max(y1), 6) AS y1, round(median(y0), 6) AS mid_y0, round(median(y1), 6) AS mid_y1, median(length(text))::DOUBLE AS body_size FROM anchored GROUP BY ALL",
    "medoid_names": """WITH f AS (SELECT a.n_regionkey, a.n_nationkey, a.n_name, round(sum(levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name))), 6) AS far FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY ALL)
SELECT n_regionkey, n_name AS medoid, far FROM f QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY far, n_nationkey) = 1""",
    "bounding_sphere": """WITH v AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings WHERE embedding IS NOT NULL), m AS (SELECT label, round(avg(x), 9) AS mx, round(avg(y), 9) AS my, round(avg(z), 9) AS mz, count(*) AS n FROM v GROUP BY label),
r AS (SELECT label, n, round(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2), 6) AS r FROM v JOIN m USING (label)) SELECT label, n, r AS radius FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY r) = ceil(n * 9 / 10)""",
    "warning_kinds": r"SELECT CASE WHEN regexp_matches(lower(text), 'https?://') THEN 'link' WHEN regexp_matches(lower(text), '[0-9]{4}') THEN 'number' WHEN regexp_matches(lower(text), '\?') THEN 'question' ELSE 'other' END AS kind, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1",
    "key_differences": f"""WITH {BLOCKS}, w AS (SELECT doc_id, ord, list_distinct(regexp_extract_all(text, '([a-z]+)', 1)) AS w FROM blocks WHERE ord < 2)
SELECT a.doc_id, (len(list_filter(a.w, lambda x: NOT list_contains(b.w, x))) + len(list_filter(b.w, lambda x: NOT list_contains(a.w, x))))::INT AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.ord = 0 AND b.ord = 1""",
    "reference_runs": f"""WITH {BLOCKS}, l AS (SELECT *, CASE WHEN type IS DISTINCT FROM lag(type) OVER (PARTITION BY doc_id ORDER BY ord) THEN 1 ELSE 0 END AS new_, regexp_matches(text, '[0-9]') AS hit FROM blocks), r AS (SELECT *, sum(new_) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM l)
SELECT doc_id, count(*) AS n, count(*) FILTER (hit) AS hits, min(ord) FILTER (hit) AS first_hit, max(ord) FILTER (hit) AS last_hit FROM r GROUP BY doc_id, run HAVING count(*) >= 3 AND count(*) FILTER (hit) * 2 >= count(*)""",
    "usage_audit": f"WITH {CALLS} SELECT task, count(*) AS calls, sum(CASE WHEN cache_hit THEN 0 ELSE input END)::BIGINT AS input, sum(CASE WHEN cache_hit THEN 0 ELSE cached END)::BIGINT AS cached FROM calls GROUP BY task",
    "summary_fake_map": f"""WITH {SECTIONS}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY ord) AS rn FROM s WHERE type <> 'heading'), p AS (SELECT doc_id, section, string_agg(block_id, ',' ORDER BY block_id) AS cites FROM f WHERE rn <= 2 GROUP BY ALL)
SELECT doc_id, count(*) AS points, md5(string_agg(cites, ';' ORDER BY coalesce(section, -1))) AS summary FROM p GROUP BY doc_id""",
    "lineage_relations": f"""WITH {BLOCKS}{NEW}, o AS (SELECT doc_id, ord, text, row_number() OVER (PARTITION BY doc_id, text ORDER BY ord) AS k FROM blocks), n AS (SELECT doc_id, new_ord, text, row_number() OVER (PARTITION BY doc_id, text ORDER BY new_ord) AS k FROM fresh),
m AS (SELECT o.doc_id, o.ord FROM o JOIN n ON o.doc_id = n.doc_id AND o.text = n.text AND o.k = n.k)
SELECT b.doc_id, count(*) FILTER (x.ord IS NOT NULL AND y.ord IS NOT NULL) AS moved, count(*) FILTER (x.ord IS NULL OR y.ord IS NULL) AS stale FROM blocks b LEFT JOIN m x ON x.doc_id = b.doc_id AND x.ord = b.ord LEFT JOIN m y ON y.doc_id = b.doc_id AND y.ord = b.ord - 1 WHERE b.ord > 0 GROUP BY b.doc_id""",
    "job_progress": f"WITH {STATES} SELECT kind, count(*) AS jobs, round(count(*) FILTER (status IN ('done', 'failed')) / count(*), 4) AS progress FROM states GROUP BY kind",
    "job_triggers": f"WITH {STATES} SELECT job, kind FROM states WHERE status = 'done' AND job NOT IN (SELECT depends_on FROM states WHERE depends_on IS NOT NULL)",
    "placeholder_roundtrip": f"WITH {BLOCKS} SELECT doc_id, count(*) AS blocks, count(*) AS restored, count(*) AS with_link FROM blocks GROUP BY doc_id",
}
