"""DuckDB SQL of the further queries."""

from __future__ import annotations

from doclake.plans.oracles import ANCHORS, BLOCKS, CALLS, NEW, ORACLES, PREDICTED, REL, SCORES, STATES, TOKENS

ORACLES |= {
    "search_rrf": f"""WITH a AS (SELECT doc_id, length(text) AS n, {TOKENS} AS t FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY n DESC, doc_id) AS rank FROM a QUALIFY rank <= 50), s AS (SELECT doc_id, row_number() OVER (ORDER BY t DESC, doc_id) AS rank FROM a QUALIFY rank <= 50)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*)::INT AS n_sources FROM (SELECT * FROM r UNION ALL SELECT * FROM s) GROUP BY doc_id""",
    "context_neighbours": f"""WITH {BLOCKS}, s AS (SELECT doc_id, ord, text, coalesce(max(CASE WHEN type = 'heading' THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord), -1) AS section FROM blocks)
SELECT a.doc_id, a.ord AS hit_ord, b.ord FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.section = b.section AND abs(a.ord - b.ord) = 1 WHERE contains(a.text, 'tion')""",
    "context_budget": f"WITH {BLOCKS}, c AS (SELECT doc_id, sum({TOKENS} + 4) OVER (PARTITION BY doc_id ORDER BY ord) AS spent FROM blocks) SELECT doc_id, count(*) AS n, max(spent)::BIGINT AS spent FROM c WHERE spent <= 200 GROUP BY doc_id",
    "placeholder_check": rf"""WITH {BLOCKS}, w AS (SELECT doc_id, ord, unnest(regexp_extract_all(text, '([a-z]+)', 1)) AS k, 1 AS n FROM blocks UNION ALL SELECT doc_id, ord, unnest(regexp_extract_all(regexp_replace(text, '\bthe\b', '', 'g'), '([a-z]+)', 1)), -1 FROM blocks),
g AS (SELECT doc_id, ord, k, sum(n) AS n FROM w GROUP BY ALL HAVING sum(n) <> 0) SELECT doc_id, sum(n)::BIGINT AS missing, count(*) AS kinds FROM g GROUP BY doc_id""",
    "version_diff": f"""WITH {BLOCKS}{NEW}, o AS (SELECT DISTINCT doc_id, text FROM blocks), n AS (SELECT DISTINCT doc_id, text FROM fresh)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, count(*) FILTER (o.text IS NOT NULL AND n.text IS NOT NULL) AS kept, count(*) FILTER (n.text IS NULL) AS dropped, count(*) FILTER (o.text IS NULL) AS added
FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.text = n.text GROUP BY 1""",
    "annotation_relocate": f"""WITH {BLOCKS}{NEW}, q AS (SELECT doc_id, ord AS at_, text AS quote FROM blocks WHERE length(text) > 20 AND len(string_split(text, ' ')) >= 3),
h AS (SELECT q.doc_id, q.at_, count(*) AS n, min(f.new_ord) AS new_ord FROM q JOIN fresh f ON f.doc_id = q.doc_id AND contains(f.text, q.quote) GROUP BY ALL)
SELECT q.doc_id, q.at_ AS "at", CASE WHEN h.n = 1 THEN h.new_ord END AS new_ord FROM q LEFT JOIN h ON h.doc_id = q.doc_id AND h.at_ = q.at_""",
    "engine_regression": f"WITH {PREDICTED} SELECT doc_id, page, count(*) FILTER (iou >= 0.5) AS a, count(*) FILTER (iou >= 0.8) AS b FROM good GROUP BY ALL HAVING count(*) FILTER (iou >= 0.8) BETWEEN 1 AND count(*) FILTER (iou >= 0.5) - 1",
    "document_features": f"WITH {ANCHORS}, p AS (SELECT doc_id, page, sum(length(text)) AS n, count(*) FILTER (type = 'heading') AS h FROM anchored GROUP BY ALL) SELECT doc_id, count(*) AS pages, round(avg(n), 4) AS mean_chars, min(n)::BIGINT AS least_chars, round(avg(h), 4) AS headings FROM p GROUP BY doc_id",
    "best_page": f"""WITH {ANCHORS}, p AS (SELECT doc_id, page, sum(CASE WHEN type = 'heading' THEN 2 ELSE 0 END + CASE WHEN length(text) < 40 THEN 1 ELSE 0 END)::BIGINT AS score FROM anchored GROUP BY ALL)
SELECT doc_id, page, score FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page) = 1""",
    "quota_sample": "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rn FROM documents) SELECT * FROM r WHERE rn <= 5 OR rn % 7 = 0",
    "reference_ids": f"""WITH {BLOCKS}, p AS (SELECT doc_id, ord, length(text) % 50 AS number, row_number() OVER (PARTITION BY doc_id, length(text) % 50 ORDER BY ord) AS again FROM blocks WHERE type = 'paragraph'),
x AS (SELECT *, count(*) FILTER (again > 1) OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM p) SELECT doc_id, ord, CASE WHEN again = 1 THEN 'r_' || number ELSE 'r_x' || k END AS ref FROM x""",
    "continuation_merge": f"""WITH {BLOCKS}, r AS (SELECT *, (count(*) FILTER (NOT regexp_matches(text, '^[a-z]')) OVER (PARTITION BY doc_id ORDER BY ord))::BIGINT AS run FROM blocks)
SELECT doc_id, run, min(ord) AS first_ord, count(*) AS n, md5(string_agg(text, ' ' ORDER BY ord)) AS digest FROM r GROUP BY doc_id, run""",
    "kg_top_edges": f"""WITH {SCORES}, top AS (SELECT * FROM scores ORDER BY score DESC, node LIMIT 40)
SELECT r.src, r.dst, a.score + b.score AS value FROM (SELECT DISTINCT src, dst FROM rel) r JOIN top a ON a.node = r.src JOIN top b ON b.node = r.dst ORDER BY value DESC, src, dst LIMIT 25""",
    "kg_visible": f"WITH {REL} SELECT type, count(*) AS n, count(DISTINCT src) AS sources FROM rel WHERE src IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 25) AND dst IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY type",
    "job_cancel_closure": f"""WITH RECURSIVE {STATES}, gone AS (SELECT job FROM states WHERE status = 'failed' UNION SELECT s.job FROM states s JOIN gone g ON s.depends_on = g.job WHERE s.status = 'queued')
SELECT job FROM states WHERE status = 'queued' AND job IN (SELECT job FROM gone)""",
    "job_queue_positions": f"WITH {STATES} SELECT job, status, row_number() OVER (PARTITION BY status ORDER BY created, job)::INT AS position FROM states WHERE status IN ('queued', 'running')",
    "model_routing": f"""WITH {CALLS}, own AS (SELECT task, min(prompt) AS route FROM calls GROUP BY task), f(task, fallback) AS (VALUES ('click', 'view'), ('view', 'purchase'), ('signup', 'view'), ('error', 'click'), ('purchase', NULL))
SELECT f.task, coalesce(a.route, b.route) AS route FROM f LEFT JOIN own a ON a.task = f.task LEFT JOIN own b ON b.task = f.fallback""",
    "inflight_dedupe": "SELECT user_id, event_type, date_trunc('hour', ts) AS hour, min(event_id) AS answered_by, count(*) AS n FROM events GROUP BY ALL",
    "display_strings": r"""WITH s AS (SELECT doc_id, text, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 40 THEN left(t, 39) || '…' ELSE t END AS title, nullif(regexp_extract(text, '([0-9]{4})', 1), '') AS year FROM s""",
    "retry_delays": "WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error') SELECT event_id, least(pow(2.0::DOUBLE, least(n, 6) - 1), 30.0::DOUBLE) AS delay FROM n",
    "label_agreement": """WITH j AS (SELECT regexp_matches(lower(text), 'idiot|moron|stupid') AS p, toxic = 1 AS t FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM j)
SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall FROM c""",
}
