"""DuckDB SQL of the queries in ``document_queries``; folds have none and are tested on small inputs."""

from __future__ import annotations

from doclake.plans.oracles import ANCHORS, BLOCKS, NEW, ORACLES

MAP = "'b_' || CASE WHEN {0} < 10000 THEN lpad(({0})::VARCHAR, 4, '0') ELSE left(({0})::VARCHAR, 4) END"
OLD, FRESH = MAP.format("ord"), MAP.format("new_ord")

ORACLES |= {
    "glossary_input": f"""WITH {BLOCKS}, p AS (SELECT doc_id, ord, type IN ('heading', 'abstract') AS head, CASE WHEN type = 'heading' THEN '## ' || trim(text, ' ') ELSE text END AS text FROM blocks WHERE type <> 'title'),
u AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY head DESC, ord) AS upto FROM p WHERE text <> '' AND (head OR length(text) >= 40)),
k AS (SELECT doc_id, ord, head, left(text, least(length(text), 12000 - (upto - length(text)))::BIGINT) AS text FROM u WHERE upto <= 12000 OR upto - length(text) <= 9600), j AS (SELECT doc_id, count(*) AS parts, string_agg(text, chr(10) || chr(10) ORDER BY head DESC, ord) AS content FROM k GROUP BY doc_id)
SELECT doc_id, parts, length(content)::INT AS n, md5(content) AS digest FROM j""",
    "lineage_points": f"""WITH {BLOCKS}{NEW}, c AS (SELECT b.doc_id, b.ord, (a.new_ord IS NOT NULL)::INT + (z.new_ord IS NOT NULL)::INT AS n FROM blocks b LEFT JOIN mapped a ON a.doc_id = b.doc_id AND a.ord = b.ord LEFT JOIN mapped z ON z.doc_id = b.doc_id AND z.ord = b.ord + 1 WHERE b.type = 'paragraph')
SELECT doc_id, count(*) AS points, count(*) FILTER (n > 0) AS cited_points, round(count(*) FILTER (n > 0) / count(*), 4) AS coverage, CASE WHEN min(n) < 2 THEN 'stale' ELSE 'ok' END AS status FROM c GROUP BY doc_id""",
    "lineage_answers": f"""WITH {BLOCKS}{NEW}, m AS (SELECT doc_id, ord, {FRESH} AS fresh FROM mapped), c AS (SELECT b.doc_id, b.ord, a.fresh AS one, z.fresh AS two FROM blocks b LEFT JOIN m a ON a.doc_id = b.doc_id AND a.ord = b.ord LEFT JOIN m z ON z.doc_id = b.doc_id AND z.ord = b.ord + 2)
SELECT doc_id, ord AS answer, 'See ' || coalesce('[' || one || ']', '') || ', ' || coalesce('[' || two || ']', '') || '.' AS text, (one IS NOT NULL)::INT AS citations, CASE WHEN one IS NULL OR two IS NULL THEN 'stale' ELSE 'ok' END AS status FROM c""",
    "lineage_mentions": f"WITH {BLOCKS}{NEW} SELECT b.doc_id, b.type, count(*) AS n, min({FRESH}) AS first FROM blocks b JOIN mapped m ON m.doc_id = b.doc_id AND m.ord = b.ord GROUP BY ALL",
    "lineage_sources": f"WITH {BLOCKS}{NEW} SELECT b.doc_id, CASE WHEN m.ord IS NULL THEN 'stale' ELSE 'ok' END AS status, count(*) AS n FROM blocks b LEFT JOIN mapped m ON m.doc_id = b.doc_id AND m.ord = b.ord GROUP BY ALL",
    "golden_corrections": f"""WITH {ANCHORS}, g AS (SELECT doc_id, page, ord::DOUBLE AS ord, CASE WHEN ord % 9 = 4 THEN 'list_item' ELSE type END AS type, text FROM anchored WHERE ord % 7 <> 3 UNION ALL SELECT doc_id, page, ord + 0.5::DOUBLE, 'footnote', 'note' FROM anchored WHERE ord % 10 = 0)
SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY ord, type, text) - 1)::INT AS ord, type, md5(text) AS digest FROM g""",
}
