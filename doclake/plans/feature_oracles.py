"""DuckDB SQL of the queries in ``feature_queries``."""

from __future__ import annotations

from doclake.plans import wide_oracles  # noqa: F401  citation_validity
from doclake.plans.oracles import ANCHORS, BLOCKS, BM25, NEW, ORACLES, PREDICTED


def _scores(terms: list[str], rows: str = "blocks") -> str:
    """CTEs freq, stats and bm: the ranking of any terms over ``rows``."""
    count = [f"((length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)})::DOUBLE AS f{i}" for i, t in enumerate(terms)]
    part = " + ".join(f"ln(1 + (n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in range(len(terms)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    found = ", ".join(f"(count(*) FILTER (f{i} > 0))::DOUBLE AS d{i}" for i in range(len(terms)))
    return f"freq AS (SELECT *, greatest(length(text) - 2, 0)::DOUBLE AS dl, {', '.join(count)} FROM {rows}), stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {found} FROM freq), bm AS (SELECT doc_id, block_id, ord, round({part}, 9) AS score FROM freq, stats WHERE {some})"


def _head(n: int) -> str:
    return rf"trim(regexp_replace(array_to_string(string_split(text, ' ')[1:{n}], ' '), '[.,;:!?\n]+', '', 'g'))"


OUTLINES = """nodes AS (SELECT c_custkey % 25 AS tree, c_custkey AS id, c_mktsegment AS name,
  CASE WHEN c_custkey // 25 % 7 = 3 THEN -1 WHEN c_custkey // 25 > 0 THEN (c_custkey // 25 - 1) // 2 * 25 + c_custkey % 25 WHEN c_custkey % 25 % 5 = 0 THEN c_custkey % 25 + 25 END AS parent FROM customer)"""
TERMS = f"terms AS (SELECT p_name AS term FROM part UNION SELECT {_head(1)} FROM benchmark UNION SELECT {_head(2)} FROM benchmark)"
USES = r"""CASE WHEN NOT contains(lower(text), split_part(lower(term), ' ', 1)) THEN false WHEN regexp_full_match(term, '[A-Za-z0-9_\s\-./+()''’]+') THEN regexp_matches(lower(text), '(^|[^a-z0-9])' || replace(regexp_escape(lower(term)), '\ ', '\s+') || '(e?s)?([^a-z0-9]|$)')
  ELSE contains(lower(regexp_replace(text, '\s+', ' ', 'g')), lower(term)) END"""
FOUND = f"WITH {TERMS} SELECT doc_id, term FROM documents, terms WHERE term <> '' AND {USES}"

ORACLES |= {
    "search_index": f"WITH {BM25} SELECT doc_id, block_id, score FROM hits",
    "search_index_phrase": f"WITH {BLOCKS}, {_scores(['of the', 'ering'])} SELECT doc_id, block_id, score FROM bm",
    "search_index_replaced": f"""WITH {BLOCKS}{NEW}, sources AS (SELECT doc_id, coalesce(source, '') AS source FROM documents),
now AS (SELECT b.doc_id, ord, block_id, text FROM blocks b JOIN sources s ON s.doc_id = b.doc_id WHERE source NOT IN ('src1', 'src2')
  UNION ALL SELECT f.doc_id, new_ord, 'b_' || lpad(new_ord::VARCHAR, 4, '0'), text FROM fresh f JOIN sources s ON s.doc_id = f.doc_id WHERE source = 'src1'),
{_scores(['ing', 'tion'], 'now')} SELECT doc_id, block_id, score FROM bm ORDER BY score DESC, doc_id, ord LIMIT 50""",
    "dictionary_terms": FOUND,
    "dictionary_terms_joined": FOUND,
    "glossary_blocks": f"""WITH {BLOCKS}, everyone AS (SELECT DISTINCT {_head(1)} AS term, upper({_head(1)}) AS target FROM benchmark), own AS (SELECT doc_id, {_head(1)} AS term, {_head(1)} || '!' AS target FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT doc_id, block_id, text, term, target, true AS everywhere FROM blocks, everyone UNION ALL SELECT b.doc_id, block_id, text, term, target, false FROM blocks b JOIN own o ON o.doc_id = b.doc_id),
h AS (SELECT doc_id, block_id, lower(term) AS key, everywhere, term, target FROM pairs WHERE term <> '' AND {USES}),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, block_id, key ORDER BY everywhere, term, target) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY length(term) DESC, term) AS place FROM f)
SELECT doc_id, block_id, count(*) AS n, md5(string_agg(term || '=' || target, ';' ORDER BY place)) AS digest FROM p WHERE place <= 24 GROUP BY doc_id, block_id""",
    "table_grid": """WITH c AS (SELECT l_orderkey AS t, l_linenumber - 1 AS c, min(l_quantity)::INT % 2 = 1 AS tall, min(l_suppkey) % 3 <> 0 AS body, min(l_returnflag) AS h, min(l_linestatus) AS b FROM lineitem GROUP BY 1, 2),
g AS (SELECT t, max(c) AS last FROM c GROUP BY t), p AS (SELECT t, last, unnest(range(last + 1)) AS c FROM g), m AS (SELECT p.*, h, tall, body, b FROM p LEFT JOIN c ON c.t = p.t AND c.c = p.c),
x AS (SELECT t, any_value(last) AS last, string_agg(CASE WHEN h IS NULL THEN '<td></td>' ELSE '<th' || CASE WHEN tall THEN ' rowspan="2"' ELSE '' END || '>' || h || '</th>' END, '' ORDER BY c) AS one,
  coalesce(string_agg(CASE WHEN tall THEN NULL WHEN body THEN '<td>' || b || '&lt;' || c || '</td>' ELSE '<td></td>' END, '' ORDER BY c), '') AS two FROM m GROUP BY t),
html AS (SELECT t, '<table><tr>' || one || '</tr><tr>' || two || '</tr><tr><td' || CASE WHEN last > 0 THEN ' colspan="' || (last + 1) || '"' ELSE '' END || '>&amp; all</td></tr></table>' AS html FROM x)
SELECT t AS table_id, length(html)::INT AS n, md5(html) AS digest FROM html""",
    "mark_segments": f"""WITH {BLOCKS}, c AS (SELECT doc_id, block_id, ord, length(text) AS n, unnest(range(length(text))) AS i FROM blocks),
m AS (SELECT doc_id, block_id, i, CASE WHEN ord % 3 = 0 AND i < n // 2 THEN 2 WHEN i BETWEEN 15 AND 29 THEN 1 WHEN i BETWEEN 5 AND 19 THEN 0 END AS mark FROM c),
t AS (SELECT *, CASE WHEN i > 0 AND lag(mark) OVER w IS NOT DISTINCT FROM mark THEN 0 ELSE 1 END AS turn FROM m WINDOW w AS (PARTITION BY doc_id, block_id ORDER BY i)),
s AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id, block_id ORDER BY i) AS k FROM t)
SELECT doc_id, block_id, min(i)::INT AS start, (max(i) + 1)::INT AS stop, any_value(mark)::INT AS mark FROM s GROUP BY doc_id, block_id, k""",
    "outline_order": f"""WITH RECURSIVE {OUTLINES}, r AS (SELECT tree, id, 0 AS depth, name || chr(1) || lpad(id::VARCHAR, 12, '0') AS path FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes p WHERE p.tree = n.tree AND p.id = n.parent)
  UNION ALL SELECT n.tree, n.id, r.depth + 1, r.path || chr(2) || n.name || chr(1) || lpad(n.id::VARCHAR, 12, '0') FROM r JOIN nodes n ON n.tree = r.tree AND n.parent = r.id)
SELECT tree, id, depth::INT AS depth, (row_number() OVER (PARTITION BY tree ORDER BY path))::INT AS place FROM r""",
    "outline_roots": f"""WITH RECURSIVE {OUTLINES}, w AS (SELECT tree, id, id AS cur, []::BIGINT[] AS seen FROM nodes
  UNION ALL SELECT w.tree, w.id, n.parent, list_append(seen, cur) FROM w JOIN nodes n ON n.tree = w.tree AND n.id = w.cur WHERE n.parent IS NOT NULL AND NOT list_contains(seen, cur))
SELECT tree, id, cur AS root FROM w QUALIFY row_number() OVER (PARTITION BY tree, id ORDER BY len(seen) DESC) = 1""",
    "numbers_stated": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '([A-Za-z][-‐])[0-9]+', '\1_', 'g') AS t FROM documents), f AS (SELECT doc_id, list_transform(regexp_extract_all(t, '(^|[^A-Za-z0-9_.])([-+−]?[0-9]+(?:[.,][0-9]+)*)', 2), lambda x: replace(x, '−', '-')) AS f FROM t),
v AS (SELECT doc_id, list_filter(list_transform(f, lambda x: TRY_CAST(CASE WHEN regexp_full_match(x, '[^,]*(,[^,]{3})*,[^,.]{3}') THEN replace(x, ',', '') WHEN regexp_full_match(x, '[^,.]*,[^,.]*') THEN replace(x, ',', '.') WHEN NOT contains(x, ',') THEN x END AS DOUBLE)), lambda x: x IS NOT NULL) AS v FROM f)
SELECT doc_id, len(v)::INT AS n, list_min(v) AS low, list_max(v) AS high FROM v""",
    "detection_report": f"""WITH {PREDICTED}, shown AS (SELECT * FROM pred WHERE ord % 8 <> 6), q AS (SELECT * FROM good WHERE iou >= 0.5 AND p % 8 <> 6),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, g ORDER BY iou DESC, g DESC, p DESC) AS bg, row_number() OVER (PARTITION BY doc_id, page, p ORDER BY iou DESC, g DESC, p DESC) AS bp FROM q), m AS (SELECT * FROM r WHERE bg = 1 AND bp = 1),
n AS (SELECT type, 1 AS g, 0 AS p, 0 AS m FROM anchored UNION ALL SELECT type, 0, 1, 0 FROM shown UNION ALL SELECT g_type, 0, 0, 1 FROM m WHERE g_type = p_type
  UNION ALL SELECT 'all', 1, 0, 0 FROM anchored UNION ALL SELECT 'all', 0, 1, 0 FROM shown UNION ALL SELECT 'all', 0, 0, 1 FROM m),
t AS (SELECT type, sum(g)::BIGINT AS gold, sum(p)::BIGINT AS pred, sum(m)::BIGINT AS matched FROM n GROUP BY type)
SELECT type, gold, pred, matched, CASE WHEN pred > 0 THEN round(matched / pred, 4) END AS "precision", CASE WHEN gold > 0 THEN round(matched / gold, 4) END AS recall, CASE WHEN gold + pred > 0 THEN round(2 * matched / (gold + pred), 4) END AS f1 FROM t""",
    "kendall_weighted": f"WITH k AS ({ORACLES['kendall_tau_pages']}) SELECT count(*) AS pages, sum(pairs)::BIGINT AS pairs, round(sum(s) / sum(pairs), 6) AS tau FROM k",
    "citation_micro": f"WITH k AS ({ORACLES['citation_validity']}) SELECT sum(points)::BIGINT AS points, round(sum(cited_points) / sum(points), 4) AS coverage, round(sum(valid) / sum(valid + invalid), 4) AS validity FROM k",
    "point_located": f"""WITH {ANCHORS}, r AS (SELECT doc_id, page, ord, x0, y0, 72.0::DOUBLE + ord % 5 * 90.0::DOUBLE + 60.0::DOUBLE AS x1, y1 + ord % 3 * 40.0::DOUBLE AS y1 FROM anchored),
p AS (SELECT DISTINCT doc_id, page, (doc_id * 37 % 560)::DOUBLE AS x, ((doc_id * 53 + page * 17) % 792)::DOUBLE AS y FROM r),
g AS (SELECT r.*, x, y, sqrt(pow(greatest(0.0::DOUBLE, x0 - x, x - x1), 2) + pow(greatest(0.0::DOUBLE, y0 - y, y - y1), 2)) AS gap FROM r JOIN p ON p.doc_id = r.doc_id AND p.page = r.page)
SELECT doc_id, page, ord, round(gap, 6) AS gap FROM g WHERE gap <= 8 QUALIFY row_number() OVER (PARTITION BY doc_id, page, x, y ORDER BY gap > 0, CASE WHEN gap = 0 THEN (x1 - x0) * (y1 - y0) ELSE gap END, CASE WHEN gap = 0 THEN ord ELSE -ord END) = 1""",
    "caption_pairs": f"""WITH {ANCHORS}, s AS (SELECT doc_id, page, ord, ord % 10 AS slot, y0, y1 FROM anchored),
b AS (SELECT doc_id, page, ord, slot, CASE WHEN slot IN (2, 3) THEN 160.0::DOUBLE WHEN slot = 4 THEN 220.0::DOUBLE WHEN slot = 5 THEN 290.0::DOUBLE WHEN slot = 6 THEN 330.0::DOUBLE ELSE y0 END AS y0, CASE WHEN slot IN (2, 3) THEN 280.0::DOUBLE WHEN slot = 4 THEN 232.0::DOUBLE WHEN slot = 5 THEN 320.0::DOUBLE WHEN slot = 6 THEN 450.0::DOUBLE ELSE y1 END AS y1 FROM s),
c AS (SELECT * FROM b WHERE slot IN (4, 5)), o AS (SELECT *, 'figure' AS kind FROM b WHERE slot IN (2, 3) OR (slot = 6 AND doc_id % 3 = 0) UNION ALL SELECT *, 'table' FROM b WHERE slot = 9)
SELECT c.doc_id, c.page, c.ord, o.ord AS target FROM c JOIN o ON o.doc_id = c.doc_id AND o.page = c.page
QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.page, c.ord ORDER BY greatest(0.0::DOUBLE, o.y0 - c.y1, c.y0 - o.y1) + 2 * abs(o.ord - c.ord) + CASE WHEN (c.page % 3 = 1) <> (kind = 'table') THEN 1000 ELSE 0 END, o.ord) = 1""",
    "summary_points": f"""WITH {BLOCKS}, p AS (SELECT b.doc_id, b.ord, CASE b.ord % 3 WHEN 0 THEN 'goal' WHEN 1 THEN 'method' ELSE 'result' END AS section, (n.ord IS NOT NULL)::INT AS next FROM blocks b LEFT JOIN blocks n ON n.doc_id = b.doc_id AND n.ord = b.ord + 1 WHERE b.type = 'paragraph')
SELECT doc_id, section, (row_number() OVER (PARTITION BY doc_id, section ORDER BY ord) - 1)::INT AS place, 'Line ' || ord AS text, 1 + next AS ids, (2 - next)::BIGINT AS invalid FROM p""",
}
