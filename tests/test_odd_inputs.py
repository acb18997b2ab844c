"""Queries on inputs that the driver's tables don't hold, and plans that must hold at any size."""

from __future__ import annotations

import random
import re

import pytest

from doclake.operators import dictionary, extraction, layout, lineage, trees
from doclake.plans.oracles import ORACLES
from doclake.plans.queries import QUERIES
from doclake.sources import tables as S

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def against_sql(spark, tmp_path):
    """The rows of a query over some tables, and those of its SQL."""
    import duckdb

    def both(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        found = QUERIES[name](spark, str(tmp_path))
        columns = ", ".join(f'"{c}"' for c in found.columns)
        return sorted(map(tuple, found.collect()), key=repr), sorted(con.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall(), key=repr)

    return both


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], DOCS)


def test_quotes_break_at_line_feeds_only(spark, against_sql):
    texts = ["", "\n", "a", "a\n", "a\nb\n\n", "a\r\nb", "a\rb", "a\u0085b c d", "\r\n\r", None]
    found, wanted = against_sql("markdown_quote", documents=documents(spark, texts))
    assert found == wanted and len(found) == 9


def climbed(parents):
    """Plain climbing, step by step."""
    roots = {}
    for start in parents:
        at, seen = start, set()
        while parents.get(at) is not None and at not in seen:
            seen.add(at)
            at = (at[0], parents[at])
        roots[start] = at[1]
    return sorted((t, i, r) for (t, i), r in roots.items())


def test_roots_of_long_ways_and_cycles(spark):
    draw = random.Random(5)
    parents = {(0, i): i - 1 if i else None for i in range(150)}  # a chain
    parents |= {(1, i): i - 1 if i else 60 for i in range(90)}  # a cycle of 61 and a way of 29 into it
    parents |= {(2, i): draw.choice([None, -7, draw.randrange(40), draw.randrange(40), i]) for i in range(40)}
    nodes = spark.createDataFrame([(t, i, p) for (t, i), p in parents.items()] * 2, "tree long, id long, parent long")
    found = trees.climbed_roots(nodes)
    assert sorted(map(tuple, found.collect())) == climbed(parents)
    assert trees.climbed_roots(nodes.where("false")).count() == 0
    assert "BroadcastHashJoin" not in trees._twice(trees.saved_large(found.withColumn("at", found.root).selectExpr("tree", "id", "at", "true AS open"), "way"))._jdf.queryExecution().sparkPlan().toString()


def test_glossary_capitals_are_those_of_sql(spark, against_sql):
    texts = ["ßa ŉb ﬁc ᾳd über x", "Straße fiel. ŉb"]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(["ßa x", "ŉb", "ﬁc", "ᾳd", "über", "x"])], "item_id long, text string")
    found, wanted = against_sql("glossary_blocks", documents=documents(spark, texts), benchmark=benchmark)
    assert found == wanted and [r[2] for r in found] == [6, 2]


def test_own_terms_are_looked_up_in_their_documents_only(spark, monkeypatch):
    asked = []
    uses = dictionary.uses
    monkeypatch.setattr(dictionary, "uses", lambda texts, terms, *a, **b: asked.extend(r["term"] for r in terms.collect()) or uses(texts, terms, *a, **b))
    texts = spark.createDataFrame([(d, "b", "aa bb") for d in range(3)], "doc_id long, block_id string, text string")
    terms = spark.createDataFrame([(0, "aa", "x"), (1, "bb", "y"), (None, "aa", "z")], "doc_id long, term string, target string")
    found = sorted(map(tuple, dictionary.glossary(texts, terms, 9).collect()))
    assert found == [(0, "b", "aa", "x", 1), (1, "b", "aa", "z", 1), (1, "b", "bb", "y", 2), (2, "b", "aa", "z", 1)] and asked == ["aa"]


@pytest.mark.parametrize("most", [0, 9])
def test_texts_stay_in_tasks(spark, most):
    texts = spark.createDataFrame([(1, "a ß é", 7), (2, None, 8)], "id long, text string, n int")
    terms = spark.createDataFrame([("ß",), ("a",)], "term string")
    found = dictionary.uses(texts, terms, most_terms=most, keep_text=False)
    assert found.columns == ["id", "n", "term"] and sorted(map(tuple, found.collect())) == [(1, 7, "a"), (1, 7, "ß")]


def test_what_no_term_wants_does_not_leave_a_task(spark):
    texts = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500)) + " needle")], "id long, text string")
    plan = dictionary.uses(texts, spark.createDataFrame([("needle",)], "term string"), most_terms=0)
    assert plan.count() == 1
    assert dictionary._anchors("Boxes", True) >= {"wbox", "wboxe", "wboxes", "cb", "cbo"} and dictionary._anchor("a needle") == "wneedle" and dictionary._anchor(" é t") == "cé "


def test_quotes_meet_each_text_once(spark, against_sql):
    line = lambda *words: " ".join(f"word{w}" for w in words)
    texts = ["\n".join([line(*range(9)), line(3, 4, 5), line(1, 1, 1), line(1, 1, 1, 1), "short", line(*range(60))]), "\n".join(line(i, i + 1, i + 2, i) for i in range(30)), None, ""]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 1").selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "n_chars"))
    found, wanted = against_sql("annotation_relocate", documents=docs)
    assert found == wanted and len(found) > 60
    quotes = spark.createDataFrame([(0, 0, "abc")], "doc_id long, at int, quote string")
    plan = lineage.relocated(quotes, spark.createDataFrame([(0, 0, "abcabc")], "doc_id long, new_ord int, text string"))
    assert plan.collect()[0]["new_ord"] == 0 and "Generate" not in plan._jdf.queryExecution().optimizedPlan().toString()


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_large_tables_do_not_go_through_the_driver(spark, data):
    blocks = S.blocks(S.table(spark, data, "documents"))
    old = S.anchors(blocks).withColumn("id", blocks.block_id)
    assert "BroadcastHashJoin" not in plan_of(lineage.mapped(old, old))
    rows = blocks.selectExpr("doc_id", "0 AS grp", "ord", "block_id", "text")
    replies = rows.groupBy("doc_id", "grp").agg({"block_id": "min"}).selectExpr("doc_id", "grp", """'{"entities": [], "relations": []}' AS reply""")
    nodes, edges, faults = extraction.document_graph(replies, rows)
    assert not any("BroadcastHashJoin" in plan_of(df) for df in (nodes, edges, faults, *extraction.pruned(nodes, edges)))


def test_a_table_is_one_row_and_no_table_is_written(spark, monkeypatch):
    monkeypatch.setattr(layout, "saved", lambda *_: pytest.fail("a table is written"))
    cells = [("a", 0, 0, 2, 2, True, "x<"), ("a", 0, 2, 1, 3, None, "'"), ("a", 1, 1, 2, 2, False, "under"), ("a", 2, 0, None, 2, False, None), ("a", 0, 0, 9, 9, True, None), ("b", 1, 1, 2, 2, False, "z")]
    frame = spark.createDataFrame(cells, "table_id string, row int, col int, row_end int, col_end int, header boolean, text string")
    found = dict(map(tuple, layout.table_html(frame.where("coalesce(row_end, 0) < 9")).collect()))
    assert found["a"] == '<table><tr><th rowspan="2" colspan="2">x&lt;</th><td>&#x27;</td></tr><tr><td></td></tr></table>'
    assert found["b"] == "<table><tr><td></td><td></td></tr><tr><td></td><td>z</td></tr></table>"
    assert dict(map(tuple, layout.table_html(frame.where("table_id = 'b'"), spark.createDataFrame([("b", 3, 1)], "table_id string, rows int, cols int")).collect()))["b"] == "<table><tr><td></td></tr><tr><td></td></tr><tr><td></td></tr></table>"


def test_texts_move_once(spark, data):
    """What a context or a table is made of is dealt out by its document or order, and not again."""
    for name in ("context_assembled", "table_grid"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        keys = {k.split("#")[0] for k in re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)}
        assert keys == ({"doc_id"} if name == "context_assembled" else {"table_id"}) and "," not in "".join(re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan))
