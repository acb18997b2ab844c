"""Operators over the blocks of a document, on small inputs with results worked out by hand."""

from __future__ import annotations

import hashlib
import json
import random
import re

from pyspark.sql import functions as F

import doclake.plans  # noqa: F401  registers the queries
from doclake.functions import udfs
from doclake.operators import consensus, context, extraction, lineage
from doclake.operators.blocks import tokens_of
from doclake.operators.dictionary import Finder
from doclake.plans.queries import QUERIES

PLACED = "doc_id long, ord int, block_id string, type string, text string, root int, title string"
SHOWN = "doc_id long, ord int, block_id string, type string, text string, section int, title string"


def block(i, kind="paragraph", section=None, text="word " * 20, title=None, doc=1):
    return (doc, i, f"b_{i:04d}", kind, text, section, title)


def test_groups_of_root_sections(spark):
    rows = [
        block(0, "title", text="A Paper"), block(1, "abstract", text="some text"), block(2, "heading", 2, "1 Introduction", "1 Introduction"), block(3, section=2, text="some text", title="1 Introduction"),
        block(4, "heading", 4, "2 Method", "2 Method"), block(5, section=4, text="some text", title="2 Method"), block(6, "heading", 4, "2.1 Model", "2 Method"), block(7, section=4, text="some text", title="2 Method"),
        block(8, "reference_entry", 8, "", "References"), block(9, section=8, text=None, title="References"),
    ]
    got = context.grouped(spark.createDataFrame(rows, PLACED), 10, 1000).orderBy("grp").collect()
    assert [r["block_ids"] for r in got] == [["b_0000", "b_0001"], ["b_0003"], ["b_0005", "b_0007"]]
    assert got[0]["title"] == "标题与摘要" and got[2]["title"] == "2 Method" and "[b_0007] " in got[2]["content"] and "## 2.1 Model" in got[2]["content"] and "b_0004" not in got[2]["content"]


def test_groups_are_joined_and_cut(spark):
    small = [block(i, section=i, text="some text", title=f"S{i}") for i in (1, 2, 3)]
    large = [block(i, text="word " * 400, doc=2) for i in range(10)]
    got = context.grouped(spark.createDataFrame(small, PLACED), 1000, 6000).collect()
    assert [(r["title"], r["block_ids"]) for r in got] == [("S1、S2、S3", ["b_0001", "b_0002", "b_0003"])] and got[0]["content"].startswith("# S1\n\n[b_0001]")
    cut = context.grouped(spark.createDataFrame(large, PLACED), 300, 600).orderBy("grp").collect()
    assert sum(len(r["block_ids"]) for r in cut) == 10 and all(r["tokens"] <= 600 for r in cut) and cut[1]["title"].endswith("（续）")
    assert context.grouped(spark.createDataFrame([], PLACED)).count() == 0


def test_context_of_hits(spark):
    rows = [block(0, "title", text="A Paper"), block(1, "abstract", text="abstract " * 10), block(2, "heading", 1, "1 Intro"), *[block(i, section=1, title="1 Intro") for i in (3, 4, 5)], block(6, section=2, title="2 Method"), block(7, section=2, text="", title="2 Method")]
    df = spark.createDataFrame(rows, SHOWN)

    def ask(hits, budget):
        return context.assembled(df, spark.createDataFrame([(1, b, i) for i, b in enumerate(hits)], "doc_id long, block_id string, rank int"), budget).first()

    wide = ask(["b_0005", "b_0007", "b_0005"], 1000)
    assert wide["block_ids"] == ["b_0001", "b_0004", "b_0005"] and "## 1 Intro" in wide["content"] and "[b_0005] " in wide["content"]
    assert wide["tokens"] == sum(tokens_of(t) + 4 for t in ("abstract " * 10, "word " * 20, "word " * 20))
    tight = ask(["b_0005", "b_0003"], 40)
    assert "b_0005" in tight["block_ids"] and tight["tokens"] <= 40
    assert ask([], 60)["block_ids"][:2] == ["b_0000", "b_0001"]


def test_glossary_input(spark):
    rows = [block(0, "title", text="T"), block(1, "abstract", text="a" * 30), block(2, "heading", 2, " H "), block(3, text="short"), block(4, text="b" * 50), block(5, text="c" * 50)]
    df = spark.createDataFrame(rows, PLACED)
    assert [r["content"] for r in context.glossary_input(df, 12000).collect()] == ["\n\n".join(("a" * 30, "## H", "b" * 50, "c" * 50))]
    assert [r["content"] for r in context.glossary_input(df, 100).collect()] == ["\n\n".join(("a" * 30, "## H", "b" * 50))]  # 84 of 100 are there
    assert [r["content"] for r in context.glossary_input(df, 120).collect()] == ["\n\n".join(("a" * 30, "## H", "b" * 50, "c" * 36))]


def test_names_quotations_and_values():
    assert udfs.name_and_acronym("Bidirectional Encoder (BERT)") == ["Bidirectional Encoder", "BERT"] and udfs.name_and_acronym("x (two words)") == ["x (two words)"]
    longest = lambda names, text: next(iter(Finder([n for n in names if len(n) > 1], plural=False).of(text)), None)
    assert longest(["BERT"], "RoBERTa is strong") is None and longest(["BERT", "BERT  base"], "the bert\nBase model") == "BERT  base" and longest(["保真度"], "同义保真度") == "保真度"
    there = lambda e, t: (p := udfs.quotation(e)) is not None and p.search(udfs.bare(t)) is not None
    assert there("achieves  85.3 … WMT", "It Achieves 85.3 BLEU on WMT14") and not there("WMT … achieves", "achieves WMT") and not there("…", "anything")
    assert there("a‐b... Ｃ", "A-B\nc") and not there("a.b", "axb")
    assert udfs.table_only('<DIV><Table class="x"><tr><TD colspan="2" style=y rowspan=3>a<br>b</TD></tr></Table>') == '<table><tr><td colspan="2" rowspan="3">ab</td></tr></table>' and udfs.table_only("<p>") is None


def test_forms_of_names(spark):
    rows = spark.createDataFrame([(["ResNet-50", "resnet 50", None, "RN50", "--", "Bidirectional Encoder (BERT)", "bert"] + [f"n{i}" for i in range(12)],), ([],), (None,)], "names array<string>")
    found = rows.withColumn("every", udfs.name_forms("names")).select(extraction._distinct(F.col("every")).alias("f")).collect()
    assert [[a["alias"] for a in r["f"]] for r in found] == [["ResNet-50", "RN50", "Bidirectional Encoder", "BERT", "n0", "n1", "n2", "n3", "n4", "n5"], [], []]


def test_graph_of_replies(spark):
    """What cannot be traced to a block, or states a number that isn't there, is dropped and counted."""
    reply = {
        "entities": [{"id": "e1", "type": "model", "name": "FooNet", "block_ids": ["b_1"]}, {"id": "e2", "type": "Metric", "name": "BLEU"}, {"id": "e3", "type": "Dataset", "name": "WMT14"}, {"id": "e4", "type": "Model", "name": "BERT"}, {"id": "e5", "type": "Planet", "name": "Mars"}],
        "relations": [
            {"src": "e1", "dst": "e2", "type": "achieves", "block_id": "b_0001", "attrs": {"value": "85.3"}, "evidence": "achieves  85.3 bleu"},
            {"src": "e1", "dst": "e2", "type": "achieves", "block_id": "b_0001", "attrs": {"value": "86"}},
            {"src": "e1", "dst": "e3", "type": "evaluated on", "block_id": "b_0003"},
            {"src": "e1", "dst": "e3", "type": "evaluated-on", "block_id": "B_0001", "evidence": "nowhere", "confidence": 0.9},
            {"src": "e1", "dst": "e9", "type": "uses", "block_id": "b_0001"},
        ],
    }
    blocks = spark.createDataFrame([(1, g, b, t) for g in (0, 1) for b, t in (("b_0001", "FooNet achieves 85.3 BLEU on WMT14."), ("b_0002", "RoBERTa is strong."))], "doc_id long, grp int, block_id string, text string")
    replies = spark.createDataFrame([(1, 0, json.dumps(reply)), (1, 1, json.dumps({"entities": [{"type": "Model", "name": "foonet (FN)", "block_ids": "b_2"}, {"type": "model", "name": "FN", "block_ids": ["b_2"]}]})), (2, 0, "no json"), (3, 0, None)], "doc_id long, grp int, reply string")
    nodes, edges, faults = extraction.document_graph(replies, blocks)
    got = {r["entity"]: r for r in nodes.collect()}
    assert [got[i]["name"] for i in range(3)] == ["FooNet", "BLEU", "WMT14"] and len(got) == 3
    assert got[0]["type"] == "Model" and got[0]["aliases"] == ["FooNet", "FN"] and got[0]["block_ids"] == ["b_0001", "b_0002"]
    found = {(r["src"], r["dst"], r["type"]): r for r in edges.collect()}
    assert set(found) == {(0, 1, "achieves"), (0, 2, "evaluated_on")}
    assert (found[0, 1, "achieves"]["value"], found[0, 1, "achieves"]["value_text"], found[0, 1, "achieves"]["evidence"]) == (85.3, "85.3", "achieves 85.3 bleu")
    assert (found[0, 2, "evaluated_on"]["evidence"], found[0, 2, "evaluated_on"]["confidence"]) == ("", 0.63)
    assert {r["fault"]: r["n"] for r in faults.collect()} == {"bad_entities": 2, "unverified_values": 1, "no_source": 1, "bad_relations": 1, "unsupported_evidence": 1}
    kept, between = extraction.pruned(nodes, edges, most=2)
    assert {r["entity"] for r in kept.collect()} == {0, 1} and [(r["src"], r["dst"]) for r in between.collect()] == [(0, 1)]


def test_few_concepts_stay(spark):
    nodes = spark.createDataFrame([(1, i, "Concept" if i % 2 else "Model", ["a", "b"] if i < 6 else ["a"]) for i in range(8)], "doc_id long, entity int, type string, block_ids array<string>")
    edges = spark.createDataFrame([(1, 0, 7)], "doc_id long, src int, dst int")
    kept, _ = extraction.pruned(nodes, edges, most=4, concepts=1)
    assert {r["entity"]: r["score"] for r in kept.select("entity", F.col("score").cast("int").alias("score")).collect()} == {0: 4, 7: 3, 2: 2, 4: 2}


# --- a new version of a document ---


def mapping(spark):
    return spark.createDataFrame([(1, "b_0000", "b_0001"), (1, "b_0002", "b_0003")], "doc_id long, old string, new string")


def test_points_and_answers_move(spark):
    points = spark.createDataFrame([(1, 7, 0, ["b_0000", "b_0001"]), (1, 7, 1, ["b_0009"]), (1, 8, 0, ["b_0002", "b_0000"]), (2, 9, 0, [])], "doc_id long, summary int, point int, block_ids array<string>")
    moved = lineage.moved_points(points, mapping(spark))
    got = {(r["summary"], r["point"]): (r["block_ids"], r["untraced"]) for r in moved.collect()}
    assert got == {(7, 0): (["b_0001"], False), (7, 1): ([], True), (8, 0): (["b_0003", "b_0001"], False), (9, 0): ([], True)}
    assert {r["summary"]: (r["cited_points"], r["coverage"], r["status"]) for r in lineage.summary_status(moved).collect()} == {7: (1, 0.5, "stale"), 8: (1, 1.0, "ok"), 9: (0, 0.0, "ok")}
    answers = spark.createDataFrame([(1, 0, "[b_0000] so [b_0002].", ["b_0000"]), (1, 1, "x [b_0009] y", []), (1, 2, "no mark", ["b_0009"])], "doc_id long, answer int, text string, citations array<string>")
    assert {r["answer"]: (r["text"], r["citations"], r["status"]) for r in lineage.moved_answers(answers, mapping(spark)).collect()} == {0: ("[b_0001] so [b_0003].", ["b_0001"], "ok"), 1: ("x  y", [], "stale"), 2: ("no mark", [], "stale")}


def test_graph_moves(spark):
    rows = spark.createDataFrame([(1, "b_0000", "a"), (1, "b_0001", "b")], "doc_id long, block_id string, name string")
    assert [(r["block_id"], r["name"]) for r in lineage.moved_mentions(rows, mapping(spark)).collect()] == [("b_0001", "a")]
    assert {(r["block_id"], r["name"], r["status"]) for r in lineage.moved_relations(rows, mapping(spark)).collect()} == {("b_0001", "a", "ok"), ("b_0001", "b", "stale")}


def test_annotations_move(spark):
    blocks = spark.createDataFrame([(1, "b_0001", "the cat and the dog and the cow"), (1, "b_0003", "only here: fox"), (1, "b_0004", "fish fish"), (1, "b_0005", "fish")], "doc_id long, block_id string, text string")
    notes = [
        (1, 0, "b_0000", 4, 7, "cat"), (1, 1, "b_0000", 18, 21, "the"), (1, 2, "b_0000", 0, 3, "fox"), (1, 3, "b_0000", 0, 4, "fish"), (1, 4, "b_0002", None, None, "old text"),
        (1, 5, "b_0008", None, None, "gone"), (1, 6, "b_0008", 3, 6, "cow"),
    ]
    got = {r["note"]: (r["block_id"], r["start"], r["stop"], r["quote"], r["status"]) for r in lineage.moved_annotations(spark.createDataFrame(notes, "doc_id long, note int, block_id string, start int, stop int, quote string"), mapping(spark), blocks).collect()}
    assert got == {
        0: ("b_0001", 4, 7, "cat", "ok"), 1: ("b_0001", 12, 15, "the", "ok"), 2: ("b_0003", 11, 14, "fox", "ok"), 3: ("b_0001", 0, 4, "fish", "stale"),
        4: ("b_0003", None, None, "only here: fox", "ok"), 5: ("b_0008", None, None, "gone", "stale"), 6: ("b_0001", 28, 31, "cow", "ok"),
    }


# --- several parsers ---


def test_consensus(spark):
    box = lambda y: (0.0, float(y), 100.0, y + 10.0)
    rows = [(1, 0, "a", 0, "heading", *box(0), "Title"), (1, 0, "a", 1, "paragraph", *box(20), "one"), (1, 0, "a", 2, "paragraph", *box(40), "two"), (1, 0, "b", 0, "heading", *box(1), "Title"), (1, 0, "b", 1, "list_item", *box(41), "twoo"), (1, 0, "c", 0, "paragraph", *box(2), "Titl"), (1, 0, "c", 1, "paragraph", *box(60), "three")]
    df = spark.createDataFrame(rows, "doc_id long, page int, engine string, ord int, type string, x0 double, y0 double, x1 double, y1 double, text string")
    got = consensus.consensus_pages(df, ["a", "b", "c"]).orderBy("ord").collect()
    assert [(r["type"], r["support"], r["agreed"], r["text"], r["y0"]) for r in got] == [("heading", 3, True, "Title", 1.0), ("paragraph", 1, False, "one", 20.0), ("paragraph", 2, False, "twoo", 40.5), ("paragraph", 1, False, "three", 60.0)]
    assert {r["leader"] for r in got} == {"a"} and consensus.medoid(["abc", "abd", "xbd"]) == "abd" and consensus.medoid([None, ""]) == ""
    golden = spark.createDataFrame([(1, 0, 0.0, "heading", "t"), (1, 0, 1.0, "paragraph", "p"), (1, 0, 2.0, "other", "x")], "doc_id long, page int, ord double, type string, text string")
    drops, types = golden.where("ord = 2").select("doc_id", "page", "ord"), golden.where("ord = 1").select("doc_id", "page", "ord", F.lit("abstract").alias("new_type"))
    added = spark.createDataFrame([(1, 0, 0.5, "author", "n")], golden.schema)
    assert [(r["ord"], r["type"]) for r in consensus.corrected(golden, drops, types, added).orderBy("ord").collect()] == [(0, "heading"), (1, "author"), (2, "abstract")]


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    draw = random.Random(5)
    for _ in range(300):
        a, b = ("".join(draw.choice("abcé") for _ in range(draw.randint(0, 90))) for _ in range(2))
        assert abs(consensus._distance(a, b) * max(len(a), len(b), 1) - plain(a, b)) < 1e-9


# --- queries without SQL, on the smallest tables ---


def lines(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("text is not null").collect()
    return {r["doc_id"]: r["text"].split("\n") for r in docs}


def kind_of(i, text):
    return "title" if i == 0 else "abstract" if i == 1 else "heading" if len(text) < 80 else "paragraph"


def test_annotation_query(spark, data):
    want = {}
    for doc, old in lines(spark, data).items():
        new = [t + (" (edited)" if i % 11 == 5 else "") for i, t in enumerate(old) if i % 7 != 3]
        free = {}
        for j, t in enumerate(new):
            free.setdefault(t, []).append(j)
        for i, t in enumerate(old):
            to = free[t].pop(0) if free.get(t) else None
            if i == 0:
                want[doc, i] = (0 if to is None else to, None, t if to is None else new[to], "stale" if to is None else "ok")
                continue
            quote, at = t[5:20], (5 if to is not None and t[5:20] else None)
            if at is None and quote:
                holders = [j for j, n in enumerate(new) if quote in n]
                if len(holders) == 1:
                    to, at = holders[0], new[holders[0]].find(quote)
            want[doc, i] = (i if to is None else to, 5 if at is None else at, quote, "stale" if at is None else "ok")
    rows = QUERIES["annotation_migrate"](spark, data).where("note < 10000").collect()
    got = {(r["doc_id"], r["note"]): (int(r["block_id"][2:]), r["start"], r["quote"], r["status"]) for r in rows}
    assert got == want and any(v[3] == "stale" for v in want.values())


def test_graph_query(spark, data):
    """Entities and relations of the stand-in's replies, counted in plain Python."""
    types, want = ["Task", "Method", "Dataset", "Metric", "Model", "Concept"], {}
    for doc, old in lines(spark, data).items():
        groups, section = {}, -1
        for i, t in enumerate(old):
            section = i if kind_of(i, t) == "heading" else section
            if kind_of(i, t) != "heading":
                groups.setdefault(section, []).append((i, t))
        entities, edges = {}, {}
        for section in sorted(groups):
            words = list(dict.fromkeys(re.findall("[A-Za-z]{7,}", groups[section][0][1])))[:5]
            local = []
            for w in words:
                key = (types[len(w) % 6], udfs.normal_name(w))
                spots = {i for i, t in groups[section] if re.search(rf"(?<![A-Za-z0-9]){w}(?![A-Za-z0-9])", t, re.I)} | {groups[section][0][0]}
                entities.setdefault(key, set()).update(spots)
                local.append(key)
            for n, key in enumerate(local):
                if key != local[0]:
                    pair = (local[0], key, groups[section][0][0])
                    edges[pair] = max(edges.get(pair, 0), round(1 - n / 10, 3))
        if entities:
            want[doc] = (len(entities), sum(map(len, entities.values())), len(edges))
    got = {r["doc_id"]: (r["entities"], r["mentions"], r["relations"]) for r in QUERIES["kg_extract"](spark, data).collect()}
    assert got == want


def test_totals_of_queries(spark, data):
    shown = {d: sum(bool(t) and kind_of(i, t) != "heading" for i, t in enumerate(old)) for d, old in lines(spark, data).items()}
    groups = QUERIES["section_groups_budget"](spark, data).groupBy("doc_id").agg(F.sum("blocks").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in groups} == {d: n for d, n in shown.items() if n}
    contexts = QUERIES["context_assembled"](spark, data).collect()
    assert {r["doc_id"] for r in contexts} == {d for d, n in shown.items() if n} and all(r["tokens"] <= 1000 and r["blocks"] <= shown[r["doc_id"]] for r in contexts)
    read = sum((i % 6 != 5) + 1 + (i % 5 != 3) for old in lines(spark, data).values() for i in range(len(old)))
    assert QUERIES["consensus_pages"](spark, data).agg(F.sum("support")).first()[0] == read
    pages = spark.read.parquet(f"{data}/pages.parquet").where("html is not null").collect()
    tags = {r["page_id"]: r["digest"] for r in QUERIES["table_tags"](spark, data).collect()}
    for r in pages:
        bare = re.sub(r"<\s*/?\s*(?!(?:table|thead|tbody|tr|td|th|math|sup|sub|b|i)(?![A-Za-z0-9]))[A-Za-z0-9]+[^>]*>", "", r["html"], flags=re.I)
        if "<" not in re.sub(r"</?(tr|td|th|b|i|table)>", "", bare):
            assert tags[r["page_id"]] == (hashlib.md5(bare.strip().encode()).hexdigest() if bare.strip() else None)
