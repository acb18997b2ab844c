"""Operators without a driver table: small inputs, exact results."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from doclake.functions import text as T
from doclake.functions import udfs
from doclake.functions.geometry import iou
from doclake.operators import evaluation, lineage, models, retrieval
from doclake.sources import tables
from doclake.streaming import jobs


def test_rank_fusion(spark):
    rows = [(0, i, k) for i, k in enumerate("abc")] + [(1, i, k) for i, k in enumerate("caad")]
    got = {r["key"]: r for r in retrieval.fuse(spark.createDataFrame(rows, "source int, pos int, key string"), ["key"]).collect()}
    assert abs(got["a"]["score"] - (1 / 61 + 1 / 62)) < 1e-12 and got["c"]["sources"] == [0, 1]
    assert abs(got["d"]["score"] - 1 / 63) < 1e-12


def test_overlap_of_rectangles(spark):
    row = spark.range(1).select(*[F.lit(float(v)).alias(n) for n, v in zip(("ax0", "ay0", "ax1", "ay1", "bx0", "by0", "bx1", "by1"), (0, 0, 10, 10, 5, 0, 15, 10), strict=True)])
    assert abs(row.select(iou("a", "b")).first()[0] - 1 / 3) < 1e-12


def test_hash_pairs(spark):
    old = spark.createDataFrame([(1, 0, "h"), (1, 1, "dup"), (1, 2, "dup")], "doc_id long, ord int, text string")
    new = spark.createDataFrame([(1, 0, "dup"), (1, 1, "h"), (1, 2, "dup")], "doc_id long, new_ord int, text string")
    assert {(r["ord"], r["new_ord"]) for r in evaluation.same_hash(old, new).collect()} == {(0, 1), (1, 0), (2, 2)}


def test_kendall(spark):
    rows = spark.createDataFrame([("up", i, i) for i in range(4)] + [("down", i, -i) for i in range(4)] + [("one", 5, 5)], "g string, x int, y int")
    assert {(r["g"], r["s"], r["pairs"]) for r in evaluation.kendall(rows, "g", "x", "y").collect()} == {("up", 6, 6), ("down", -6, 6)}


def test_greedy_mapping(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    old = spark.createDataFrame([(1, 0, "a", "the quick brown fox", 0.0, 0.0, 10.0, 10.0), (1, 0, "b", "the quick brown fix", 0.0, 1.0, 10.0, 11.0), (1, 1, "c", "the quick brown fox", 0.0, 0.0, 10.0, 10.0)], f"doc_id long, page int, id string, text string, {box}")
    new = spark.createDataFrame([(1, 0, "n", "the quick brown fox", 0.0, 0.5, 10.0, 10.5)], f"doc_id long, page int, id string, text string, {box}")
    assert [(r["old"], r["new"]) for r in lineage.greedy_matches(lineage.fuzzy_pairs(old, new)).collect()] == [("a", "n")]


def test_names_and_replies():
    assert udfs.normal_name("ResNet-50") == udfs.normal_name("resnet 50") and udfs.normal_name("GPT-3.5") != udfs.normal_name("GPT-35")
    assert udfs.clean("a­b  é") == "ab é" and udfs.alike("", "x") == 0.0
    assert udfs.repaired('Sure:\n```json\n{"a": [1, 2]}\n```') == '{"a": [1, 2]}'
    assert udfs.repaired('{bad} and {"a": {"b": 1}}') == '{"a": {"b": 1}}' and udfs.repaired('{"x": {"sections": 1}}', "sections") == '{"sections": 1}'
    assert udfs.repaired('{"a": "open') is None
    assert udfs.normal_name("Newton’s") == "newton" and udfs.normal_name("τ·test's x") == "tautestsx"
    assert udfs.repaired('{"a": [1, 2], "b": {"c": 1') == '{"a": [1, 2], "b": {"c": 1}}'
    assert udfs.repaired("no") is None and udfs.repaired(None) is None


def test_udf_columns(spark):
    row = spark.createDataFrame([("β-Catenin", "beta catenin", None)], "a string, b string, c string")
    assert row.select((udfs.name_norm("a") == udfs.name_norm("b")).alias("x"), udfs.clean_text("c").alias("y"), udfs.similarity("b", "b").alias("z")).first() == (True, "", 1.0)


def test_terms_and_ids(spark):
    assert T.query_terms("What is the (attention) of it?") == ["attention"] and T.query_terms("the of") == ["the", "of"]
    assert spark.range(1).select(T.normal_ids(F.lit("see B-12, b_0012 and b_3"))).first()[0] == ["b_0012", "b_0003"]


def test_cache_and_reuse(spark):
    requests = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "n int, text string").withColumn("key", models.cache_key("p", "m", "q@1", F.col("text")))
    cache = requests.where("n = 1").select("key", F.lit("old").alias("reply"))
    asked = []

    def model(misses):
        asked.append(misses.count())
        return misses.withColumn("reply", F.upper("text"))

    got = {r["n"]: (r["reply"], r["cache_hit"]) for r in models.with_cache(requests, cache, model).collect()}
    assert got == {1: ("old", True), 2: ("Y", False), 3: ("Y", False)} and asked == [1]
    stored = requests.where("n = 1").select(F.sha2("text", 256).alias("text_hash"), F.array(F.lit(9.0)).alias("vector"))
    out = {r["n"]: r["reused"] for r in models.reused_vectors(requests.select("n", "text"), stored, lambda d: d.withColumn("vector", models.hash_vector(F.col("text")))).collect()}
    assert out == {1: True, 2: False, 3: False}


def test_job_machine():
    assert jobs.advance(None, ["queued", "done", "running", "failed", "queued", "running", "done", "queued"]) == ("done", 6)


def test_streams(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    tables.jobs(spark.read.parquet(source)).select("job", "ts", "event_id", "status").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = jobs.job_states(stream).writeStream.format("memory").queryName("job_states").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["job"]: r["status"] for r in spark.table("job_states").collect()}
    rows = spark.read.parquet(str(tmp_path / "in")).orderBy("job", "ts", "event_id").collect()
    want = {j: jobs.advance(None, [r["status"] for r in rows if r["job"] == j])[0] for j in {r["job"] for r in rows}}
    assert got == want


def test_ancestors_of_a_long_chain_and_a_cycle(spark):
    from doclake.operators import trees

    turns = [(1, i, i - 1 if i else None) for i in range(40)] + [(2, i, (i + 1) % 5) for i in range(5)]
    found = {(r["conv_id"], r["node"], r["ancestor"]): r["distance"] for r in trees.ancestors(spark.createDataFrame(turns, "conv_id long, node long, parent long")).collect()}
    chain = {(1, i, j): i - j for i in range(40) for j in range(i)}
    assert found == chain | {(2, i, (i + k) % 5): k for i in range(5) for k in range(1, 5)}


def test_chunk_texts(spark):
    """A heading, two short blocks and a new section make two chunks with titles; a long block is cut at sentences."""
    from doclake.operators import blocks as B

    long = " ".join(f"Sentence number {i} has some more words in it." for i in range(200))
    rows = [(1, 0, "heading", "Intro"), (1, 1, "paragraph", "One."), (1, 2, "paragraph", "Two."), (1, 3, "heading", "Method"), (1, 4, "paragraph", "Three."), (2, 0, "paragraph", long), (2, 1, "paragraph", "x" * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, type string, text string")
    got = {(r["doc_id"], r["chunk"]): r for r in B.chunk_texts(df).collect()}
    assert (got[1, 0]["ords"], got[1, 0]["text"]) == ([1, 2], "Intro\nOne.\nTwo.") and (got[1, 1]["ords"], got[1, 1]["text"]) == ([4], "Method\nThree.")
    pieces = [r for (d, _), r in sorted(got.items()) if d == 2]
    assert " ".join(r["text"] for r in pieces if r["ords"] == [0]) == long and "".join(r["text"] for r in pieces if r["ords"] == [1]) == "x" * 4000
    assert all(B.tokens_of(r["text"]) <= 256 for r in pieces) and len(pieces) > 8
    one = "a" * 511 + "."
    assert B.split_long(f"{one} {one}", 256, 480) == [one, one] and B.split_long(f"{one[1:]} {one[1:]}", 256, 480) == [f"{one[1:]} {one[1:]}"]
    middle = "b" * 1400 + "."  # over the target, not over the limit: whole
    assert B.split_long(f"One. {middle} Two. Three.", 256, 480) == ["One.", middle, "Two. Three."]
    packed = {(r["doc_id"], r["chunk"]): (r["first_ord"], r["last_ord"]) for r in B.chunks(df).collect()}
    assert packed == {(1, 0): (1, 2), (1, 1): (4, 4), (2, 0): (0, 0), (2, 1): (1, 1)}


def test_split_long_is_the_longest_prefix_each_time():
    from doclake.operators import blocks as B

    draw = random.Random(9)
    for _ in range(300):
        text = draw.choice([" ", ""]).join("".join(draw.choice("ab 漢") for _ in range(draw.randrange(1, 60))) + draw.choice([". ", "。", "! ", "。 ", "\n"]) for _ in range(draw.randrange(1, 12))).strip()
        size, most = draw.choice([(8, 12), (5, 30), (20, 20)])
        want, held = [], ""
        for s in re.split(r"(?<=[.!?;])\s+|(?<=[。！？；])", text):
            if not s.strip():
                continue
            longer = f"{held} {s}".strip() if held else s
            if B.tokens_of(longer) <= size:
                held = longer
                continue
            want += [held] if held else []
            held = ""
            if B.tokens_of(s) <= most:
                held = s
            else:
                step = max(1, len(s) * size // B.tokens_of(s))
                want += [s[i : i + step] for i in range(0, len(s), step)]
        assert B.split_long(text, size, most) == want + ([held] if held else [])


def test_numbers_of_texts(spark):
    from doclake.functions import text as T

    cases = {"ResNet-50 got 1,234.5 and 0,95 or -3 on B2, v1.2 and 7": [0.95, -3.0, 7.0], "12,345,678 +4 −2.5 为66.5h x‐9 1.2.3": [12345678.0, 4.0, -2.5, 66.5], "1,23,456": [], "": [], "F1 85.3%": [85.3], "5-3 (-5)": [5.0, 3.0, -5.0]}
    found = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.numbers_in(F.col("t")).alias("n"), T.has_value(F.lit(0.95), F.col("t")).alias("has")).collect()
    assert {r["t"]: r["n"] for r in found} == cases
    assert {r["t"] for r in found if r["has"]} == {t for t, n in cases.items() if 0.95 in n}


def test_edit_distance_of_whole_texts(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    a, b = "über " + "abc " * 60 + "end", "über " + "abd " * 50 + "ende"
    assert spark.range(1).select(F.levenshtein(F.lit(a), F.lit(b))).first()[0] == distance(a, b)


def test_snippets(spark):
    body, start = "x" * 100 + " The Vision of motion " + "y" * 200, "\u2026"
    got = spark.range(1).select(T.highlight(F.lit(body), ["ion", "vision"]).alias("a"), T.highlight(F.lit("z" * 170), ["ion"]).alias("b"), T.highlight(F.lit("ion"), ["ION"]).alias("c")).first()
    assert got["a"].startswith(start) and "\x02Vision\x03" in got["a"] and "mot\x02ion\x03" in got["a"] and got["a"].endswith("y…")
    assert got["b"] == "z" * 160 + "…" and got["c"] == "\x02ion\x03"


def test_placeholders():
    text = "see https://a.example/x [1, 2] and `f(x)` ⟦EQ1⟧ [3]"
    made, kept = udfs.protect(text)
    assert made == "see ⟦URL1⟧ ⟦CITE1⟧ and ⟦CODE1⟧ ⟦EQ1⟧ ⟦CITE2⟧" and udfs.restore(made, kept) == text
    assert udfs.restore("[[URL1]] 【CITE1】 〚CODE1〛 ⟦ CITE2 ⟧ ⟦EQ1⟧", kept) == "https://a.example/x [1, 2] `f(x)` [3] ⟦EQ1⟧"
    assert udfs.mark_difference("⟦A1⟧ ⟦A1⟧ ⟦B1⟧", "[[A1]] ⟦C1⟧") == (["⟦A1⟧", "⟦B1⟧"], ["⟦C1⟧"])


def test_greedy_matching_takes_second_best(spark):
    rows = [(1, 0, 0, 0, 0.9), (1, 0, 0, 1, 0.8), (1, 0, 1, 0, 0.7), (1, 0, 1, 1, 0.6)]
    got = evaluation.matched(spark.createDataFrame(rows, "doc_id long, page int, g int, p int, iou double")).collect()
    assert {(r["g"], r["p"]) for r in got} == {(0, 0), (1, 1)}


def test_running_jobs_take_slots(spark):
    from doclake.operators import jobs as J

    schema = "job long, kind string, status string, depends_on long, created long"
    rows = [(i, f"k{i}", "queued", None, i) for i in range(6)] + [(10, "k0", "running", None, 0), (11, "x", "running", None, 0)]
    states = spark.createDataFrame(rows, schema)
    admit = lambda most: {r["job"] for r in J.admitted(states.where("status = 'queued'"), states.where("status = 'running'"), {"k9": 2}, most).collect()}
    assert admit(4) == {1, 2} and admit(2) == set()
    chain = spark.createDataFrame([(0, "k", "failed", None, 0)] + [(i, "k", "queued", i - 1, i) for i in range(1, 9)] + [(20, "k", "queued", 21, 0), (21, "k", "queued", 20, 0)], schema)
    assert {r["job"] for r in J.cancelled(chain).collect()} == set(range(1, 9))


def test_search_of_short_terms(spark):
    rows = spark.createDataFrame([(1, "b_0000", 0, "of an ox"), (1, "b_0001", 1, "an ox")], "doc_id long, block_id string, ord int, text string")
    assert [(r["block_id"], r["score"]) for r in retrieval.bm25(rows, ["of", "ox"]).collect()] == [("b_0000", 1.0)]
    assert retrieval.bm25(rows, []).count() == 0


def test_section_levels(spark):
    from doclake.operators import blocks as B

    heads = [(1, i, "heading", level, "h") for i, level in enumerate((1, 2, 3, 4, 2, 4, 1, 3))]
    parents = B.section_parents(spark.createDataFrame(heads, "doc_id long, ord int, type string, level int, text string"))
    assert {r["ord"]: r["parent"] for r in parents.collect()} == {0: None, 1: 0, 2: 1, 3: 2, 4: 0, 5: 4, 6: None, 7: 6}
    assert {r["ord"]: r["root"] for r in B.section_roots(parents).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 6, 7: 6}
