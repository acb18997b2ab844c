"""The stored index, the dictionary and whole mappings against plain Python."""

from __future__ import annotations

import difflib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from doclake import constants as K
from doclake.functions import udfs
from doclake.operators import dictionary, evaluation, fulltext, lineage, matching, retrieval
from doclake.plans.queries import QUERIES
from doclake.sources import tables as S

BLOCKS = "doc_id long, ord int, block_id string, text string"


def blocks_of(spark, docs):
    return spark.createDataFrame([(d, i, f"b_{i:04d}", t) for d, lines in docs.items() for i, t in enumerate(lines)], BLOCKS)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    words = "the of ring ringing string tion station été ça naïve 漢字 🙂x a'b %x under_score aaa aaaa".split()
    return {d: [" ".join(draw.choice(words) for _ in range(draw.randrange(12))) for _ in range(draw.randrange(1, 6))] for d in [*range(40), -5, 10**12, 2000, 2001]}


def ranked(found):
    return sorted(map(tuple, found.select("doc_id", "block_id", "ord", "score").collect()))


TERMS = [["ring"], ["ing", "tion"], ["of the"], ["ring s", "été ç"], ["漢字 🙂"], ["🙂x a"], ["nothing here"], ["it", "ring"], ["aaa"], ["%x u"], ["ou"], ["RING"], []]


@pytest.mark.parametrize("terms", TERMS, ids=str)
def test_index_gives_the_rows_of_the_scan(spark, corpus, indexed, terms):
    rows = blocks_of(spark, corpus)
    assert ranked(fulltext.search(spark, indexed, terms)) == ranked(retrieval.bm25(rows, terms))


@pytest.fixture(scope="module")
def indexed(spark, corpus, tmp_path_factory):
    index = fulltext.Index(f"file://{tmp_path_factory.mktemp('index')}/i", segments=4, buckets=8)
    fulltext.build(index, blocks_of(spark, corpus).union(spark.createDataFrame([(None, 0, "b", "ring"), (1, 99, "c", None)], BLOCKS)))
    return index


def test_index_opens_only_the_buckets_of_the_grams(spark, indexed):
    plan = fulltext.candidates(spark, indexed, ["ring"])._jdf.queryExecution().executedPlan().toString()
    wanted = {indexed.bucket_of(g) for g in ("rin", "ing")}
    assert re.search(r"PartitionFilters: \[[^\n]*bucket#", plan) and re.search(r"PushedFilters: \[[^\n]*gram", plan)
    read = indexed.read(spark, "postings").where(F.col("bucket").isin(sorted(wanted)) & F.col("gram").isin("rin", "ing"))
    opened = {int(re.search(r"bucket=(\d+)", r[0]).group(1)) for r in read.select(F.input_file_name()).distinct().collect()}
    assert opened == wanted < set(range(8))
    assert only(spark, indexed, ["nothing here"]) == []


def only(spark, index, terms):
    return fulltext.candidates(spark, index, terms).collect()


def test_candidates_hold_every_gram(spark, corpus, indexed):
    found = {(r["doc_id"], r["ord"]) for r in only(spark, indexed, ["ringing"])}
    assert found == {(d, i) for d, lines in corpus.items() for i, t in enumerate(lines) if all(g in t.lower() for g in ("rin", "ing", "ngi", "gin"))}


def test_replaced_documents(spark, corpus, tmp_path):
    index = fulltext.Index(f"file://{tmp_path}/i", segments=4, buckets=8)
    fulltext.build(index, blocks_of(spark, corpus))
    changed = {d: [t.replace("ring", "thing") + " tion" for t in lines] for d, lines in corpus.items() if d % 3 == 0 and d > 0}
    gone = [d for d in corpus if d % 3 == 1]
    fulltext.replace(index, blocks_of(spark, changed), spark.createDataFrame([(d,) for d in [*changed, *gone, 777]], "doc_id long"))
    now = {d: changed.get(d, lines) for d, lines in corpus.items() if d not in gone}
    for terms in (["ring"], ["thing", "tion"], ["ou"]):
        assert ranked(fulltext.search(spark, index, terms)) == ranked(retrieval.bm25(blocks_of(spark, now), terms))
    fulltext.replace(index, blocks_of(spark, {}), spark.createDataFrame([(d,) for d in now if d % 2], "doc_id long"))
    left = {d: lines for d, lines in now.items() if d % 2 == 0}
    assert ranked(fulltext.search(spark, index, ["ring"])) == ranked(retrieval.bm25(blocks_of(spark, left), ["ring"]))
    assert ranked(fulltext.search(spark, index, ["ring"], documents=[2, 6])) == [r for r in ranked(retrieval.bm25(blocks_of(spark, left), ["ring"])) if r[0] in (2, 6)]


def test_packed_numbers():
    draw = random.Random(1)
    rows = [sorted({draw.randrange(1 << draw.randrange(1, 50)) for _ in range(draw.randrange(1, 40))}) for _ in range(200)]
    import numpy as np

    packed = udfs.pack_rows(np.array([x for r in rows for x in r], np.int64), np.array([len(r) for r in rows]))
    assert [x.tolist() for x in udfs.unpack_rows(packed)] == rows
    assert len(udfs.pack_rows(np.arange(1000), np.array([1000]))[0]) == 1000


# --- dictionary ---


def pattern(term, plural):
    body = r"\s+".join(map(re.escape, term.split()))
    if re.fullmatch(dictionary.WORD_LIKE, term, re.ASCII):
        return rf"(?<![A-Za-z0-9]){body}{'(?:e?s)?' if plural else ''}(?![A-Za-z0-9])"
    return body


DICTIONARY = ["codon", "mRNA vaccine", "密码子", "β-barrel", "Transformer", " transformer ", "c++", "--", "(x)", "a", "β", "é t", "U.S.", "box", "glass", "x_y", "密", "_b", "1.5"]
TEXTS = ["Codons are optimized", "the codon.", "anticodonal", "mRNA  vaccines\twork", "优化密码子使用", "the FhuA β-barrel", "TRANSFORMERS", "C++s and c++x", "x--y", "f(x)es", "boxes glasses glass", "É t", "u.s.", "a_b x_ys 1.5 11.5", None, "", "codones codonx"]


@pytest.mark.parametrize("plural", [True, False])
def test_dictionary_against_patterns(spark, plural):
    draw = random.Random(4)
    texts = TEXTS + [" ".join(draw.choice([*filter(None, TEXTS), *DICTIONARY]) for _ in range(4)) for _ in range(60)]
    texts += texts[:5]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, n int").repartition(3)
    terms = spark.createDataFrame([(t,) for t in [*DICTIONARY, None, "  ", "codon"]], "term string")
    want = sorted((i, t) for i, text in enumerate(texts) for t in DICTIONARY if text and re.search(pattern(t, plural), text, re.I))
    for most in (100, 0):
        found = dictionary.uses(frame, terms, plural=plural, most_terms=most)
        assert found.columns == ["id", "text", "n", "term"]
        assert sorted((r["id"], r["term"]) for r in found.collect()) == want
        assert dictionary.uses(frame, terms.where("false"), most_terms=most).count() == dictionary.uses(frame.where("false"), terms, most_terms=most).count() == 0


def test_glossary_prefers_own_entries_and_long_ones(spark):
    texts = spark.createDataFrame([(1, "b1", "a transformer model of Transformers"), (2, "b1", "transformer model")], "doc_id long, block_id string, text string")
    terms = spark.createDataFrame([(None, "Transformer", "T"), (1, "transformer", "own"), (None, "transformer model", "TM"), (2, "nowhere", "x"), (None, " ", "y")], "doc_id long, term string, target string")
    found = sorted(map(tuple, dictionary.glossary(texts, terms, 24).collect()))
    assert found == [(1, "b1", "transformer", "own", 2), (1, "b1", "transformer model", "TM", 1), (2, "b1", "Transformer", "T", 2), (2, "b1", "transformer model", "TM", 1)]
    assert dictionary.glossary(texts, terms, 1).count() == 2


# --- matches and mappings ---


def test_one_to_one_is_the_greedy_choice(spark):
    draw = random.Random(6)
    rows = list({(g, draw.randrange(6), draw.randrange(6)): draw.randrange(4) for g in range(30) for _ in range(20)}.items())
    rows = [(*k, v) for k, v in rows]
    want = []
    for g in range(30):
        used = (set(), set())
        for _, a, b, s in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1], r[2])):
            if a not in used[0] and b not in used[1]:
                used[0].add(a)
                used[1].add(b)
                want.append((g, a, b, s))
    frame = spark.createDataFrame(rows, "grp long, a int, b int, s int")
    order = [F.desc("s"), F.asc("a"), F.asc("b")]
    assert sorted(map(tuple, matching.one_to_one(frame, ["grp"], "a", "b", order).collect())) == sorted(want)
    assert matching.one_to_one(frame.where("false"), ["grp"], "a", "b", order).count() == 0


def test_bounds_of_likeness_hold(spark):
    draw = random.Random(7)
    texts = ["".join(draw.choice("ab c") for _ in range(draw.randrange(1, 30))) for _ in range(120)]
    texts += [t[: len(t) // 2] + "x" + t[len(t) // 2 :] for t in texts]
    side = lambda some: spark.createDataFrame([(1, 0, i, t, 0.0, 0.0, 1.0, 1.0) for i, t in enumerate(some)], "doc_id long, page int, id int, text string, x0 double, y0 double, x1 double, y1 double")
    pairs = lineage.page_pairs(side(texts[:120:2]), side(texts[1::2])).collect()
    assert pairs and all(r["most"] + 1e-9 >= difflib.SequenceMatcher(None, r["a_o"]["text"], r["b_o"]["text"]).ratio() for r in pairs if r["a_o"]["n"] and r["b_o"]["n"])


def test_fuzzy_mapping_of_whole_documents(spark, data):
    """The query against plain Python over the whole table, and how few pairs are compared letter by letter."""
    blocks = S.blocks(S.table(spark, data, "documents"))
    old = S.anchors(blocks).withColumn("id", F.col("block_id"))
    new = S.anchors(S.new_version(blocks).withColumn("ord", F.col("new_ord"))).withColumn("id", F.col("new_id"))
    docs: dict = {}
    for side, df in enumerate((old, new)):
        for r in df.collect():
            docs.setdefault(r["doc_id"], ([], []))[side].append(r)
    want, pages = [], 0
    for doc, (a, b) in docs.items():
        free: tuple[dict, dict] = ({}, {})
        nth: tuple[Counter, Counter] = (Counter(), Counter())
        for side, rows in enumerate((a, b)):
            for r in sorted(rows, key=lambda r: r["ord"]):
                nth[side][r["text"]] += 1
                free[side][r["text"], nth[side][r["text"]]] = r
        for key in free[0].keys() & free[1].keys():
            want.append((doc, free[0].pop(key)["id"], free[1].pop(key)["id"], "exact"))
        pairs = []
        for x in free[0].values():
            for y in free[1].values():
                pages += x["page"] == y["page"]
                if x["page"] != y["page"] or not x["text"].strip() or not y["text"].strip():
                    continue
                over = max(0.0, min(x["y1"], y["y1"]) - max(x["y0"], y["y0"])) * 468
                overlap = over / (2 * 75.2 * 468 - over) if over > 0 else 0.0
                s = difflib.SequenceMatcher(None, udfs.reading(x["text"]), udfs.reading(y["text"]))
                if s.real_quick_ratio() >= 0.5 and (alike := s.ratio()) >= (K.MAP_LIKE if overlap >= K.MAP_IOU else K.MAP_SIMILARITY):
                    pairs.append((-(alike + overlap), x["page"], x["id"], y["id"]))
        taken: tuple[set, set] = (set(), set())
        for _, _, x, y in sorted(pairs):
            if x not in taken[0] and y not in taken[1]:
                taken[0].add(x)
                taken[1].add(y)
                want.append((doc, x, y, "fuzzy"))
    found = sorted(map(tuple, QUERIES["map_blocks_fuzzy"](spark, data).collect()))
    assert found == sorted(want) and any(r[3] == "fuzzy" for r in found)
    exact = spark.createDataFrame([r for r in found if r[3] == "exact"], "doc_id long, old string, new string, kind string")
    left = lambda df, c: df.join(exact.select("doc_id", F.col(c).alias("id")), ["doc_id", "id"], "left_anti")
    asked = lineage.page_pairs(left(old, "old"), left(new, "new")).where("most >= least").count()
    every = old.groupBy("doc_id", "page").agg(F.count("*").alias("a")).join(new.groupBy("doc_id", "page").agg(F.count("*").alias("b")), ["doc_id", "page"]).agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    assert asked < 0.05 * every


def test_detection_pairs_are_still_greedy(spark):
    rows = [(1, 0, 1, 1, 0.9), (1, 0, 1, 2, 0.9), (1, 0, 2, 1, 0.9), (1, 0, 2, 2, 0.8)]
    got = evaluation.matched(spark.createDataFrame(rows, "doc_id long, page int, g int, p int, iou double")).collect()
    assert sorted((r["g"], r["p"]) for r in got) == [(1, 2), (2, 1)]
