"""Search, near-duplicates, files, packing, mixing and the pipeline on small tables, against brute force."""

from __future__ import annotations

import io
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from doclake.llm import bitplane, minhash, mixing, packing, pivots, topk
from doclake.llm.common import components
from doclake.llm.tokens import TextTokenizer


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(1)
    base = draw.normal(size=(300, 12))
    base[40:60] = base[40] + 0.02 * draw.normal(size=(20, 12))
    base[100:110] = base[100]
    rows = [(i, [float(x) for x in v], "x", 1) for i, v in enumerate(base)]
    rows += [(400, None, "x", 1), (401, [], "x", 1), (402, [0.0] * 12, "x", 1), (403, [float("nan")] * 12, "x", 1), (404, [None] + [1.0] * 11, "x", 1), (405, [float("inf")] * 12, "x", 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, v int").repartition(3), base


def test_topk(vectors):
    table, base = vectors
    ints = {i: np.floor(64 * v).astype(int) for i, v in enumerate(base)} | {402: np.zeros(12, int)}
    found = defaultdict(list)
    for r in topk.search(table, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in ints if i % 20 == 0}
    for q, got in found.items():
        best = sorted(((-int(ints[q] @ v), i) for i, v in ints.items() if i != q))[:20]
        assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk.search(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.search(table.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_pivots(vectors):
    table, base = vectors
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    link = (unit @ unit.T >= 0.95) & ~np.eye(len(unit), dtype=bool)
    label = np.arange(len(unit))
    for _ in range(20):
        label = np.array([min([label[i], *label[link[i]]]) for i in range(len(unit))])
    rows = {r["vec_id"]: r for r in pivots.near_duplicates(table).collect()}
    assert len(rows) == 306
    assert [rows[i]["n_links"] for i in range(300)] == link.sum(1).tolist()
    assert [rows[i]["component_id"] for i in range(300)] == label.tolist()
    assert all(rows[i]["n_links"] == 0 and rows[i]["kept"] for i in range(400, 406))
    assert pivots.near_duplicates(table.where("false")).count() == 0


def test_pivots_hot_group(spark, monkeypatch):
    """Unequal near-copies are a third of the vectors and of many references; every link is found."""
    monkeypatch.setattr(pivots, "PER_PIVOT", 4)
    draw = np.random.default_rng(9)
    base = draw.normal(size=(2400, 32))
    base[:800] = draw.normal(size=32) + 0.2 * draw.normal(size=(800, 32))
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    link = (unit @ unit.T >= 0.95) & ~np.eye(len(unit), dtype=bool)
    label = np.arange(len(unit))
    for _ in range(20):
        label = np.array([min([label[i], *label[link[i]]]) for i in range(len(unit))])
    assert 0.3 < link[:800, :800].mean() < 0.99
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    rows = {r["vec_id"]: r for r in pivots.near_duplicates(table).collect()}
    assert [rows[i]["n_links"] for i in range(2400)] == link.sum(1).tolist()
    assert [rows[i]["component_id"] for i in range(2400)] == label.tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (200, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_minhash(docs, rows, empty):
    found = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    texts = {r[0]: r[1] or "" for r in rows}
    grams = {}
    for k, t in texts.items():
        owner, hashes, _, _ = minhash.shingles([t])
        grams[k] = np.unique(hashes, return_counts=True)
    label = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if None not in (a, b) and len(grams[a][0]) and len(grams[b][0]) and minhash.similarity(grams[a], grams[b]) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert {k: r["component_id"] for k, r in found.items()} == label
    assert found[64]["component_id"] == found[65]["component_id"] == 7
    left = minhash.kept(docs)
    assert left.columns == docs.columns and left.count() == len(rows) - sum(not r["kept"] for r in found.values())
    assert minhash.near_duplicates(empty).count() == 0


def test_kept_with_repeated_and_null_keys(spark):
    text = lambda i: " ".join(f"w{(i * 131 + k * k) % 9973}" for k in range(40))
    rows = [(1, text(1))] * 3 + [(None, text(2))] * 4 + [(5, text(3)), (5, text(4)), (3, text(3) + " more")] + [(None, text(1))]
    left = minhash.kept(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(left, key=lambda r: r["text"]) == sorted([(1, text(1)), (None, text(2)), (5, text(4)), (3, text(3) + " more")], key=lambda r: r[1])


def test_mixed_with_repeated_and_null_keys(spark):
    rows = [(None if i % 3 == 0 else i % 20, f"t{i // 2} a b c", f"s{i % 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, there, sizes = (defaultdict(int) for _ in range(3))
    for r in mixing.mixed(docs).collect():
        taken[tuple(r)] += 1
        sizes[r["source"]] += 4
    for r in rows:
        there[r] += 1
    assert set(taken) <= set(there) and all(n <= mixing.MOST * there[r] for r, n in taken.items())
    aim = mixing.targets({f"s{i}": 400 for i in range(3)})
    assert all(abs(sizes[s] - aim[s]) <= 2 for s in aim)


def test_dart_signatures_estimate_similarity():
    words = [f"w{i}" for i in range(400)]
    other = [w if i % 37 else f"x{i}" for i, w in enumerate(words)]
    owner, hashes, _, _ = minhash.shingles([" ".join(words), " ".join(other), "a b a b a b", "a b a b a b"])
    sig = minhash.signatures(owner, hashes, 4)
    true = minhash.similarity(*[np.unique(hashes[owner == i], return_counts=True) for i in (0, 1)])
    assert abs((sig[0] == sig[1]).mean() - true) < 0.16
    assert (sig[2] == sig[3]).all()


def test_margin_is_five_standard_deviations():
    assert minhash.MARGIN >= 5 * (0.8 * 0.2 / minhash.COORDINATES) ** 0.5


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    draw, sink = np.random.default_rng(4), io.BytesIO()
    docs = [(i, draw.integers(0, 50_000, n).astype("<u4")) for i, n in enumerate((0, 5, 70_000, 1, 140_000))] + [(None, np.array([2**32 - 1], "<u4"))]
    out = bitplane.Writer(sink, bits)
    for k, ids in docs:
        out.add(k, ids.tobytes())
    out.close()
    back = list(bitplane.read_documents(sink, len(sink.getvalue())))
    assert [(k, ids.tolist()) for k, _, ids in back] == [(k, ids.tolist()) for k, ids in docs]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokenizer_parts(name):
    import random

    draw = random.Random(3)
    alphabet = ["a", "the", "É", "ñ", " ", " ", "  ", "\n", ".", ",", "'s", "don't", "9", "1.5", "\t", "|", "!", " ", "\x1c", "é", "中", "İ", "Σ", "<|endoftext|>", "_", "-"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(30))) for _ in range(3000)]
    own = TextTokenizer(public_tokenizers.path(name))
    plain = [np.array(e.ids, "<u4").tobytes() for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x for i in range(0, 3000, 250) for x in own(texts[i : i + 250])] == plain


def test_files(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = sorted(bitplane.read(bitplane.write(docs, path, 2)).collect(), key=lambda r: r["start"])
    encode, at = TextTokenizer(path).tokenizer, 0
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda k: -1 if k is None else k)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        ids = np.array([*encode.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert bitplane.read(bitplane.write(empty, path, 2)).count() == 0


def check_pieces(pieces, texts, encode, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(texts)
    for k, ps in by_doc.items():
        ids, at = np.array([*encode.encode(texts[k] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    padded = total = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        total += at
        padded += 0 if at & (at - 1) == 0 else window - at
    return padded / total


def test_packing(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = {r[0]: r[1] for r in rows}
    encode = TextTokenizer(path).tokenizer
    for spaces in (2, 64):
        assert check_pieces(packing.pack(docs, path, 1, spaces=spaces).collect(), texts, encode, 2048) < 0.05
    assert packing.pack(empty, path, 1).count() == 0


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 187.5, "b": 75.0, None: 37.5}
    capped = mixing.targets({"a": 10, "b": 100, "c": 100})
    assert capped["a"] == 30.0 and abs(sum(capped.values()) - 210) < 1e-9
    assert mixing.targets({}) == {} and mixing.targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0}


def test_mixing(docs, rows, empty):
    found = mixing.copies(docs).collect()
    size = lambda t: len((t or "").split())
    assert sorted((r["doc_id"] or -1, r["size"]) for r in found) == sorted((r[0] or -1, size(r[1])) for r in rows)
    source = {r[0]: r[3] for r in rows}
    taken, aim, shortest, longest, total = defaultdict(int), {}, defaultdict(lambda: 10**9), defaultdict(int), defaultdict(int)
    for r in found:
        s = source[r["doc_id"]]
        assert 0 <= r["copies"] <= 3
        taken[s] += r["copies"] * r["size"]
        aim[s] = r["target"]
        shortest[s], longest[s], total[s] = min(shortest[s], r["size"] or 10**9), max(longest[s], r["size"]), total[s] + r["size"]
    # a document that is longer than all others of its source together can't be made up for
    assert all(abs(taken[s] - aim[s]) <= max(0.01 * aim[s], shortest[s], (2 * longest[s] - total[s]) / 2) for s in aim), (dict(taken), aim)
    again = {(r["doc_id"], r["copies"]) for r in mixing.copies(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in found}
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in found)
    assert mixing.copies(empty).count() == 0


@pytest.mark.parametrize("group", [mixing.GROUP, 200])
def test_mixing_is_near_its_targets(spark, monkeypatch, group):
    """Heavy-tailed sizes, one source a third of all rows, through one node and through a tree of them."""
    monkeypatch.setattr(mixing, "GROUP", group)
    draw = np.random.default_rng(5)
    sizes = np.minimum(3000, draw.pareto(1.1, 3000) * 20 + 1).astype(int)
    docs = spark.createDataFrame([(i, "w " * int(n), "hot" if i % 3 == 0 else f"s{i % 7}") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    rows = mixing.copies(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(rows) == 8 and all(abs(r["taken"] - r["target"]) <= max(0.002 * r["target"], 20) for r in rows), rows


def test_settling_keeps_expectations():
    draw, taken = np.random.default_rng(1), np.zeros(40)
    sizes = draw.integers(1, 500, 40)
    for salt in range(4000):
        p = np.full(40, 0.3)
        mixing._settle(np.arange(40) * 7919, sizes, p, salt)
        assert set(p) <= {0.0, 1.0} and abs((p * sizes).sum() - 0.3 * sizes.sum()) <= 40
        taken += p
    assert np.sort(abs(taken / 4000 - 0.3))[:-3].max() < 0.04  # the shortest are rounded to the nearer side


def test_pipeline(spark, docs, rows, empty):
    """Stage by stage against what each stage says of its own input."""
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "near_duplicates", "personal_data", "mixing", "packing"]
    now = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, now, "")
        assert after.columns == docs.columns
        if name == "language_id":
            assert {r["doc_id"] for r in now.select("doc_id").collect()} - {r["doc_id"] for r in after.select("doc_id").collect()} == {60, 61, 62, 63}
        if name == "near_duplicates":
            assert {64, 65} & {r["doc_id"] for r in after.select("doc_id").collect()} == set()
        now = spark.createDataFrame(after.collect(), docs.schema)
    pieces = p.STAGES[-1][1](spark, now, "").collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in now.collect()}
    for _, stage in p.STAGES:
        assert stage(spark, empty, "").count() == 0
