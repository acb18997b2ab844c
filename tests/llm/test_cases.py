"""Cases that every operator and stage defines: clashing and dotted columns, nulls, repeated rows, long texts, empty tables."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from doclake.llm import alignment, bitplane, language_id, minhash, mixing, packing, pii, pitman_yor, pivots, prefix_bpe, topk, toxicity
from doclake.llm.common import key_mod

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__text` string, `a.b` string, `c0` int, `row` int, `m0` int, `__gone` int, `__key` int, `__copies` int, `x``y` string, `copies` int, `component_id` int"


@pytest.fixture(scope="module")
def odd(spark):
    text = "the ship of both that with have the wheel and from they to it, card 4111111111111111 idiot"
    texts = [(1, text), (1, text), (1, text), (2, None), (2, None), (None, text + " more"), (None, None), (None, ""), (3, "der und nicht schön über wenn auch eine zwischen möchte " * 8), (4, "the wheel of " * 80_000), (5, "  \n ")]
    return spark.createDataFrame([(k, t, None if i == 5 else "en", None if i % 3 == 0 else "s", 0, "t", "dot", 1, 2, 3, 4, 5, 6, "q", 7, 8) for i, (k, t) in enumerate(texts)], SCHEMA).repartition(3)


def test_every_operator_is_registered():
    """The driver's entry leaves them out where they can't be imported; here they must be there."""
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)}


def labels(spark):
    return spark.createDataFrame([(1, 1), (3, 0), (4, 0), (None, 1)], "doc_id long, toxic int")


WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
#: Operators that return a row for each row; the second value tells whether the columns of the input stay.
EACH = {
    "language": (lambda s, d: language_id.predict(d, language_id.fit(d)), True),
    "model": (lambda s, d: pitman_yor.score(d, key_mod("doc_id", 7) == 2), False),
    "files": (lambda s, d: bitplane.read(bitplane.write(d, BYTE, 2)), False),
    "toxicity": (lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s))), True),
    "pii": (lambda s, d: pii.detect(d, pii.fit(d)), True),
    "redact": (lambda s, d: pii.redact(d, pii.fit(d)), True),
    "near": (lambda s, d: minhash.near_duplicates(d), False),
    "copies": (lambda s, d: mixing.copies(d), False),
    "aligned": (lambda s, d: alignment.align(d, BYTE, public_tokenizers.path("piece_bpe_32k.model")), False),
    "encoded": (lambda s, d: prefix_bpe.digests(d, BYTE), True),
}


@pytest.mark.parametrize("name", EACH)
def test_each_row_has_a_result(spark, odd, name):
    run, stays = EACH[name]
    found = run(spark, odd)
    assert not stays or found.columns[: len(odd.columns)] == odd.columns or set(odd.columns) <= set(found.columns)
    assert len(found.collect()) == 11
    assert run(spark, odd.where("false")).count() == 0


def test_packing_of_odd_rows(odd):
    pieces = packing.pack(odd, WORD, 1).collect()
    whole = [p["doc_tokens"] for p in pieces if p["start"] == 0]
    assert len(whole) == 11 and sum(p["length"] for p in pieces) == sum(whole)


def test_stages_keep_the_columns(spark, odd):
    import corpus_pipeline as p

    now = odd
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, now, "")
        assert after.columns == odd.columns and after.dtypes == odd.dtypes
        rows = after.collect()
        if name == "language_id":
            assert len(rows) == 6  # those with a letter
        if name == "near_duplicates":  # one of the three equal rows; the longer text is their near-copy
            assert sorted(r["doc_id"] or -1 for r in rows) == [1, 3, 4]
        if name == "personal_data":
            assert all("4111" not in r["text"] and r["__text"] == "t" and r["a.b"] == "dot" for r in rows)
        now = spark.createDataFrame(rows, odd.schema)
    assert p.STAGES[-1][1](spark, now, "").count() > 0


@pytest.mark.parametrize("run", [lambda v: topk.search(v, F.col("vec_id") % 20 == 0, k=3), pivots.near_duplicates])
def test_vectors_with_odd_columns(spark, run):
    schema = "vec_id long, embedding array<float>, `a.b` int, `__text` int, `row` int"
    rows = [(i, [1.0, float(i // 2), 0.5], 1, 2, 3) for i in range(41)] + [(50, None, 1, 2, 3), (51, [], 1, 2, 3), (52, [float("nan")] * 3, 1, 2, 3)]
    v = spark.createDataFrame(rows, schema)
    assert run(v).count() > 0 and run(v.where("false")).count() == 0
