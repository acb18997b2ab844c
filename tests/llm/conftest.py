"""Small documents with every awkward case: nulls, empties, repeats, clashing extra columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t int, score string, spans int, k string, toxic string"


@pytest.fixture(scope="session")
def rows():
    draw = random.Random(5)
    words = {"en": "the of and ship wheel thing both that with have from they".split(), "de": "der und nicht schön über wenn auch eine zwischen möchte".split()}
    out = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        text = " ".join(draw.choice(words[lang]) for _ in range(draw.randrange(5, 90)))
        if i % 10 == 4:
            text += " idiot scum"
        out.append((i, text, lang, f"s{i % 4}"))
    out += [(60, None, "en", "s0"), (61, "", None, None), (62, "  \n ", "de", None), (63, "12 34 !!", "en", "s1"), (64, out[7][1], "en", "s1"), (65, out[7][1] + " of", "en", None), (None, "und nicht", "de", "s2"), (66, "und über " * 3000, "de", "s3")]
    return [(a, b, c, d, None if b is None else len(b), "x", 1, "y", 2, None, "z") for a, b, c, d in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
