"""Every query against its SQL, at the smallest scale: names, types and values."""

from __future__ import annotations

import pytest

from doclake.plans.oracles import ORACLES
from doclake.plans.queries import QUERIES

#: Held against results on small fixtures instead (test_operators, test_documents).
WITHOUT_SQL = {"levenshtein_ned", "chunk_texts", "section_groups_budget", "context_assembled", "kg_extract", "kg_document_prune", "annotation_migrate", "consensus_pages", "table_tags", "map_blocks_fuzzy", "figure_merge"}
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def values(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES) | WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    kinds = {c[0]: str(c[1]) for c in found.description}
    assert {n: KINDS[k] for n, k in df.dtypes} == kinds
    assert values(df.columns, df.collect()) == values(names, found.fetchall())
