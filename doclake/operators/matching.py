"""One-to-one matches from scored pairs, best first."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_to_one(pairs: DataFrame, group: list[str], left: str, right: str, order: list[Column]) -> DataFrame:
    """The rows of ``pairs`` that a greedy choice in ``order`` (which leaves no ties) takes within each group, each end once.

    A pair that is the best of both its ends is taken in any case, and so two windows find most of them; only pairs of
    which neither end is taken by then go through a fold, which sees the conflicts of one group.  All windows and the
    fold share one exchange, by group.
    """
    place = lambda *by: F.row_number().over(Window.partitionBy(*group, *by).orderBy(*order))
    taken = lambda side: F.max("sure").over(Window.partitionBy(*group, side))
    marked = pairs.repartition(*group).withColumn("sure", (place(left) == 1) & (place(right) == 1))
    marked = marked.withColumn("open", ~taken(left) & ~taken(right))

    def fold(rows: pa.Table) -> pa.Table:
        used: tuple[set, set] = (set(), set())
        keep = []
        rows = rows.sort_by("place")
        for a, b in zip(rows.column(left).to_pylist(), rows.column(right).to_pylist(), strict=True):
            free = a not in used[0] and b not in used[1]
            keep.append(free)
            if free:
                used[0].add(a)
                used[1].add(b)
        return rows.filter(pa.array(keep)).drop_columns(["place"])

    contested = marked.where("open").withColumn("place", place()).select(*pairs.columns, "place")
    return marked.where("sure").select(*pairs.columns).unionByName(contested.groupBy(*group).applyInArrow(fold, pairs.schema))
