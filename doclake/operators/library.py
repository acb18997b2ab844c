"""Bibliographic library: listing, nesting, pivots, snapshots and change capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listing(items: DataFrame, status: str, offset: int, limit: int) -> DataFrame:
    """Active items by balance, nulls last, then title: a distributed top-k."""
    return items.where(F.col("status") == status).orderBy(F.desc_nulls_last("balance"), "title").limit(offset + limit).offset(offset).select("item_id", "title", "balance")


def title_search(items: DataFrame, pattern: str) -> DataFrame:
    """Case-insensitive containment of a literal; no wildcard of the user's has a meaning."""
    escaped = "".join("\\" + c if c in "\\%_" else c for c in pattern)
    return items.where(F.expr("title ILIKE :p ESCAPE '\\\\'".replace(":p", repr(f"%{escaped}%")))).select("item_id", "title")


def collection_counts(items: DataFrame, collections: DataFrame) -> DataFrame:
    """Active items of each collection, 0 where there are none."""
    n = items.where("status = 'active'").groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))
    return collections.join(n, "collection_id", "left").select("collection_id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n_items"))


def nested(parts: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """An ordered array of structs for each key."""
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("parts"))


def pivot(values: DataFrame, key: str, field: str, value: str, fields: list[str]) -> DataFrame:
    """Entity-attribute-value rows to columns, in one partial aggregation."""
    return values.groupBy(key).agg(*[F.max(F.when(F.col(field) == f, F.col(value))).alias(f) for f in fields])


def merged(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """A snapshot merge: added, updated, unchanged or archived, by one full outer join."""
    o, n = old.select(key, F.col(version).alias("ov")), new.select(key, F.col(version).alias("nv"))
    change = F.when(F.col("ov").isNull(), "added").when(F.col("nv").isNull(), "archived").when(F.col("ov") != F.col("nv"), "updated").otherwise("unchanged")
    return o.join(n, key, "full").select(key, change.alias("change"), F.coalesce("nv", "ov").alias("version"))


def changed_since(rows: DataFrame, parent: DataFrame, key: str, since: Column) -> DataFrame:
    """Parents changed since a mark, and parents of changed children."""
    mine = parent.where(F.col("version") > since).select(key)
    theirs = rows.where(F.col("version") > since).select(key)
    return mine.unionByName(theirs).distinct()


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key: partial aggregation would lose columns, so a window with a group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
