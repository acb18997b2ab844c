"""Scores of parser output against gold blocks, and lineage between versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclake.functions.geometry import iou
from doclake.operators.matching import one_to_one


def predictions(gold: DataFrame) -> DataFrame:
    """A parser's output: rectangles shifted by the document, some types wrong."""
    shift = (F.col("doc_id") % 5).cast("double") * 4
    return gold.select("doc_id", "page", "ord", F.when(F.col("ord") % 9 == 4, "other").otherwise(F.col("type")).alias("type"), *[(F.col(c) + (shift if c[0] == "y" else 0)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def overlapping(gold: DataFrame, pred: DataFrame, least: float) -> DataFrame:
    """Pairs of a page that overlap enough; the join is on (doc_id, page), of at most a page's blocks a side."""
    g = gold.select("doc_id", "page", F.col("ord").alias("g"), F.col("type").alias("g_type"), *[F.col(c).alias(f"g_{c}") for c in ("x0", "y0", "x1", "y1")])
    p = pred.select("doc_id", "page", F.col("ord").alias("p"), F.col("type").alias("p_type"), *[F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")])
    return g.join(p, ["doc_id", "page"]).withColumn("iou", F.round(iou("g_", "p_"), 6)).where(F.col("iou") >= least).select("doc_id", "page", "g", "p", "g_type", "p_type", "iou")


def matched(pairs: DataFrame) -> DataFrame:
    """One to one by falling overlap, both ends free, the higher ordinals winning ties, on the pairs of each page."""
    return one_to_one(pairs, ["doc_id", "page"], "g", "p", [F.desc("iou"), F.desc("g"), F.desc("p")])


def kendall(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Concordance of two orders within small groups: sum of signs over pairs."""
    a, b = rows.select(group, F.col(x).alias("x1"), F.col(y).alias("y1")), rows.select(group, F.col(x).alias("x2"), F.col(y).alias("y2"))
    pairs = a.join(b, group).where("x1 < x2")
    return pairs.groupBy(group).agg(F.sum(F.signum(F.col("y2") - F.col("y1"))).cast("long").alias("s"), F.count(F.lit(1)).alias("pairs"))


def same_hash(old: DataFrame, new: DataFrame) -> DataFrame:
    """The k-th old block with a text and the k-th new one of the same document."""
    number = lambda o: F.row_number().over(Window.partitionBy("doc_id", "h").orderBy(o))
    a = old.select("doc_id", F.sha2("text", 256).alias("h"), "ord").withColumn("k", number("ord"))
    b = new.select("doc_id", F.sha2("text", 256).alias("h"), "new_ord").withColumn("k", number("new_ord"))
    return a.join(b, ["doc_id", "h", "k"]).select("doc_id", "ord", "new_ord")


def report(gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """(type, gold, pred, matched, precision, recall, f1): of each type, and of all under ``all``, where any type matches.

    ``gold`` and ``pred`` have a row for each block with its type, ``pairs`` the matched ones (g_type, p_type).  A share of
    nothing is null.
    """
    count = lambda df, name: df.groupBy("type").agg(F.count("*").alias(name)).unionByName(df.agg(F.count("*").alias(name)).select(F.lit("all").alias("type"), name))
    right = pairs.where("g_type = p_type").groupBy(F.col("g_type").alias("type")).agg(F.count("*").alias("matched")).unionByName(pairs.agg(F.count("*").alias("matched")).select(F.lit("all").alias("type"), "matched"))
    rows = count(gold, "gold").join(count(pred, "pred"), "type", "full").join(right, "type", "left").fillna(0, ["gold", "pred", "matched"])
    share = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    return rows.select("type", "gold", "pred", "matched", share(F.col("matched"), F.col("pred")).alias("precision"), share(F.col("matched"), F.col("gold")).alias("recall"), share(2 * F.col("matched"), F.col("gold") + F.col("pred")).alias("f1"))
