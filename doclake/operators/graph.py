"""Property graphs: scores, pruning, duplicate relations, bundles, top edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclake import constants as K


def degrees(relations: DataFrame) -> DataFrame:
    """Twice the number of edges plus the number of distinct blocks that name the node."""
    ends = relations.select(F.explode(F.array("src", "dst")).alias("node"), "block")
    return ends.groupBy("node").agg((2 * F.count(F.lit(1)) + F.countDistinct("block")).alias("score"))


def prune(scored: DataFrame, concept: str, most: int = K.KG_MAX, concepts: int = K.KG_CONCEPTS) -> DataFrame:
    """Best nodes overall, of which at most so many concepts.

    One pass over the scores: of each class at most ``max(most, concepts)`` rows leave a task, as the rank's limit does.
    """
    best = [F.desc("score"), F.asc("node")]
    nth = F.row_number().over(Window.partitionBy("concept").orderBy(*best))
    few = scored.withColumn("concept", F.col("node").startswith(concept)).withColumn("nth", nth).where(F.col("nth") <= max(most, concepts))
    return few.where(~F.col("concept") | (F.col("nth") <= concepts)).orderBy(*best).limit(most).select("node", "score", "concept")


def best_relations(relations: DataFrame) -> DataFrame:
    """Of equal (src, dst, type, block), the most confident, the first on ties."""
    w = Window.partitionBy("src", "dst", "type", "block").orderBy(F.desc("confidence"), "seq")
    return relations.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def bundles(relations: DataFrame) -> DataFrame:
    """Parallel edges as one, with their number and label."""
    n = relations.groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("confidence"), 6).alias("confidence"))
    return n.withColumn("label", F.when(F.col("n") > 1, F.concat("type", F.lit(" ×"), F.col("n").cast("string"))).otherwise(F.col("type")))
