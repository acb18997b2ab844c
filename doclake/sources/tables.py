"""Readers of the driver tables and their binding to documents, blocks, libraries, trees, jobs and usage facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake import constants as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(documents: DataFrame) -> DataFrame:
    """One row a line of text: doc_id, ord, block_id, type, level, text.  A narrow map: no shuffle."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    kind = F.when(F.col("ord") == 0, "title").when(F.col("ord") == 1, "abstract").when(F.length("text") < 80, "heading").otherwise("paragraph")
    return rows.select("doc_id", "ord", F.concat(F.lit("b_"), F.lpad(F.col("ord").cast("string"), 4, "0")).alias("block_id"), kind.alias("type"), (1 + F.col("ord") % 3).alias("level"), "text")


def anchors(rows: DataFrame) -> DataFrame:
    """Blocks with a page and a rectangle: ten lines a page, full width of the body."""
    slot = F.col("ord") % K.LINES_PER_PAGE
    height = K.PAGE_HEIGHT / K.LINES_PER_PAGE
    return rows.withColumns({"page": F.expr(f"ord div {K.LINES_PER_PAGE}").cast("int"), "x0": F.lit(72.0), "y0": slot * F.lit(height), "x1": F.lit(K.PAGE_WIDTH - 72.0), "y1": (slot + 1) * F.lit(height) - 4.0})


def new_version(rows: DataFrame) -> DataFrame:
    """A re-parse of the blocks: some lines are gone and the rest is numbered anew."""
    from pyspark.sql import Window

    kept = rows.where("ord % 7 <> 3")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    text = F.when(F.col("ord") % 11 == 5, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text"))
    return kept.select("doc_id", number.alias("new_ord"), F.concat(F.lit("b_"), F.lpad(number.cast("string"), 4, "0")).alias("new_id"), text.alias("text"))


def turns(conversations: DataFrame) -> DataFrame:
    """A binary tree of turns in each conversation: node, parent."""
    return conversations.select("conv_id", F.col("turn").alias("node"), F.when(F.col("turn") > 0, F.expr("(turn - 1) div 2")).alias("parent"), "role", "text")


def calls(events: DataFrame) -> DataFrame:
    """Model-usage facts."""
    return events.select(
        "event_id", "ts", F.col("event_type").alias("task"), F.concat("event_type", F.lit("@"), (F.col("user_id") % 3).cast("string")).alias("prompt"),
        F.floor("value").cast("long").alias("input"), F.floor(F.col("value") * F.lit(0.3)).cast("long").alias("cached"), (F.col("event_id") % 4 == 0).alias("cache_hit"),
    )


def jobs(events: DataFrame) -> DataFrame:
    """State changes of jobs: job, kind, at, status, depends_on."""
    status = F.element_at(F.map_from_arrays(F.array(*map(F.lit, ("signup", "view", "click", "purchase", "error"))), F.array(*map(F.lit, ("queued", "queued", "running", "done", "failed")))), F.col("event_type"))
    return events.select(F.col("user_id").alias("job"), F.concat(F.lit("k"), (F.col("user_id") % 4).cast("string")).alias("kind"), "event_id", "ts", status.alias("status"), F.when(F.col("user_id") % 3 != 0, F.col("user_id") - 1).alias("depends_on"))


def items(customer: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("item_id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("collection_id"), F.col("c_mktsegment").alias("tag"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("archived").alias("status"))


def relations(lineitem: DataFrame) -> DataFrame:
    """Edges of a property graph: src (part), dst (supplier), type, block, confidence."""
    return lineitem.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("seq"), (F.lit(1.0) - F.col("l_discount")).alias("confidence"))
