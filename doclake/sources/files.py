"""File sources and sinks: PDF bytes, layout JSON, whole-document replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Explicit, so that no file is read twice to infer it: coordinates are shares of the page.
LAYOUT = "doc_id string, pages array<struct<width double, height double, blocks array<struct<type string, bbox array<double>, content array<struct<kind string, s string>>>>>>"
BUCKETS = 64


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, doc_id, is_pdf of every file; the bytes stay in the scan."""
    digest = F.sha2("content", 256)
    return spark.read.format("binaryFile").load(path).select("path", digest.alias("sha256"), F.concat(F.lit("d_"), F.left(digest, F.lit(16))).alias("doc_id"), (F.left("content", F.lit(5)) == F.lit(b"%PDF-")).alias("is_pdf"))


def layout_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of parsed pages in reading order, with rectangles in points and text of their parts."""
    docs = spark.read.schema(LAYOUT).json(path, multiLine=True)
    pages = docs.select("doc_id", F.posexplode("pages").alias("page", "p"))
    rows = pages.select("doc_id", "page", F.col("p.width").alias("w"), F.col("p.height").alias("h"), F.posexplode("p.blocks").alias("ord", "b"))
    sides = {n: F.round(F.least(F.greatest(F.element_at("b.bbox", i + 1), F.lit(0.0)), F.lit(1.0)) * F.col("w" if i % 2 == 0 else "h"), 2) for i, n in enumerate(("x0", "y0", "x1", "y1"))}
    text = F.trim(F.array_join(F.transform("b.content", lambda c: F.when(c["kind"] == "math", F.concat(F.lit("$"), c["s"], F.lit("$"))).otherwise(c["s"])), " "))
    return rows.select("doc_id", "page", "ord", F.col("b.type").alias("type"), *[v.alias(k) for k, v in sides.items()], text.alias("text"))


def replace_documents(rows: DataFrame, path: str) -> None:
    """Write whole documents by buckets of their id; the buckets that ``rows`` touches are replaced, the others stay.

    ``rows`` must hold every document of the buckets it touches: join what is stored with what is new first.
    """
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    bucketed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def with_replaced(stored: DataFrame, new: DataFrame) -> DataFrame:
    """What ``replace_documents`` is to write: new documents in place of old ones, in the buckets that they touch."""
    touched = new.select(F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("bucket")).distinct()
    kept = stored.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))).join(F.broadcast(touched), "bucket", "left_semi").drop("bucket")  # at most BUCKETS rows
    return kept.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)
