"""What stands before and after a language model: cache and reuse by hash, deterministic stand-ins, usage.

A model is a function from a DataFrame with ``text`` to one with ``reply``; ``echo_points`` is the stand-in that makes
pipelines checkable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[DataFrame], DataFrame]


def cache_key(provider: str, model: str, prompt: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(provider), F.lit(model), F.lit(prompt), F.coalesce(text, F.lit(""))), 256)


def with_cache(requests: DataFrame, cache: DataFrame, model: Model, key: str = "key") -> DataFrame:
    """Replies from the cache where it has them; each distinct miss is asked once."""
    hits = requests.join(cache.select(key, F.col("reply").alias("cached")), key, "left")
    misses = hits.where("cached is null").dropDuplicates([key]).drop("cached")
    fresh = model(misses).select(key, F.col("reply").alias("fresh"))
    joined = hits.join(fresh, key, "left")
    return joined.select(*requests.columns, F.coalesce("cached", "fresh").alias("reply"), F.col("cached").isNotNull().alias("cache_hit"))


def reused_vectors(chunks: DataFrame, stored: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors of unchanged chunks are kept; only new text hashes are embedded, once each."""
    joined = chunks.withColumn("text_hash", F.sha2("text", 256)).join(stored.select("text_hash", F.col("vector").alias("kept")).dropDuplicates(["text_hash"]), "text_hash", "left")
    made = embed(joined.where("kept is null").select("text_hash", "text").dropDuplicates(["text_hash"])).select("text_hash", F.col("vector").alias("made"))
    return joined.join(made, "text_hash", "left").select(*chunks.columns, "text_hash", F.coalesce("kept", "made").alias("vector"), F.col("kept").isNotNull().alias("reused"))


def hash_vector(text: Column) -> Column:
    """Eight numbers of [0, 1] from a hash: the stand-in for an embedding."""
    digest = F.sha2(text, 256)
    return F.array(*[F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("double") / 65535 for i in range(8)])


def echo_points(blocks: DataFrame, most: int = 8, width: int = 80) -> DataFrame:
    """The stand-in for a summary: a point for each of the first blocks of a document, with its id as source."""
    return blocks.where(F.col("ord") < most).select("doc_id", "ord", "block_id", F.left("text", F.lit(width)).alias("point"))
