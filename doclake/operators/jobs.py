"""Job queue and usage accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclake import constants as K
from doclake.sources.shared import saved


def latest_state(changes: DataFrame) -> DataFrame:
    """The last state of each job, by partial aggregation."""
    last = changes.groupBy("job").agg(F.max(F.struct("ts", "event_id", "kind", "status", "depends_on")).alias("s"), F.min("ts").alias("created"))
    return last.select("job", F.col("s.kind").alias("kind"), F.col("s.status").alias("status"), F.col("s.depends_on").alias("depends_on"), "created", F.col("s.event_id").alias("event_id"))


def claimable(states: DataFrame) -> DataFrame:
    """Queued jobs whose dependency is done, or that have none."""
    dep = states.select(F.col("job").alias("depends_on"), F.col("status").alias("dep_status"))
    joined = states.where("status = 'queued'").join(dep, "depends_on", "left")
    return joined.where("depends_on is null or dep_status = 'done'").select("job", "kind", "created", "event_id")


def admitted(claims: DataFrame, running: DataFrame, limits: dict[str, int], most: int) -> DataFrame:
    """Oldest first, within the limit of each kind and the free slots of all."""
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("kind")), F.lit(1))
    busy = running.groupBy("kind").agg(F.count(F.lit(1)).alias("busy"))
    per = F.row_number().over(Window.partitionBy("kind").orderBy("created", "job"))
    free = F.greatest(F.lit(0), most - F.coalesce(F.sum("busy"), F.lit(0)))
    fits = claims.withColumn("rn", per).join(busy, "kind", "left").where(F.col("rn") <= limit - F.coalesce("busy", F.lit(0)))
    first = fits.orderBy("created", "job").limit(most).withColumn("place", F.row_number().over(Window.orderBy("created", "job")))  # ``most`` rows
    return first.crossJoin(F.broadcast(busy.agg(free.alias("free")))).where("place <= free").select("job", "kind")  # one row


def cancelled(states: DataFrame) -> DataFrame:
    """Queued jobs that wait for a failed one, directly or through other queued jobs; rounds until one adds none."""
    queued = states.where("status = 'queued'").select("job", "depends_on")
    front, out = states.where("status = 'failed'").select("job"), None
    while True:
        hit = queued.join(front.select(F.col("job").alias("depends_on")), "depends_on", "left_semi").select("job")
        front = saved(hit if out is None else hit.join(out, "job", "left_anti"), "cancelled")
        if front.isEmpty():
            return front if out is None else out
        out = front if out is None else out.unionByName(front)


def usage(calls: DataFrame) -> DataFrame:
    """Totals by task and prompt, and over all."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.col("cache_hit").cast("long")).alias("hits"), F.sum("input").alias("input"), F.sum("cached").alias("cached")]
    by = calls.groupingSets([["task", "prompt"], []], "task", "prompt").agg(*sums)
    return by.withColumn("hit_share", F.when(F.col("n") > 0, F.round(F.col("hits") / F.col("n"), 6)))
