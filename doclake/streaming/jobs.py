"""Streams of job changes and usage facts.

State lives per key in Spark's state store; late rows are cut off by watermarks.  The windows are an addition: the
batch engine has no event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Which states may follow a state; anything else is ignored.
NEXT = {None: {"queued", "running"}, "queued": {"running", "cancelled"}, "running": {"done", "failed", "cancelled", "queued"}, "failed": {"queued"}}


def advance(status: str | None, changes: list[str]) -> tuple[str | None, int]:
    """The state after a series of changes, and how many of them were allowed."""
    allowed = 0
    for c in changes:
        if c in NEXT.get(status, set()):
            status, allowed = c, allowed + 1
    return status, allowed


def _per_job(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, steps = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    status, more = advance(status, rows["status"].tolist())
    state.update((status, steps + more))
    yield pd.DataFrame({"job": [key[0]], "status": [status], "steps": [steps + more]})


def job_states(changes: DataFrame) -> DataFrame:
    """The state machine of each job over a stream of (job, ts, event_id, status)."""
    return changes.groupBy("job").applyInPandasWithState(_per_job, "job long, status string, steps int", "status string, steps int", "update", GroupStateTimeout.NoTimeout)


def usage_by_window(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling totals of model usage with a watermark."""
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "task").agg(F.count(F.lit(1)).alias("n"), F.sum("input").alias("input"))


def first_requests(requests: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Requests in flight with equal keys are answered once."""
    return requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
