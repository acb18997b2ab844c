"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its ``PREFIX`` nearest reference vectors.  Inverted lists hold, for each reference, the
vectors that name it; two vectors are candidates if their descriptions share a reference, counted once, in the list of
the smallest of them; all pairs of a list are verified by their exact cosine.

References are drawn by hash, and of those that are close to one another one is kept, so that a large group of unequal
near-copies cannot own them.  Where many drawn vectors lie close together, some are hubs: a vector within ``HOME`` times
the link's angle of a hub is at home at the nearest such hub, and every vector within that angle and the link's is
listed there.  By the triangle inequality no link of a vector that is at home anywhere is missed; it is counted in the
list of the smaller home of its ends.

Equal vectors are folded into one first, and counted, so a large group of copies costs no pairs.  A list is split into
blocks of about ``CELL`` vectors and worked off in pairs of blocks, so no task holds more than two; a task returns the
degrees of its vectors and a spanning forest of its links, not the links.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing; vectors
of different length don't link; a null id keeps its row, by itself; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclake.llm.common import components, saved
from doclake.llm.topk import usable

PREFIX = 8
#: Vectors of a block: the least, and the most in long lists.
CELL, MOST_CELL = 1024, 4096
#: References: a hashed sample of one vector in this many, within these bounds.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 128, 32, 2048
#: Angle to a hub within which a vector is at home there, by the angle of a link.
HOME = 1.4
#: A drawn vector may be a hub if more than one in ``DENSE`` of all drawn, and more than ``LEAST_DENSE``, are that close.
DENSE, LEAST_DENSE = 64, 3


def _units(raw: list[bytes], dtype: str) -> np.ndarray:
    m = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(float)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _angles(least: float) -> tuple[float, float]:
    """Least cosine to a hub at which a vector is at home there, and at which it may link with one that is."""
    link = math.acos(least)
    return math.cos(min(math.pi, HOME * link)), math.cos(min(math.pi, (1 + HOME) * link)) - 1e-9


def _apart(close: np.ndarray, order: np.ndarray, least: float) -> list[int]:
    """The first of each neighbourhood, in this order."""
    kept, free = [], np.ones(len(close), bool)
    for i in order.tolist():
        if free[i]:
            kept.append(i)
            free &= close[i] < least
    return kept


def references(drawn: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """References and hubs out of the drawn unit vectors."""
    home, visit = _angles(least)
    close = drawn @ drawn.T
    around = (close >= home).sum(axis=1)
    order = np.argsort(-around, kind="stable")
    dense = order[around[order] > max(LEAST_DENSE, len(drawn) / DENSE)]
    return drawn[_apart(close, order, visit)], drawn[_apart(close, dense, home)]


def places(unit: np.ndarray, pivots: np.ndarray, hubs: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each unit vector: its home (-1: none), the hubs where it is listed, its nearest references."""
    at_home, visit = _angles(least)
    near = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :PREFIX].astype(np.int32)
    if not len(hubs):
        return np.full(len(unit), -1), np.zeros((len(unit), 0), bool), near
    close = unit @ hubs.T
    return np.where(close.max(axis=1) >= at_home, close.argmax(axis=1), -1), close >= visit, near


def _postings(pivots: np.ndarray, hubs: np.ndarray, least: float, dtype: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each list of a vector; the list of hub h is -1 - h, and a vector that is at home is in no reference's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(part), -1)
                unit = flat.astype(float)
                unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
                home, listed, near = places(unit, pivots, hubs, least)
                raws, names = [r.tobytes() for r in flat], [r.tobytes() for r in near]
                guest, hub = np.nonzero(listed)
                free = np.flatnonzero(home < 0)
                who = np.concatenate([guest, np.repeat(free, near.shape[1])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([-1 - hub, near[free].ravel().astype(np.int64)])), part.column("rep").take(pa.array(who)), part.column("copies").take(pa.array(who)), pa.array(home[who].astype(np.int64)), pa.array([names[i] for i in who], pa.binary()), pa.array([raws[i] for i in who], pa.binary())],
                    ["pivot", "rep", "copies", "home", "near", "raw"],
                )

    return run


def _counted_before(near: np.ndarray, i: np.ndarray, j: np.ndarray, pivot: int) -> np.ndarray:
    """Whether the descriptions of i and j share a reference before ``pivot``."""
    out = np.zeros(len(i), bool)
    for a in range(near.shape[1]):
        mine = near[i, a]
        for b in range(near.shape[1]):
            out |= (mine == near[j, b]) & (mine < pivot)
    return out


def _verify(least: float, dtype: str) -> Callable[[pa.Table], pa.Table]:
    def run(cell: pa.Table) -> pa.Table:
        pivot, lo, hi = (cell.column(c)[0].as_py() for c in ("pivot", "lo", "hi"))
        reps, copies, own, home = (cell.column(c).to_numpy() for c in ("rep", "copies", "own", "home"))
        unit = _units(cell.column("raw").to_pylist(), dtype)
        near = np.frombuffer(b"".join(cell.column("near").to_pylist()), np.int32).reshape(len(reps), -1)
        # the list where a pair is counted is that of the smaller home, if there is one
        home = np.where(home < 0, np.iinfo(np.int64).max, home)
        left = np.flatnonzero(own == lo)
        right = left if lo == hi else np.flatnonzero(own == hi)
        edges_a, edges_b, degree = [], [], np.zeros(len(reps))
        label = np.arange(len(reps))  # of the forest so far
        for k in range(0, len(left), 256):
            rows = left[k : k + 256]
            linked = np.ones((len(rows), len(right)), bool)
            if pivot < 0:
                linked = np.minimum(home[rows][:, None], home[right][None, :]) == -1 - pivot
                if not linked.any():
                    continue
            linked &= unit[rows] @ unit[right].T >= least
            if lo == hi:
                linked &= rows[:, None] < right[None, :]
            if pivot >= 0:
                i, j = np.nonzero(linked)
                linked[i, j] = ~_counted_before(near, rows[i], right[j], pivot)
            degree[rows] += linked @ copies[right].astype(float)
            degree[right] += linked.T @ copies[rows].astype(float)
            for i in np.flatnonzero(linked.any(axis=1)).tolist():
                other = right[linked[i]]
                other = other[label[other] != label[rows[i]]]
                if len(other):
                    trees, first = np.unique(label[other], return_index=True)
                    edges_a += [rows[i]] * len(trees)
                    edges_b += other[first].tolist()
                    label[np.isin(label, trees)] = label[rows[i]]
        linked = np.flatnonzero(degree)
        a, b = reps[np.array(edges_a, np.int64)], reps[np.array(edges_b, np.int64)]
        return pa.table({"a": np.concatenate([a, reps[linked]]), "b": np.concatenate([b, reps[linked]]), "degree": np.concatenate([np.zeros(len(a), np.int64), degree[linked].astype(np.int64)])})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``."""
    kind = vectors.schema[vector].dataType.elementType
    dtype = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    ok = F.col(key).isNotNull() & usable(vector) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(T.ArrayType(T.FloatType() if dtype == "<f4" else T.DoubleType())).alias("v"), ok.alias("ok"))
    part = rows.where("ok")
    reps = saved(part.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps")
    found: DataFrame | None = None
    for (dim,) in reps.select(F.size("v").alias("dim")).distinct().collect():
        same = reps.where(F.size("v") == dim)
        n = same.count()
        drawn = same.orderBy(F.xxhash64("rep"), "rep").limit(max(LEAST_PIVOTS, min(MOST_PIVOTS, n // PER_PIVOT))).select("v").toArrow()
        pivots = drawn.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
        pivots /= np.sqrt((pivots**2).sum(axis=1))[:, None]
        pivots, hubs = references(pivots, least)
        posted = same.select("rep", "copies", "v").mapInArrow(_postings(pivots, hubs, least, dtype), "pivot long, rep long, copies long, home long, near binary, raw binary")
        posted = saved(posted, "postings")
        length = F.count(F.lit(1))
        block = F.least(F.greatest(F.lit(CELL), length / 32), F.lit(MOST_CELL))
        sizes = posted.groupBy("pivot").agg(F.ceil(length / block).alias("blocks"))  # a row per reference or hub
        dealt = posted.join(F.broadcast(sizes), "pivot").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
        celled = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("pivot", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "copies", "home", "near", "raw")
        out = celled.groupBy("pivot", "lo", "hi").applyInArrow(_verify(least, dtype), "a long, b long, degree long")
        found = out if found is None else found.unionByName(out)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = saved(found, "links")
    degrees = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("degree").alias("degree"))
    comps = components(found.where("a <> b")).withColumnsRenamed({"node": "rep"})
    facts = reps.join(degrees, "rep", "left").join(comps, "rep", "left").select("v", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = part.join(facts, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce("ok", F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
