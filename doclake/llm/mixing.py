"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same fractional number of copies, target / size of the source, at most ``MOST``.
The whole part is taken; the fractions are rounded dependently.  Two documents with fractions p and q and sizes s and t
meet: mass moves from one to the other at a ratio of t : s, so that p*s + q*t stays, up or down with the odds that keep
both expectations, until one of them is 0 or 1 and is decided.  The other meets the next document.  A group of
documents thus leaves one undecided document for each source; these residuals meet in a reduction tree of ``FAN``
groups a node.

Of two documents the shorter one is mostly decided, so what is left in the end is a long document.  A hashed share of
each source, of about ``RESERVE`` times the words that its longest document could be off by, therefore waits for the
root.  There the residual and then the reserve are decided, longest first, each against all that are left, which give or
take its words in proportion.  So only the shortest document is rounded to the nearer side, and a source takes its
target to within half of that.

Groups are dealt by a hash of the key, so a source of any size is spread, and all coins are hashes of the keys:
reruns agree, however the rows are partitioned.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own and comes last; equal
rows are rounded one by one; no rows, no result; a source without words has target 0.  Other columns are kept.  Targets
are shared out on the driver, which holds one row for each source: sources are names with a weight, not keys of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclake.llm.common import mix, numbered, place_of, saved

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents of a group and groups of a node: the most rows that a task holds.
GROUP = 50_000
FAN = 64
#: Words of the reserve against those of the longest document; the smallest fraction that the reserve is made for.
RESERVE, LEAST_FRACTION = 8, 0.02
#: Sources of a task at the root.
ROOT_SOURCES = 64
_ROW = "id long, row long, group long, source string, size long, p double, copies long, reserve boolean, open boolean"


def words(text: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Share all sizes out by weight; a target stops at ``most`` times its source and the excess is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: dict[str | None, float] = {}
    free, left = list(order), float(sum(sizes.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > most * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * unit for s in free}
        for s in over:
            fixed[s] = float(most * sizes[s])
            left -= fixed[s]
        free = [s for s in free if s not in fixed]
    return fixed


def _coins(ids: np.ndarray, salt: int) -> np.ndarray:
    return (mix(mix(ids.astype(np.int64).view(np.uint64)) + np.uint64(salt)) >> np.uint64(11)).astype(float) / float(1 << 53)


def _round(ids: np.ndarray, sizes: np.ndarray, p: np.ndarray, salt: int) -> int | None:
    """Decide all but one of the fractions in place; the index of the one that is left."""
    coins = _coins(ids, salt)
    held = None
    for i in range(len(ids)):
        if not 0.0 < p[i] < 1.0:
            continue
        if held is None:
            held = i
            continue
        s, t, a, b = float(sizes[held]), float(sizes[i]), p[held], p[i]
        up, down = min((1 - a) * s, b * t), min(a * s, (1 - b) * t)  # words that may move to held, and from it
        if coins[i] * (up + down) < down:
            a, b = (1.0, b - up / t) if up == (1 - a) * s else (a + up / s, 0.0)
        else:
            a, b = (0.0, b + down / t) if down == a * s else (a - down / s, 1.0)
        p[held], p[i] = a, b
        if not 0.0 < a < 1.0:
            held = i if 0.0 < b < 1.0 else None
    return held


def _settle(ids: np.ndarray, sizes: np.ndarray, p: np.ndarray, salt: int) -> None:
    """Decide all fractions in place, longest document first, each against all that are left.

    A document that is taken takes the missing words from the others in proportion to theirs, one that is not gives its
    own to the others in proportion to their room; so all others' fractions become ``scale * p + shift``.
    """
    order = np.lexsort((ids, -sizes))
    coins = _coins(ids, salt)
    size, mass = sizes[order].astype(float), (sizes * p)[order]
    left, mass_left = size.sum() - np.cumsum(size), mass.sum() - np.cumsum(mass)
    scale, shift = 1.0, 0.0
    for n, i in enumerate(order):
        q = scale * p[i] + shift
        there = max(0.0, scale * mass_left[n] + shift * left[n]) if n + 1 < len(order) else 0.0
        room = max(0.0, left[n] - there) if n + 1 < len(order) else 0.0
        up, down = (1 - q) * size[n], q * size[n]
        may_take, may_leave = up <= there, down <= room
        if may_take == may_leave:
            take = coins[i] < q if may_take else q >= 0.5
        else:
            take = may_take
        part = min(1.0, (up / there if there else 0.0) if take else (down / room if room else 0.0))
        scale, shift = scale * (1 - part), shift * (1 - part) + (0.0 if take else part)
        p[i] = float(take)


def _node(level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        # like meets like
        rows = rows.sort_values(["source", "size", "id", "row"], ascending=[True, False, True, True], na_position="last", kind="stable").reset_index(drop=True)
        p, copies, still, reserve = rows["p"].to_numpy(float).copy(), rows["copies"].to_numpy(np.int64).copy(), np.zeros(len(rows), bool), rows["reserve"].to_numpy(bool)
        ids, sizes = rows["id"].fillna(-1).to_numpy(np.int64), rows["size"].to_numpy(np.int64)
        for index in rows.groupby("source", dropna=False).indices.values():
            plain = index[~reserve[index]]
            part = p[plain]
            held = _round(ids[plain], sizes[plain], part, level)
            p[plain] = part
            if last:
                rest = np.concatenate([index[reserve[index]], plain[[held]] if held is not None else plain[:0]])
                rest = rest[(p[rest] > 0) & (p[rest] < 1)]
                part = p[rest]
                _settle(ids[rest], sizes[rest], part, level)
                p[rest] = part
            elif held is not None:
                still[plain[held]] = True
        copies[~still] += p[~still].round().astype(np.int64)
        rows["p"], rows["copies"], rows["open"] = np.where(still, p, 0.0), copies, still
        return pa.Table.from_pandas(rows, schema=table.schema, preserve_index=False)

    return run


def copies(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of each row of ``docs``."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.lit(0).cast("long").alias("row"), F.col(source).cast("string").alias("source"), words(text).alias("size"))
    return _copies(rows, weights, most).withColumnRenamed("id", "doc_id").drop("row")


def _copies(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(id, row, size, source_size, target, copies); groups and coins are hashes of id, row is only carried."""
    spark: SparkSession = rows.sparkSession
    rows = saved(rows, "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("longest"), F.count(F.lit(1)).alias("n")).collect()  # a row per source
    aim = targets({r["source"]: r["source_size"] for r in by_source}, weights, most)
    facts = []
    for r in by_source:
        rate = min(float(most), aim[r["source"]] / r["source_size"]) if r["source_size"] else 0.0
        off = max(LEAST_FRACTION, min(rate % 1, 1 - rate % 1))
        facts.append((r["source"], r["source_size"], aim[r["source"]], rate, min(1.0, RESERVE * r["longest"] / (off * max(1, r["source_size"])))))
    facts = spark.createDataFrame(facts, "source string, source_size long, target double, rate double, share double")
    groups = max(1, math.ceil(sum(r["n"] for r in by_source) / GROUP * 4))
    joined = rows.join(F.broadcast(facts), rows["source"].eqNullSafe(facts["source"])).drop(facts["source"])
    whole, id_ = F.floor("rate"), F.coalesce("id", F.lit(-1))
    sized = joined.select("id", "row", F.pmod(F.xxhash64(id_, F.lit(7)), F.lit(groups)).alias("group"), "source", "size", F.when(F.col("size") > 0, F.col("rate") - whole).otherwise(0.0).alias("p"), F.when(F.col("size") > 0, whole).otherwise(0).cast("long").alias("copies"), (F.pmod(F.xxhash64(id_, F.lit(11)), F.lit(1 << 30)) < F.col("share") * (1 << 30)).alias("reserve"), F.lit(True).alias("open"))
    sized = saved(sized, "fractions")
    reserve, sized = sized.where("reserve"), sized.where("not reserve")
    done, level = [], 0
    while groups > 1:
        sized = saved(sized.groupBy("group").applyInArrow(_node(level, False), _ROW), "rounds")
        done.append(sized.where("not open"))
        sized, level, groups = sized.where("open").withColumn("group", F.floor(F.col("group") / FAN)), level + 1, -(-groups // FAN)
    roots = 1 + len(by_source) // ROOT_SOURCES
    out = sized.unionByName(reserve).groupBy(F.pmod(F.xxhash64("source"), F.lit(roots))).applyInArrow(_node(level, True), _ROW)
    for d in done:
        out = out.unionByName(d)
    return out.join(F.broadcast(facts), out["source"].eqNullSafe(facts["source"])).select("id", "row", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; keys may be null or repeat.

    A key's first row is rounded by the key, others by a hash of key, text, source and which of equal rows they are;
    copies are joined by a row's own number.
    """
    docs_, k, t, origin = numbered(docs), *(place_of(docs, c) for c in (key, text, source))
    same = Window.partitionBy("hash").orderBy("row")
    rows = docs_.select("row", F.col(k).cast("long").alias("key"), F.col(origin).cast("string").alias("source"), words(t).alias("size"), F.xxhash64(k, t, origin).alias("hash"))
    first = rows.groupBy("key").agg(F.min(F.struct("hash", "row")).alias("s")).select(F.col("s.row").alias("row"), F.lit(True).alias("first"))
    ranked = rows.withColumn("nth", F.row_number().over(same)).join(first, "row", "left")
    named = ranked.select(F.when(F.col("first"), F.col("key")).otherwise(F.xxhash64("hash", "nth")).alias("id"), "row", "source", "size")
    times = _copies(named).where("copies > 0").select("row", "copies")
    repeated = docs_.join(times, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.drop("row", "copies", "copy").toDF(*docs.columns)
