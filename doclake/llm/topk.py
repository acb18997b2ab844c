"""Exact top-k by inner product over norm-sorted blocks with rotated partial sums.

Vectors are rotated by the singular vectors of the whole table (from its Gram matrix, one partial matrix a partition),
so that the first ``HEAD`` coordinates carry most of every inner product.  Candidates lie in blocks of descending
length; queries in blocks of any order.  A first pass of each query block over the blocks of the longest candidates
gives every query a k-th score.  A pair of blocks is then looked at only if some query's length times the block's
greatest length can reach that query's k-th score; inside it, partial sums over the head plus the Cauchy-Schwarz bound
of the rest, |q_rest| * |x_rest|, discard candidates, and what is left gets its exact integer score.

Queries meet candidates block by block (a stated query set against all rows), never row by row.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; a shorter vector counts as
padded with zeros; ties go to the smaller id; rows that share the query's id are the query's own; fewer than k
candidates are all returned; empty tables give no rows.  Scores that leave 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.llm.common import partitions, saved

HEAD = 16
QUERY_BLOCK = 2048
BLOCK = 4096
_BLOCK_SCHEMA = "block long, rows long, longest double, ids binary, ints binary, floats binary"


def usable(vector: str) -> Column:
    """Whether a vector has components, all of them finite."""
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantised(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v): the vectors that take part, as integers, with their squared length."""
    ints = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    rows = vectors.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), ints.alias("v"))
    return rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    lists = column if isinstance(column, pa.Array) else column.combine_chunks()
    out = np.zeros((len(lists), dim), np.int64)
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)] = flat
    return out


def _gram(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column("v"), dim).astype(float)
            total += m.T @ m
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "x"])

    return run


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of the table, strongest first; dim * dim sums come to the driver."""
    cells = rows.select("v").mapInArrow(_gram(dim), "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    gram = np.zeros((dim, dim))
    gram[cells["i"], cells["j"]] = cells["x"]
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def _blocks(basis: np.ndarray, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pack the rows of a partition, in their order, into blocks."""
    dim = len(basis)

    def pack(part: int, n: int, ids: np.ndarray, ints: np.ndarray) -> pa.RecordBatch:
        floats = ints.astype(float) @ basis
        row = [[part << 24 | n], [len(ids)], [float(np.sqrt((floats**2).sum(1).max()))], [ids.tobytes()], [ints.tobytes()], [floats.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["block", "rows", "longest", "ids", "ints", "floats"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, ids, ints = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64), np.zeros((0, dim), np.int64)
        for batch in batches:
            ids, ints = np.concatenate([ids, batch.column("id").to_numpy()]), np.concatenate([ints, _matrix(batch.column("v"), dim)])
            while len(ids) >= size:
                yield pack(part, n, ids[:size], ints[:size])
                n, ids, ints = n + 1, ids[size:], ints[size:]
        if len(ids):
            yield pack(part, n, ids, ints)

    return run


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of q and x, through doubles where they are exact."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if bound < 2.0**52:
        return np.rint(q.astype(float) @ x.astype(float).T).astype(np.int64)
    if bound >= 2.0**63:
        raise OverflowError("inner products leave 64 bits")
    return q @ x.T


def _search(k: int, dim: int, head: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row holds a query block, with a lower bound of each query's k-th score, and a candidate block."""

    def one(r: dict) -> pa.RecordBatch:
        q_ids, x_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
        q_int, x_int = (np.frombuffer(r[c], np.int64).reshape(-1, dim) for c in ("q_ints", "ints"))
        q, x = (np.frombuffer(r[c]).reshape(-1, dim) for c in ("q_floats", "floats"))
        least = np.frombuffer(r["least"]) if r["least"] else np.full(len(q_ids), -np.inf)
        q_rest, x_rest = (np.sqrt((m[:, head:] ** 2).sum(1)) for m in (q, x))
        out: list[tuple[np.ndarray, ...]] = []
        for lo in range(0, len(q_ids), 512):
            part = slice(lo, lo + 512)
            slack = 1e-9 * (1 + np.abs(least[part])) + 1e-6
            bound = q[part, :head] @ x[:, :head].T + q_rest[part, None] * x_rest[None, :]
            possible = bound >= np.where(np.isfinite(least[part]), least[part] - slack, -np.inf)[:, None]
            live = np.flatnonzero(possible.any(axis=0))
            if not len(live):
                continue
            scores = _exact(q_int[part], x_int[live])
            ok = possible[:, live] & (scores >= least[part][:, None]) & (q_ids[part, None] != x_ids[live][None, :])
            for i in np.flatnonzero(ok.any(axis=1)):
                at = np.flatnonzero(ok[i])
                if len(at) > k:
                    cut = np.partition(scores[i, at], len(at) - k)[len(at) - k]
                    at = at[scores[i, at] >= cut]
                at = at[np.lexsort((x_ids[live[at]], -scores[i, at]))][:k]
                out.append((np.full(len(at), q_ids[lo + i]), x_ids[live[at]], scores[i, at]))
        columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield one(batch.slice(i, 1).to_pylist()[0])

    return run


def _first_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding", head: int = HEAD) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every row that ``is_query`` picks."""
    spark, width = vectors.sparkSession, partitions(vectors.sparkSession)
    rows = quantised(vectors, key, vector, scale)
    dim, n = rows.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return empty
    basis = rotation(rows, dim)
    parts = max(1, min(width * 64, -(-n // BLOCK)))
    ordered = rows.repartitionByRange(parts, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    blocks = saved(ordered.select("id", "v").mapInArrow(_blocks(basis, BLOCK), _BLOCK_SCHEMA), "blocks")
    asked = quantised(vectors.where(is_query), key, vector, scale).select("id", "v").dropDuplicates(["id", "v"])
    queries = saved(asked.repartition(max(1, -(-n // (20 * QUERY_BLOCK))), "id").mapInArrow(_blocks(basis, QUERY_BLOCK), _BLOCK_SCHEMA), "queries")
    names = {c: f"q_{c}" for c in queries.columns}
    queries = queries.withColumnsRenamed(names)

    def scan(pairs: DataFrame) -> DataFrame:
        """pairs: q_block, block, least."""
        full = pairs.join(queries, "q_block").join(blocks, "block").select("q_ids", "q_ints", "q_floats", "ids", "ints", "floats", "least")
        return full.repartition(width).mapInArrow(_search(k, dim, head), "query_id long, vec_id long, score long")

    heads = blocks.select("block", "longest", "rows").orderBy(F.desc("longest"), "block").limit(1)
    first = queries.select("q_block").join(F.broadcast(heads.select("block")), how="cross")  # one block
    seen = saved(scan(first.withColumn("least", F.lit(None).cast("binary"))), "first")
    kth = _first_k(seen, k).groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n"))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["q_ids"], np.int64)
                norm = np.sqrt((np.frombuffer(r["q_floats"]).reshape(-1, dim) ** 2).sum(1))
                known = dict(zip(r["known"] or [], r["scores"] or [], strict=True))
                least = np.array([known.get(int(i), -np.inf) for i in ids], float)
                need = least / np.maximum(norm, 1e-300)  # the shortest candidate that can still reach it
                need[(least <= 0)] = -1.0
                yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]]), pa.array([least.tobytes()]), pa.array([float(need.min(initial=np.inf))])], ["q_block", "least", "need"])

    owners = queries.select("q_block", F.expr("q_ids").alias("raw")).mapInArrow(_ids, "q_block long, query_id long")
    by_block = owners.join(kth.where(F.col("n") >= k), "query_id").groupBy("q_block").agg(F.collect_list("query_id").alias("known"), F.collect_list("s").alias("scores"))  # at most QUERY_BLOCK each
    limits = saved(queries.select("q_block", "q_ids", "q_floats").join(by_block, "q_block", "left").mapInArrow(bounds, "q_block long, least binary, need double"), "limits")
    others = blocks.select("block", "longest").join(heads.select("block"), "block", "left_anti")
    pairs = limits.join(others, F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("need")).select("q_block", "block", "least")
    best = _first_k(seen.unionByName(scan(pairs)), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["raw"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]] * len(ids), pa.int64()), pa.array(ids)], ["q_block", "query_id"])
