"""Helpers shared by the operators: tables in the shared folder, batches of text, hashes, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="spark-doclake-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], True)
    return f"file://{_OWN_DIR[0]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/doclake-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def place_of(docs: DataFrame, name: str) -> str:
    """The name that ``plain`` gives to a column."""
    return f"c{docs.columns.index(name)}"


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named by place, so that none can clash with a name of our own or be misread."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def numbered(docs: DataFrame) -> DataFrame:
    """``plain(docs)`` with a number of its own for each row, in the column ``row``.

    Written once, as the numbers follow the partitions; two reads of the table agree.
    """
    return saved(plain(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")


def with_made(docs: DataFrame, text: str, made: list[tuple[str, str | DataType]], f: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``docs`` with columns made of each text: (name, type) of each; a column that has the name already is replaced."""
    names = [n for n, _ in made]
    kept = [i for i, c in enumerate(docs.columns) if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*batch.columns[1:], *f(batch.column(0))]
            yield pa.RecordBatch.from_arrays(columns, [f"m{i}" for i in range(len(columns))])

    schema = StructType([StructField(f"m{n}", docs.schema[i].dataType) for n, i in enumerate(kept)])
    for n, (_, kind) in enumerate(made, len(kept)):
        schema = schema.add(f"m{n}", kind)
    rows = plain(docs).select(F.col(place_of(docs, text)).alias("text"), *[f"c{i}" for i in kept])
    return rows.mapInArrow(run, schema).toDF(*[docs.columns[i] for i in kept], *names)


def drop_saved(df: DataFrame) -> None:
    """Delete the files of a table made by ``saved`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- text in numpy ---------------------------------------------------------------------------------------------------

#: Characters that are taken through numpy at a time; a longer text goes alone.
CHUNK_CHARS = 400_000


def chunks_of(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each text followed by a 0, and the offset of each text."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return codes, np.concatenate([[0], np.cumsum(lengths)])


_CLASSES: dict[str, np.ndarray] = {}


def char_class(name: str) -> np.ndarray:
    """A table over all code points of ``str.isalpha`` or ``str.isalnum``."""
    if name not in _CLASSES:
        test = getattr(str, name)
        _CLASSES[name] = np.fromiter((test(chr(i)) for i in range(0x110000)), bool, 0x110000)
    return _CLASSES[name]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = np.asarray(h, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] for many runs at once, from one prefix sum of a polynomial."""
    up, down = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values.astype(np.uint64) + np.uint64(1)) * up[: len(values)])])
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """A text column as a list; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


# --- connected components --------------------------------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges``.

    Alternating large-star and small-star contraction: every round is two grouped minima over the edges that are left,
    a node's least neighbour is a partial aggregate, and rounds grow with the logarithm of the longest path.  The edges
    of a hub meet one row in a join; they are two numbers each, and adaptive execution splits a partition that is large.
    Each round is written, so a lost executor costs one round.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = saved(e, "edges")
    nodes = e
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        same = after.count() == e.count() and after.join(e, ["u", "v"], "left_anti").isEmpty()
        if e is not nodes:
            drop_saved(e)
        e = after
        if same:
            break
    everyone = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return everyone.join(e.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
