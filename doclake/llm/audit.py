"""Filter interaction audit: what each of five quality filters removes in every order, from one CUBE over failure flags.

Every document is reduced to its part and five flags, and those to at most 32 rows a part.  A CUBE over the flags and
the part then holds, in the grouping sets whose chosen flags are all false, how many documents survive each subset of
the filters.  A step of an order removes what survives the filters before it and not the filter itself, so pairs of
subsets, joined, give all 120 orders.  Nothing but built-in DataFrame functions is used.

Defined cases: a null text is the empty text, a null or empty part is the part ''; a row with a null key is a copy of
nothing; equal rows with one key are no copies of each other; a key that is labelled twice has a label if either row
gives it; rows with a label whose key is null label nothing; no documents, no rows; other columns are not read.  A
very long text is worked on as a whole in its row.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import place_of, plain, saved

FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
#: Rows with a null key join nothing; they are spread over so many values, so that they don't meet in one task.
SPREAD = 4096


def failures(docs: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(key, part, A to E): the filters that each row fails.

    The row of a text's smallest key is found by a grouped minimum, and that key is joined to the rows by key and digest
    of the text: each row meets one row at most, however many copies a text has.
    """
    body = F.coalesce(F.col(place_of(docs, text)), F.lit(""))
    words = F.array_remove(F.split(body, SPACES), "")
    seen = plain(docs).select(
        F.col(place_of(docs, key)).cast("long").alias("key"), F.coalesce(F.col(place_of(docs, part)).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"),
        words.alias("words"), (100 * F.regexp_count(body, F.lit("[A-Z]")) > 2 * F.length(body)).alias("C"), body.rlike(r"[#$%&*|]").alias("D"),
    ).withColumns({"n": F.size("words"), "different": F.size(F.array_distinct("words"))})
    rows = saved(seen.select("key", "part", "digest", (F.col("n") < 200).alias("A"), (100 * F.col("different") < 50 * F.col("n")).alias("B"), "C", "D"), "flags")
    first = rows.groupBy("digest").agg(F.min("key").alias("key")).where("key IS NOT NULL").select("digest", "key", F.lit(0).alias("spread"), F.lit(True).alias("first"))
    spread = F.when(F.col("key").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")).otherwise(0)
    met = rows.withColumn("spread", spread).join(first, ["key", "spread", "digest"], "left")
    return met.select("key", "spread", "part", "A", "B", "C", "D", (F.col("key").isNotNull() & F.col("first").isNull()).alias("E"))


def survivors(failed: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality", bad: str = "toxic") -> DataFrame:
    """(part, passed, n, good, toxic): documents of each part that pass a subset of the filters, as a sum of 1 << place; subsets with a survivor only."""
    marks = plain(labels).select(F.col(place_of(labels, key)).cast("long").alias("key"), (F.col(place_of(labels, good)) == 1).alias("good"), (F.col(place_of(labels, bad)) == 1).alias("toxic"))
    marks = marks.where("key IS NOT NULL").groupBy("key").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("spread", F.lit(0))
    count = lambda name: F.count_if(F.coalesce(F.col(name), F.lit(False))).alias(name)
    profiles = failed.join(marks, ["key", "spread"], "left").groupBy("part", *FILTERS).agg(F.count("*").alias("n"), count("good"), count("toxic"))
    cube = profiles.cube("part", *FILTERS).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")], F.grouping("part").alias("all_parts"), *[F.grouping(f).alias(f"any_{f}") for f in FILTERS])
    passes = [(F.col(f"any_{f}") == 1) | ~F.col(f) for f in FILTERS]
    chosen = sum(((1 - F.col(f"any_{f}").cast("int")) * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    return cube.where((F.col("all_parts") == 0) & F.reduce(F.array(*passes), F.lit(True), lambda x, y: x & y)).select("part", chosen.alias("passed"), "n", "good", "toxic")


def _orders() -> list[tuple[str, int, str, int]]:
    """(order, step, its filter, subset before it): 600 rows."""
    return [("".join(o), k + 1, o[k], sum(1 << FILTERS.index(f) for f in o[:k])) for o in permutations(FILTERS) for k in range(len(FILTERS))]


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """A row for each part, order of the five filters and step."""
    spark, everything = docs.sparkSession, (1 << len(FILTERS)) - 1
    alive = saved(survivors(failures(docs, text, key, part), labels), "survivors")
    grid = alive.where("passed = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(everything))).alias("passed"))
    whole = grid.join(alive, ["part", "passed"], "left").fillna(0, ["n", "good", "toxic"])
    steps = [(s, s | 1 << i, f, factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())) for s in range(everything + 1) for i, f in enumerate(FILTERS) if not s >> i & 1]
    step = F.broadcast(spark.createDataFrame(steps, "passed int, then int, filter string, orders long"))  # 80 rows
    after = whole.select("part", F.col("passed").alias("then"), *[F.col(c).alias(f"{c}_after") for c in ("n", "good", "toxic")])
    lost: dict[str, Column] = {c: F.col(c) - F.col(f"{c}_after") for c in ("n", "good", "toxic")}
    pairs = whole.join(step, "passed").join(after, ["part", "then"]).select("part", "passed", "filter", "orders", F.col("n_after").alias("kept"), lost["n"].alias("removed"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"))
    alone = F.max(F.when(F.col("passed") == 0, F.col("removed")))
    last = F.max(F.when(F.bit_count("passed") == len(FILTERS) - 1, F.col("removed")))
    totals = pairs.groupBy("part", "filter").agg(alone.alias("fails"), last.alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    order = F.broadcast(spark.createDataFrame(_orders(), "filter_order string, step int, filter string, passed int"))  # 600 rows
    found = pairs.join(totals, ["part", "filter"]).join(order, ["filter", "passed"])
    return found.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
