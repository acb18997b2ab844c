"""Block mapping after a re-parse: exact by hash, then fuzzy on the same page, greedy one to one."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake import constants as K
from doclake.functions.geometry import iou
from doclake.functions.udfs import outline, similarity
from doclake.operators.matching import one_to_one
from doclake.sources.shared import saved_large


BOXES = ("x0", "y0", "x1", "y1")


def page_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """The pairs of blocks of a page, how much they overlap, how alike they must read, and how alike they can be at most.

    Of two texts with t characters in all, of which matching blocks cover m on either side, the ratio is 2m/t.  m is at
    most the shorter length and at most what the texts share as multisets of letters.  Between two matching blocks lies
    a letter that is in none, so there are at most t - 2m + 1 of them, and m less that many pairs of neighbours are
    shared: 3m <= t + 1 + the shared pairs.
    """
    side = lambda df, name, p: df.select("doc_id", "page", F.col("id").alias(name), outline("text").alias(f"{p}o"), *[F.col(c).alias(f"{p}{c}") for c in BOXES])
    both = side(old, "old", "a_").hint("merge").join(side(new, "new", "b_"), ["doc_id", "page"])
    total = F.col("a_o.n") + F.col("b_o.n")
    shared = lambda c: F.aggregate(F.zip_with(f"a_o.{c}", f"b_o.{c}", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    short = F.least("a_o.n", "b_o.n")
    placed = both.withColumn("overlap", iou("a_", "b_")).withColumn("least", F.when(F.col("overlap") >= K.MAP_IOU, K.MAP_LIKE).otherwise(K.MAP_SIMILARITY))
    close = placed.where(2 * short >= F.col("least") * total)
    most = F.least(F.lit(1.0), 2 * shared("letters") / total, 2 * (total + 1 + shared("neighbours")) / (3 * total))
    return close.withColumn("most", F.when(total > 0, most).otherwise(0.0))


def fuzzy_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Candidates of a page that overlap and read alike, or read almost the same; both sides are what exact matching left.

    Texts are compared letter by letter only where the bounds leave a chance.
    """
    asked = page_pairs(old, new).where(F.col("most") >= F.col("least")).withColumn("alike", similarity("a_o.text", "b_o.text"))
    return asked.where(F.col("alike") >= F.col("least")).select("doc_id", "page", "old", "new", (F.col("alike") + F.col("overlap")).alias("score"))


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """Best pairs of each page first, both sides once."""
    return one_to_one(pairs, ["doc_id", "page"], "old", "new", [F.desc("score"), F.asc("old"), F.asc("new")]).select("doc_id", "old", "new")


def mapped(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, old, new, kind): blocks of a document in its new version, by equal texts in turn, then by likeness on a page.

    Both sides: doc_id, id, ord, page, text and a rectangle.  A text that is null is the empty text.
    """
    nth = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("ord", "id"))
    keyed = lambda df, name: df.select("doc_id", F.col("id").alias(name), "ord", "id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).withColumn("k", nth).select("doc_id", name, "h", "k")
    exact = saved_large(keyed(old, "old").join(keyed(new, "new"), ["doc_id", "h", "k"]).select("doc_id", "old", "new"), "exact")
    rest = lambda df, name: df.join(exact.select("doc_id", F.col(name).alias("id")), ["doc_id", "id"], "left_anti")
    fuzzy = greedy_matches(fuzzy_pairs(rest(old, "old"), rest(new, "new")))
    return exact.withColumn("kind", F.lit("exact")).unionByName(fuzzy.withColumn("kind", F.lit("fuzzy")))


# --- what refers to blocks moves along; ``mapping``: doc_id, old, new ---


def _lookup(rows: DataFrame, key: list[str], ids: Column, mapping: DataFrame) -> DataFrame:
    """``rows`` with a map from each of their ids that moves to its new one."""
    wanted = rows.select("doc_id", *key, F.explode(F.array_distinct(ids)).alias("old"))
    moves = wanted.join(mapping, ["doc_id", "old"]).groupBy("doc_id", *key).agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("moves"))
    empty = F.create_map().cast("map<string, string>")
    return rows.join(moves, ["doc_id", *key], "left").withColumn("moves", F.coalesce("moves", empty))


def _moved(ids: Column) -> Column:
    return F.filter(F.transform(ids, lambda i: F.element_at("moves", i)), lambda i: i.isNotNull())


def moved_points(points: DataFrame, mapping: DataFrame) -> DataFrame:
    """Points (doc_id, summary, point, block_ids) with moved ids; ``untraced`` without any, ``lost`` if some are gone."""
    rows = _lookup(points, ["summary", "point"], F.col("block_ids"), mapping).withColumn("moved", _moved(F.col("block_ids")))
    return rows.select("doc_id", "summary", "point", F.col("moved").alias("block_ids"), (F.size("moved") == 0).alias("untraced"), (F.size("moved") < F.size("block_ids")).alias("lost"))


def summary_status(points: DataFrame) -> DataFrame:
    """Of moved points: a summary that lost an id is stale; its coverage is counted anew."""
    cited = F.count_if(~F.col("untraced"))
    return points.groupBy("doc_id", "summary").agg(F.count(F.lit(1)).alias("points"), cited.alias("cited_points"), F.round(cited / F.count(F.lit(1)), 4).alias("coverage"), F.when(F.max("lost"), "stale").otherwise("ok").alias("status"))


MARK = "\\[(b_[0-9]+)\\]"


def moved_answers(answers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Answers (doc_id, answer, text, citations) with marks and citations rewritten; marks that don't move vanish."""
    marks = F.regexp_extract_all("text", F.lit(MARK), 1)
    rows = _lookup(answers, ["answer"], F.concat(marks, F.col("citations")), mapping)
    between = F.split("text", MARK, -1)
    shown = F.transform(marks, lambda i: F.coalesce(F.concat(F.lit("["), F.element_at("moves", i), F.lit("]")), F.lit("")))
    text = F.array_join(F.zip_with(between, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    lost = (F.size(_moved(marks)) < F.size(marks)) | (F.size(_moved(F.col("citations"))) < F.size("citations"))
    return rows.select("doc_id", "answer", text.alias("text"), _moved(F.col("citations")).alias("citations"), F.when(lost, "stale").otherwise("ok").alias("status"))


def moved_mentions(mentions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mentions (doc_id, block_id, ...) in blocks that move; the others are dropped."""
    return mentions.withColumnRenamed("block_id", "old").join(mapping, ["doc_id", "old"]).drop("old").withColumnRenamed("new", "block_id")


def moved_relations(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relations (doc_id, block_id, ...) with moved sources; without one they stay, stale."""
    rows = relations.withColumnRenamed("block_id", "old").join(mapping, ["doc_id", "old"], "left")
    return rows.withColumns({"status": F.when(F.col("new").isNull(), "stale").otherwise("ok"), "block_id": F.coalesce("new", "old")}).drop("old", "new")


def _holders(lost: pa.Table, blocks: pa.Table) -> pa.Table:
    """The quotes that only one block of a document has, with the first place there: one pass over its texts."""
    quotes = ahocorasick.Automaton()
    for q in set(lost.column("quote").to_pylist()):
        quotes.add_word(q, q)
    found: dict[str, dict[str, int]] = {}
    if len(quotes):
        quotes.make_automaton()
        for block, text in zip(blocks.column("block_id").to_pylist(), blocks.column("text").to_pylist(), strict=True):
            for end, q in quotes.iter(text or ""):
                found.setdefault(q, {}).setdefault(block, end + 1 - len(q))
    once = [(q, *next(iter(at.items()))) for q, at in found.items() if len(at) == 1]
    doc = lost.column("doc_id")[:1].to_pylist() * len(once)
    return pa.table({"doc_id": pa.array(doc, lost.schema.field("doc_id").type), **{c: pa.array([o[i] for o in once], k) for i, (c, k) in enumerate((("quote", pa.string()), ("only", pa.string()), ("there", pa.int32())))}})


def _relocated(quotes: list[dict], blocks: list[dict]) -> list[int | None]:
    """The number of the only block that has a quote, for each of ``quotes``; rows of one ``at`` count together."""
    finder = ahocorasick.Automaton()
    for q in {q["quote"] for q in quotes}:
        finder.add_word(q, q)
    finder.make_automaton()
    n: dict[str, int] = {}
    first: dict[str, int] = {}
    for b in blocks:
        for q in {q for _, q in finder.iter(b["text"])}:
            n[q] = n.get(q, 0) + 1
            first[q] = min(first.get(q, b["new_ord"]), b["new_ord"])
    found: dict[int, int] = {}
    for q in quotes:
        found[q["at"]] = found.get(q["at"], 0) + n.get(q["quote"], 0)
    place = {q["at"]: first[q["quote"]] for q in quotes if q["quote"] in first}
    return [place[q["at"]] if found[q["at"]] == 1 else None for q in quotes]


def relocated(quotes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, at, new_ord): quotes (doc_id, at, quote) go to the one block (doc_id, new_ord, text) of their document that has them.

    A document's quotes and blocks meet in one row, and each block is passed once.  Null documents have no blocks.
    """
    listed = lambda df, name: df.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "doc_id"])).alias(name))
    met = listed(quotes.where("quote <> ''"), "quotes").join(listed(blocks.where("text IS NOT NULL"), "blocks"), "doc_id", "left")
    kinds = dict(quotes.dtypes) | dict(blocks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                asked = rows.column(1).to_pylist()
                number = [i for i, q in enumerate(asked) for _ in q]
                at = [q["at"] for qs in asked for q in qs]
                new = [n for q, b in zip(asked, rows.column(2).to_pylist(), strict=True) for n in _relocated(q, b or [])]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(number, pa.int64())), pa.array(at, rows.schema.field(1).type.value_type.field("at").type), pa.array(new, pa.int32())], ["doc_id", "at", "new_ord"])

    return met.mapInArrow(run, f"doc_id {kinds['doc_id']}, at {kinds['at']}, new_ord int")


def moved_annotations(annotations: DataFrame, mapping: DataFrame, blocks: DataFrame) -> DataFrame:
    """Annotations (doc_id, note, block_id, start, stop, quote) in a new version (doc_id, block_id, text).

    A whole block (``start`` null) takes the new text as its quote.  A quote stays at its offsets if it is there, else goes to
    its nearest occurrence in the mapped block (the earlier of two), else to the only block of the document that has it.
    """
    to = mapping.select("doc_id", F.col("old").alias("block_id"), F.col("new").alias("target"))
    texts = blocks.select("doc_id", F.col("block_id").alias("target"), F.col("text").alias("body"))
    rows = annotations.join(to, ["doc_id", "block_id"], "left").join(texts, ["doc_id", "target"], "left").withColumn("body", F.coalesce("body", F.lit("")))
    whole, n = F.col("start").isNull(), F.length("quote")
    after = F.expr("locate(quote, body, start + 1)") - 1
    back = F.expr("locate(reverse(quote), reverse(body), greatest(length(body) - start - length(quote), 0) + 1)")
    before = F.when(back > 0, F.length("body") - n - back + 1)
    near = F.when((after < 0) | (F.col("start") - before <= after - F.col("start")), before).otherwise(after)
    same = F.substring(F.col("body"), F.col("start") + 1, F.col("stop") - F.col("start")) == F.col("quote")
    quoted = ~whole & F.col("target").isNotNull() & (F.col("quote") != "")
    at = F.when(quoted & same, F.col("start")).when(quoted & F.contains("body", "quote"), near)
    placed = rows.withColumn("at", at)
    lost = placed.where(~whole & F.col("at").isNull() & (F.col("quote") != "")).select("doc_id", "note", "quote")
    kinds = dict(annotations.dtypes)
    where = lost.groupBy("doc_id").cogroup(blocks.select("doc_id", "block_id", "text").groupBy("doc_id")).applyInArrow(_holders, f"doc_id {kinds['doc_id']}, quote string, only string, there int")
    unique = lost.join(where, ["doc_id", "quote"]).select("doc_id", "note", "only", "there")
    out = placed.join(unique, ["doc_id", "note"], "left").withColumn("at", F.coalesce("at", "there"))
    ok = (whole & F.col("target").isNotNull()) | F.col("at").isNotNull()
    return out.select(
        "doc_id", "note", F.coalesce("only", "target", "block_id").alias("block_id"), F.when(ok, F.col("at")).otherwise(F.col("start")).alias("start"), F.when(ok, F.col("at") + n).otherwise(F.col("stop")).alias("stop"),
        F.when(whole & F.col("target").isNotNull(), F.col("body")).otherwise(F.col("quote")).alias("quote"), F.when(ok, "ok").otherwise("stale").alias("status"),
    )
