"""Sections, groups, chunks, decoration, validation: operators over the block stream of each document.

Every window is partitioned by document, so a shuffle by doc_id serves all of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from doclake import constants as K
from doclake.functions import text as T
from doclake.functions.geometry import in_edge_zone


def in_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("ord")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def earlier() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def is_heading() -> Column:
    return F.col("type") == "heading"


def _last(value: str | Column, when: Column, over) -> Column:
    return F.last(F.when(when, value), ignorenulls=True).over(over)


def with_section(blocks: DataFrame) -> DataFrame:
    """Each block's section: the latest heading at or before it."""
    return blocks.withColumn("section", _last(F.col("ord"), is_heading(), so_far()))


def section_parents(blocks: DataFrame) -> DataFrame:
    """Headings with the latest earlier heading of a smaller level: one pass with the latest ordinal of each level."""
    heads = blocks.where(is_heading())
    levels = [_last(F.col("ord"), F.col("level") == n, earlier()) for n in range(1, K.MOST_LEVELS)]
    parent = F.when(F.col("level") == 2, levels[0])
    for n in range(3, K.MOST_LEVELS + 1):
        parent = parent.when(F.col("level") == n, F.greatest(*levels[: n - 1]))
    return heads.select("doc_id", "ord", "level", parent.alias("parent"))


def section_roots(parents: DataFrame) -> DataFrame:
    """The root of each section: levels fall along a chain, so it has at most ``MOST_LEVELS`` of them and joins climb it."""
    up = parents.select("doc_id", F.col("ord").alias("top"), F.col("parent").alias("above"))
    out = parents.select("doc_id", "ord", F.coalesce("parent", "ord").alias("top"))
    for _ in range(K.MOST_LEVELS - 2):
        out = out.join(up, ["doc_id", "top"], "left").select("doc_id", "ord", F.coalesce("above", "top").alias("top"))
    return out.select("doc_id", "ord", F.col("top").alias("root"))


def section_ranges(blocks: DataFrame) -> DataFrame:
    placed = with_section(blocks)
    return placed.groupBy("doc_id", "section").agg(F.min_by("block_id", "ord").alias("first_id"), F.max_by("block_id", "ord").alias("last_id"), F.count(F.lit(1)).alias("n_blocks"))


def islands(blocks: DataFrame) -> DataFrame:
    """Runs of consecutive blocks of one type, with their cost."""
    change = F.coalesce(F.col("type") != F.lag("type").over(in_order()), F.lit(True))
    runs = blocks.withColumn("new", change.cast("int")).withColumn("run", F.sum("new").over(so_far()))
    cost = T.approx_tokens(F.col("text")) + K.LINE_COST
    return runs.groupBy("doc_id", "run").agg(F.first("type").alias("type"), F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n_blocks"), F.sum(cost).alias("cost"))


def previous_paragraph(blocks: DataFrame) -> DataFrame:
    """For each paragraph, the ordinal of the nearest earlier paragraph or abstract not cut off by a heading."""
    before, heading = _last(F.col("ord"), F.col("type").isin("paragraph", "abstract"), earlier()), _last(F.col("ord"), is_heading(), earlier())
    return blocks.select("doc_id", "ord", "type", F.when(F.coalesce(heading, F.lit(-1)) < before, before).alias("previous")).where("type = 'paragraph'").drop("type")


def mark_references(blocks: DataFrame, word: str) -> DataFrame:
    """Paragraphs after a heading that contains ``word`` become reference entries, up to the next heading."""
    flag = _last(F.contains(F.lower("text"), F.lit(word)), is_heading(), so_far())
    return blocks.select("doc_id", "ord", F.when((F.col("type") == "paragraph") & F.coalesce(flag, F.lit(False)), "reference_entry").otherwise(F.col("type")).alias("type"))


def chunks(blocks: DataFrame, size: int = K.CHUNK_TOKENS, most: int = K.CHUNK_MAX) -> DataFrame:
    """Greedy packing of neighbouring blocks of a section, a fold over each document's blocks; blocks over ``most`` stand alone."""
    rows = with_section(blocks).where("type <> 'heading'").select("doc_id", "ord", F.coalesce("section", F.lit(-1)).alias("section"), T.approx_tokens(F.col("text")).alias("tokens"))
    by_doc = rows.groupBy("doc_id").applyInArrow(_packer(size, most), "doc_id long, chunk int, first_ord int, last_ord int, tokens long")
    return by_doc


def _packer(size: int, most: int) -> Callable[[pa.Table], pa.Table]:
    """Chunks of a document's blocks: a new one opens at another section or when the fill would exceed ``size``."""

    def run(doc: pa.Table) -> pa.Table:
        doc = doc.sort_by("ord")
        out, section, closed = [], None, True
        for o, s, n in zip(*(doc.column(c).to_pylist() for c in ("ord", "section", "tokens")), strict=True):
            if closed or s != section or n > most or out[-1][2] + n > size:
                out.append([o, o, 0])
            out[-1][1:] = [o, out[-1][2] + n]
            section, closed = s, n > most
        first, last, tokens = zip(*out, strict=True)
        return pa.table({"doc_id": pa.array([doc.column("doc_id")[0].as_py()] * len(out), pa.int64()), "chunk": pa.array(range(len(out)), pa.int32()), "first_ord": pa.array(first, pa.int32()), "last_ord": pa.array(last, pa.int32()), "tokens": pa.array(tokens, pa.int64())})

    return run


def tokens_of(text: str) -> int:
    """``approx_tokens`` of one text."""
    wide = sum("\u3000" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7af" for c in text)
    return wide + (len(text) - wide + 3) // 4


def _whole(sentences: list[str], i: int, j: int) -> str:
    return sentences[i] if j == i + 1 else " ".join(sentences[i:j]).strip()


def _reach(sentences: list[str], i: int, stop: int, size: int) -> int:
    """The end of the longest stretch from ``i`` that has at most ``size`` tokens as one text; one sentence at least."""
    far = 1
    while i + far < stop and tokens_of(_whole(sentences, i, i + far + 1)) <= size:
        far = min(2 * far, stop - i) if tokens_of(_whole(sentences, i, min(i + 2 * far, stop))) <= size else far + 1
    return i + far


def split_long(text: str, size: int, most: int) -> list[str]:
    """Stretches of sentences of up to ``size`` tokens each, measured as the text they make; a sentence over ``most`` is cut at equal steps of about that many."""
    sentences = [s for s in re.split(r"(?<=[.!?;])\s+|(?<=[。！？；])", text) if s.strip()]
    cost = [tokens_of(s) for s in sentences]
    walls = [i for i, n in enumerate(cost) if n > max(size, most)] + [len(sentences)]
    pieces, at = [], 0
    for wall in walls:
        while at < wall:
            end = _reach(sentences, at, wall, size)
            pieces.append(_whole(sentences, at, end))
            at = end
        if wall < len(sentences):
            long = sentences[wall]
            step = max(1, len(long) * size // cost[wall])
            pieces += [long[i : i + step] for i in range(0, len(long), step)]
        at = wall + 1
    return pieces


def _starts(sizes: np.ndarray, breaks: np.ndarray, size: int) -> np.ndarray:
    """Where chunks start: at every break, and where the running sum since the last start would pass ``size``."""
    upto = np.cumsum(sizes)
    next_break = np.append(np.flatnonzero(breaks), len(sizes))
    starts, at = [], 0
    while at < len(sizes):
        starts.append(at)
        full = int(np.searchsorted(upto, upto[at] - sizes[at] + size, "right"))
        at = min(max(full, at + 1), int(next_break[np.searchsorted(next_break, at, "right")]))
    return np.array(starts, np.int64)


def chunk_texts(blocks: DataFrame, size: int = K.CHUNK_TOKENS, most: int = K.CHUNK_MAX) -> DataFrame:
    """doc_id, chunk, ords, text of each chunk as it is embedded: its section's title, then its blocks; long blocks in pieces.

    A chunk ends where its section does, before and after a block of over ``most`` tokens, and where the next block would
    take it over ``size``.
    """
    placed = with_section(blocks)
    titles = placed.where(is_heading()).select("doc_id", F.col("ord").alias("section"), F.col("text").alias("title"))
    body = T.stripped(F.col("text"))
    rows = placed.where(~is_heading() & (body != "")).join(titles, ["doc_id", "section"], "left").select("doc_id", "ord", F.coalesce("section", F.lit(-1)).alias("section"), F.coalesce("title", F.lit("")).alias("title"), body.alias("body"), T.approx_tokens(body).alias("tokens"))

    def run(doc: pa.Table) -> pa.Table:
        doc = doc.sort_by("ord")
        sizes, section = (doc.column(c).to_numpy().astype(np.int64) for c in ("tokens", "section"))
        ords, titles_, bodies = (doc.column(c).to_pylist() for c in ("ord", "title", "body"))
        long = sizes > most
        breaks = np.append(True, (section[1:] != section[:-1]) | long[1:] | long[:-1])
        bounds = np.append(_starts(sizes, breaks, size), len(sizes)).tolist()
        made = [(ords[a:b], titles_[a], text) for a, b in pairwise(bounds) for text in (split_long(bodies[a], size, most) if long[a] else ["\n".join(bodies[a:b])])]
        texts = [f"{title}\n{text}" if title not in ("", text) else text for _, title, text in made]
        return pa.table({"doc_id": doc.column("doc_id")[:1].take(pa.array([0] * len(made), pa.int64())), "chunk": pa.array(range(len(made)), pa.int32()), "ords": pa.array([o for o, _, _ in made], pa.list_(pa.int32())), "text": pa.array(texts, pa.string())})

    return rows.groupBy("doc_id").applyInArrow(run, "doc_id long, chunk int, ords array<int>, text string")


def repeated_edges(anchored: DataFrame) -> DataFrame:
    """Texts in the margins of two or more pages of a document: page furniture."""
    edge = anchored.where(in_edge_zone(K.PAGE_WIDTH, K.PAGE_HEIGHT, K.EDGE_X, K.EDGE_Y)).withColumn("key", T.decoration_key(F.col("text")))
    return edge.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= K.DECORATION_PAGES)


def nearest_captions(anchored: DataFrame) -> DataFrame:
    """For each heading, the nearest paragraph of its page by vertical gap, then by order."""
    a = anchored.where(is_heading()).select("doc_id", "page", F.col("ord").alias("caption"), F.col("y0").alias("cy"))
    b = anchored.where("type = 'paragraph'").select("doc_id", "page", "ord", "y0")
    cost = F.abs(F.col("cy") - F.col("y0")) + 2 * F.abs(F.col("ord") - F.col("caption"))
    return a.join(b, ["doc_id", "page"]).groupBy("doc_id", "caption").agg(F.min_by("ord", F.struct(cost, "ord")).alias("target"))


def violations(blocks: DataFrame) -> DataFrame:
    """A row for each broken rule of a block, in one scan."""
    rules = {"empty": F.trim("text") == "", "long": F.length("text") > 2000, "unclosed": F.length(F.replace("text", F.lit("("), F.lit(""))) != F.length(F.replace("text", F.lit(")"), F.lit("")))}
    return blocks.select("doc_id", "block_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))
