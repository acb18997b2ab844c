"""What lies where on a page: tables from spanning cells, figures out of their parts."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake import constants as K
from doclake.sources.shared import saved

CELL = ["table_id", "row", "col", "row_end", "col_end", "header", "text"]
PAGE = ["doc_id", "page"]


# --- tables ---


def _html(cells: list[dict], rows: int, cols: int) -> str:
    """The grid of one table: reading row by row, a cell that starts where a shown one lies is left out, and covers nothing.

    Of cells that start at one place the last in ``text`` order counts.
    """
    begun: dict[tuple[int, int], dict] = {}
    order = lambda c: [(v is not None, v) for v in (c["text"], c["row_end"], c["col_end"])]
    for c in cells:
        at = c["row"], c["col"]
        if None not in at and (at not in begun or order(begun[at]) < order(c)):
            begun[at] = c
    shown: dict[tuple[int, int], str] = {}
    covered: set[tuple[int, int]] = set()
    for row, col in sorted(begun):
        if (row, col) in covered:
            continue
        c, tag = begun[row, col], "th" if begun[row, col]["header"] else "td"
        down, across = (max(1, c[k] - at) if c[k] is not None else 1 for k, at in (("row_end", row), ("col_end", col)))
        spans = "".join(f' {name}="{n}"' for name, n in (("rowspan", down), ("colspan", across)) if n > 1)
        shown[row, col] = f"<{tag}{spans}>{html.escape(c['text'] or '')}</{tag}>"
        if down * across > 1:
            covered.update((i, j) for i in range(row, row + down) for j in range(col, col + across))
    place = lambda at: shown.get(at) or ("" if at in covered else "<td></td>")
    return "<table>" + "".join("<tr>" + "".join(place((i, j)) for j in range(cols)) + "</tr>" for i in range(rows)) + "</table>"


def table_html(cells: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(table_id, html): the grid of each table; ``cells`` hold half-open spans, ``sizes`` (table_id, rows, cols) may widen it.

    Places that no cell covers become empty cells; those under a span are left out.
    The cells of a table move once, into one row, and nothing is written on the way.
    """
    cell = F.struct(*[F.col(c) for c in CELL[1:]])
    size = cells.groupBy("table_id").agg(F.max("row_end").cast("int").alias("rows"), F.max("col_end").cast("int").alias("cols"), F.collect_list(cell).alias("cells"))
    if sizes is not None:
        size = size.join(sizes.select("table_id", F.col("rows").alias("r"), F.col("cols").alias("c")), "table_id", "left").select("table_id", F.coalesce("r", "rows").cast("int").alias("rows"), F.coalesce("c", "cols").cast("int").alias("cols"), "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows, cols, held = (part.column(i).to_pylist() for i in (1, 2, 3))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(_html, held, rows, cols), pa.string())], ["table_id", "html"])

    return size.where("rows > 0 AND cols > 0").mapInArrow(run, f"table_id {dict(cells.dtypes)['table_id']}, html string")


# --- figures ---

# What the mark of a part of a figure, and the caption of a whole one, look like.
PART_MARK = r"^\s*[(\[]?([A-Za-z]|[ivx]{1,4})[)\]]?[.:]?\s*$"
FIGURE_CAPTION = r"(?i)^\s*((supplementary\s+|extended\s+data\s+)?fig(ure)?s?\.?|scheme|图)\s*S?[0-9]"
#: Side of the squares in which near boxes meet.
SQUARE = 64.0


def _square(v: Column) -> Column:
    return F.floor(v / SQUARE).cast("int")


def near_pairs(boxes: DataFrame, most: float) -> DataFrame:
    """(doc_id, page, a, b), a < b: boxes (ord, x0 to y1) of a page at most ``most`` apart on either axis.

    Each box is dealt to the squares it covers, the one side grown by ``most``, so only neighbours meet.
    """
    def dealt(grow: float, name: str) -> DataFrame:
        rows = boxes.select(*PAGE, F.col("ord").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("x0", "y0", "x1", "y1")])
        side = lambda axis: F.explode(F.sequence(_square(F.col(f"{name}_{axis}0") - grow), _square(F.col(f"{name}_{axis}1") + grow)))
        return rows.withColumn("sx", side("x")).withColumn("sy", side("y"))

    met = dealt(most, "a").join(dealt(0.0, "b"), [*PAGE, "sx", "sy"]).where("a < b")
    apart = lambda axis: F.greatest(F.lit(0.0), F.col(f"b_{axis}0") - F.col(f"a_{axis}1"), F.col(f"a_{axis}0") - F.col(f"b_{axis}1"))
    return met.where(F.greatest(apart("x"), apart("y")) <= most).select(*PAGE, "a", "b").distinct()


def groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, page, ord, grp): the least block that each of ``nodes`` is joined with through ``pairs``; a fold over one page's pairs."""

    def run(page: pa.Table) -> pa.Table:
        a, b = page.column("a").to_pylist(), page.column("b").to_pylist()
        least = {n: n for n in (*a, *b)}
        moved = True
        while moved:
            moved = False
            for x, y in zip(a, b, strict=True):
                low = min(least[x], least[y])
                moved |= least[x] != low or least[y] != low
                least[x] = least[y] = low
        n = len(least)
        return pa.table([page.column(c)[:1].take(pa.array([0] * n)) for c in PAGE] + [pa.array(least.keys(), kind), pa.array(least.values(), kind)], [*PAGE, "ord", "grp"])

    kind = pa.int32()
    ids = dict(nodes.dtypes)
    found = pairs.select(*PAGE, F.col("a").cast("int"), F.col("b").cast("int")).groupBy(*PAGE).applyInArrow(run, f"doc_id {ids['doc_id']}, page {ids['page']}, ord int, grp int")
    return nodes.select(*PAGE, "ord").join(found, [*PAGE, "ord"], "left").select(*PAGE, "ord", F.coalesce("grp", "ord").alias("grp"))


def merged_figures(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page, ord, type, text, x0 to y1) with figures that lie close together made one.

    Marks of parts, such as (a), go; they are captions anywhere, or other texts close to a figure.  Two figures or more
    that are joined over gaps of ``FIGURE_GAP`` become one if a figure caption begins within ten points above and forty
    below their lower edge, under half of the narrower width, and no text, table or formula has its middle within.  It
    stands before that caption (the highest of several); groups that share a caption are one figure.
    """
    rows = saved(blocks, "blocks")
    text = F.coalesce(F.col("text"), F.lit(""))
    figures = rows.where("type = 'figure'")
    marked = rows.where(text.rlike(PART_MARK) & F.col("type").isin("caption", "paragraph", "other", "heading"))
    loose = near_pairs(figures.unionByName(marked.where("type <> 'caption'")), K.FIGURE_GAP)
    kinds = rows.select(*PAGE, "ord", "type")
    one, two = (kinds.select(*PAGE, F.col("ord").alias(n), (F.col("type") == "figure").alias(f"{n}_figure")) for n in ("a", "b"))
    close = loose.join(one, [*PAGE, "a"]).join(two, [*PAGE, "b"]).where("a_figure <> b_figure").select(*PAGE, F.when(F.col("a_figure"), F.col("b")).otherwise(F.col("a")).alias("ord")).distinct()
    marks = saved(marked.where("type = 'caption'").select(*PAGE, "ord").unionByName(marked.where("type <> 'caption'").join(close, [*PAGE, "ord"], "left_semi").select(*PAGE, "ord")), "marks")
    nodes = figures.unionByName(rows.join(marks, [*PAGE, "ord"], "left_semi"))
    placed = nodes.join(groups(nodes, near_pairs(nodes, K.FIGURE_GAP)), [*PAGE, "ord"])
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    whole = placed.groupBy(*PAGE, "grp").agg(*box, F.count_if(F.col("type") == "figure").alias("figures"), F.min(F.when(F.col("type") == "figure", F.col("ord"))).alias("first")).where("figures > 1")
    rest = rows.join(marks, [*PAGE, "ord"], "left_anti")
    under = rest.where((F.col("type") == "caption") & text.rlike(FIGURE_CAPTION)).select(*PAGE, F.col("ord").alias("caption"), *[F.col(c).alias(f"c_{c}") for c in ("x0", "y0", "x1")])
    shared = F.least("x1", "c_x1") - F.greatest("x0", "c_x0")
    narrow = F.least(F.col("x1") - F.col("x0"), F.col("c_x1") - F.col("c_x0"))
    below = whole.join(under, PAGE).where((F.col("c_y0") >= F.col("y1") - 10) & (F.col("c_y0") <= F.col("y1") + 40) & (shared >= 0.5 * narrow))
    best = below.groupBy(*PAGE, "grp", "x0", "y0", "x1", "y1", "first").agg(F.min_by("caption", F.struct("c_y0", "caption")).alias("caption"))
    bodies = rest.where((F.col("type") != "figure") & ((F.length(text) >= 30) | F.col("type").isin("table", "equation"))).select(*PAGE, ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"))
    crossed = best.join(bodies, PAGE).where("x0 < mx AND mx < x1 AND y0 < my AND my < y1").select(*PAGE, "grp").distinct()
    taken = saved(best.join(crossed, [*PAGE, "grp"], "left_anti"), "merged")
    made = taken.groupBy(*PAGE, "caption").agg(*box, F.min("first").alias("first"))
    gone = placed.where("type = 'figure'").join(taken.select(*PAGE, "grp"), [*PAGE, "grp"], "left_semi").select(*PAGE, "ord").unionByName(marks)
    kept = rows.join(gone, [*PAGE, "ord"], "left_anti").select(*PAGE, "type", text.alias("text"), "x0", "y0", "x1", "y1", F.col("ord").cast("double").alias("at"))
    new = made.select(*PAGE, F.lit("figure").alias("type"), F.lit("").alias("text"), "x0", "y0", "x1", "y1", (F.col("caption") - 0.5).alias("at"))
    w = Window.partitionBy("doc_id").orderBy("page", "at")
    return kept.unionByName(new).withColumn("ord", F.row_number().over(w) - 1).drop("at")


# --- places ---


def located(points: DataFrame, boxes: DataFrame, most: float = 8.0) -> DataFrame:
    """(the columns of points, ord, gap): the box of its page that a point is in, or the nearest at most ``most`` away.

    ``points``: doc_id, page, x, y; ``boxes``: doc_id, page, ord, x0 to y1.  Of boxes around a point the smallest counts,
    then the first; of others the nearest, then the last.  A point without either has no row.
    """
    out = lambda v, low, high: F.greatest(F.lit(0.0), F.col(low) - F.col(v), F.col(v) - F.col(high))
    met = points.join(boxes.select(*PAGE, "ord", "x0", "y0", "x1", "y1"), PAGE).withColumns({"dx": out("x", "x0", "x1"), "dy": out("y", "y0", "y1")})
    gap = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    near = met.withColumn("gap", gap).where(F.col("gap") <= most)
    inside = F.col("gap") == 0
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    rank = F.struct((~inside).cast("int").alias("out"), F.when(inside, area).otherwise(F.col("gap")).alias("far"), F.when(inside, F.col("ord")).otherwise(-F.col("ord")).alias("turn"))
    return near.groupBy(*points.columns).agg(F.min_by(F.struct("ord", "gap"), rank).alias("m")).select(*points.columns, "m.ord", "m.gap")


def paired_captions(captions: DataFrame, bodies: DataFrame) -> DataFrame:
    """(doc_id, page, ord, target): the figure or table of its page that each caption belongs to.

    Nearest by the gap between them on the page and twice the places between them in reading order; another kind than
    the caption says (``says``: figure, table or null) costs a thousand.  The first of equals counts.
    """
    a = captions.select(*PAGE, "ord", "says", F.col("y0").alias("a0"), F.col("y1").alias("a1"))
    b = bodies.select(*PAGE, F.col("ord").alias("target"), "type", "y0", "y1")
    gap = F.greatest(F.lit(0.0), F.col("y0") - F.col("a1"), F.col("a0") - F.col("y1"))
    wrong = F.when(F.col("says") != F.col("type"), 1000.0).otherwise(0.0)
    cost = gap + 2 * F.abs(F.col("target") - F.col("ord")) + wrong
    return a.join(b, PAGE).groupBy(*PAGE, "ord").agg(F.min_by("target", F.struct(cost.alias("cost"), "target")).alias("target"))
