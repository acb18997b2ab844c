"""Parsed layouts whose JSON is a tree of references: collections of items that name their children by ``$ref``.

Items are exploded from their collections and joined by reference; the tree is walked a level at a time, with the path of
places from the body as key, so that sorting by path is the reading order.  An item that several paths reach counts at
the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclake.operators.layout import table_html
from doclake.sources.shared import saved

REF = "array<struct<`$ref`: string>>"
PROV = "array<struct<page_no: int, bbox: struct<l: double, t: double, r: double, b: double, coord_origin: string>>>"
CELLS = "struct<num_rows: int, num_cols: int, table_cells: array<struct<start_row_offset_idx: int, end_row_offset_idx: int, start_col_offset_idx: int, end_col_offset_idx: int, column_header: boolean, text: string>>>"
ITEM = f"array<struct<label: string, content_layer: string, text: string, orig: string, level: int, marker: string, prov: {PROV}, children: {REF}, captions: {REF}, footnotes: {REF}, data: {CELLS}>>"
SCHEMA = f"doc_id string, pages map<string, struct<size: struct<width: double, height: double>>>, body struct<children: {REF}>, texts {ITEM}, groups {ITEM}, pictures {ITEM}, tables {ITEM}"
KINDS = ("texts", "groups", "pictures", "tables")
# What the labels of texts are called here, and which are no content.
LABELS = {"title": "title", "section_header": "heading", "text": "paragraph", "paragraph": "paragraph", "list_item": "list_item", "caption": "caption", "formula": "equation", "footnote": "footnote", "code": "code", "reference": "reference_entry", "document_index": "other", "checkbox_selected": "other", "checkbox_unselected": "other"}
DROPPED = ("page_header", "page_footer")


def _items(docs: DataFrame) -> DataFrame:
    """(doc_id, ref, kind, item) of all collections."""
    rows = None
    for kind in KINDS:
        one = docs.select("doc_id", F.posexplode(kind).alias("i", "item")).select("doc_id", F.concat(F.lit(f"#/{kind}/"), F.col("i").cast("string")).alias("ref"), F.lit(kind).alias("kind"), "item")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _below(items: DataFrame) -> DataFrame:
    """(doc_id, parent, place, ref, how): what each item leads to, in order; ``how`` is shown, note (of a table) or hidden.

    Pictures and tables lead to their captions and notes and hide their children, an inline group hides its children.
    """
    refs = lambda column, how: F.transform(F.coalesce(f"item.{column}", F.array().cast(REF)), lambda r: F.struct(r["$ref"].alias("ref"), F.lit(how).alias("how")))
    framed = F.concat(refs("captions", "shown"), F.when(F.col("kind") == "tables", refs("footnotes", "note")).otherwise(refs("footnotes", "shown")), refs("children", "hidden"))
    inline = (F.col("kind") == "groups") & (F.col("item.label") == "inline")
    skipped = (F.col("item.content_layer") == "furniture") | ((F.col("kind") == "texts") & F.col("item.label").isin(*DROPPED))
    led = F.when(F.coalesce(skipped, F.lit(False)), F.slice(framed, 1, 0)).when(F.col("kind").isin("pictures", "tables"), framed).when(F.coalesce(inline, F.lit(False)), refs("children", "hidden")).otherwise(refs("children", "shown"))
    return items.select("doc_id", F.col("ref").alias("parent"), F.posexplode(led).alias("place", "x")).select("doc_id", "parent", "place", "x.ref", "x.how")


def reading_order(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, ref, how, path) of every item that the body leads to, at its first path."""
    edges = saved(_below(items), "edges")
    level = saved(docs.select("doc_id", F.posexplode("body.children").alias("place", "x")).select("doc_id", F.col("x.$ref").alias("ref"), F.lit("shown").alias("how"), F.array("place").alias("path"), F.array(F.col("x.$ref")).alias("seen")), "level")
    out = level
    while True:
        open_ = level.where("how = 'shown'").select("doc_id", F.col("ref").alias("parent"), "path", "seen")
        step = open_.join(edges, ["doc_id", "parent"]).where(~F.array_contains("seen", F.col("ref")))
        level = saved(step.select("doc_id", "ref", "how", F.concat("path", F.array("place")).alias("path"), F.concat("seen", F.array("ref")).alias("seen")), "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.groupBy("doc_id", "ref").agg(F.min(F.struct("path", "how")).alias("m")).select("doc_id", "ref", "m.how", "m.path")


def _boxes(prov: Column, heights: Column) -> Column:
    """(page, x0, y0, x1, y1) of each place of an item: pages from 0, y downwards."""

    def box(p: Column) -> Column:
        b, h = p["bbox"], F.coalesce(F.element_at(heights, p["page_no"].cast("string")), F.lit(0.0))
        up = F.coalesce(b["coord_origin"], F.lit("BOTTOMLEFT")) == "BOTTOMLEFT"
        flip = lambda v: F.when(up, h - v).otherwise(v)
        return F.struct((p["page_no"] - 1).alias("page"), b["l"].alias("x0"), flip(b["t"]).alias("y0"), b["r"].alias("x1"), flip(b["b"]).alias("y1"))

    return F.transform(F.coalesce(prov, F.array().cast(PROV)), box)


def ref_layouts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ord, type, page, x0 to y1, text, level, marker, html, anchors: the blocks of each document in reading order.

    An inline group is one paragraph of its texts and formulas, which stand between dollar signs, in the box of those of
    its first page.  Items without a place, page headers and furniture are left out; an item's first place is its own.
    """
    docs = saved(spark.read.schema(SCHEMA).json(path, multiLine=True), "layouts")
    items = saved(_items(docs), "items")
    heights = docs.select("doc_id", F.transform_values("pages", lambda _, v: v["size"]["height"]).alias("heights"))
    placed = reading_order(docs, items).join(items, ["doc_id", "ref"]).join(heights, "doc_id")
    found = placed.where((F.col("how") != "hidden") & ~F.coalesce(F.col("item.content_layer") == "furniture", F.lit(False)))
    label = F.col("item.label")
    named = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, v)])
    kind = F.when(F.col("how") == "note", "footnote").when(F.col("kind") == "pictures", "figure").when(F.col("kind") == "tables", "table").otherwise(F.coalesce(F.element_at(named, label), F.when(F.col("kind") == "texts", "paragraph").otherwise("other")))
    single = found.where("kind <> 'groups'").where(F.coalesce((F.col("kind") != "texts") | ~label.isin(*DROPPED) | (F.col("how") == "note"), F.lit(True)))
    level = F.when(kind == "heading", F.col("item.level"))
    blocks = single.select("doc_id", "path", "ref", kind.alias("type"), F.coalesce("item.text", F.lit("")).alias("text"), level.alias("level"), "item.marker", _boxes(F.col("item.prov"), F.col("heights")).alias("anchors"))

    cells = single.where("kind = 'tables'").select(F.concat("doc_id", F.lit("␞"), "ref").alias("table_id"), "item.data.num_rows", "item.data.num_cols", F.explode("item.data.table_cells").alias("c"))
    grid = cells.select("table_id", F.col("c.start_row_offset_idx").alias("row"), F.col("c.start_col_offset_idx").alias("col"), F.col("c.end_row_offset_idx").alias("row_end"), F.col("c.end_col_offset_idx").alias("col_end"), F.coalesce("c.column_header", F.lit(False)).alias("header"), "c.text")
    sizes = cells.groupBy("table_id").agg(F.max(F.nullif("num_rows", F.lit(0))).alias("rows"), F.max(F.nullif("num_cols", F.lit(0))).alias("cols"))
    html = table_html(grid, sizes).select(F.split("table_id", "␞")[0].alias("doc_id"), F.split("table_id", "␞")[1].alias("ref"), "html")

    inline = found.where((F.col("kind") == "groups") & (label == "inline")).select("doc_id", "path", "heights", F.posexplode("item.children").alias("n", "c"))
    inner = inline.select("doc_id", "path", "heights", "n", F.col("c.$ref").alias("ref")).join(items.select("doc_id", "ref", "item"), ["doc_id", "ref"])
    said = F.when(F.col("item.label") == "formula", F.concat(F.lit("$"), F.coalesce(F.nullif("item.text", F.lit("")), "item.orig", F.lit("")), F.lit("$"))).otherwise(F.coalesce("item.text", F.lit("")))
    lines = inner.groupBy("doc_id", "path").agg(F.array_sort(F.collect_list(F.struct("n", said.alias("said"), _boxes(F.col("item.prov"), F.col("heights")).alias("boxes")))).alias("x"))
    boxes = F.flatten(F.transform("x", lambda x: x["boxes"]))
    whole = lines.select("doc_id", "path", F.trim(F.regexp_replace(F.array_join(F.transform("x", lambda x: x["said"]), " "), "\\s+", " ")).alias("text"), boxes.alias("every")).where(F.size("every") > 0)
    first = F.filter("every", lambda b: b["page"] == F.col("every")[0]["page"])
    side = lambda f, n: f(F.transform("own", lambda b: b[n]))
    paragraphs = whole.withColumn("own", first).select("doc_id", "path", F.lit(None).cast("string").alias("ref"), F.lit("paragraph").alias("type"), "text", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("marker"), F.array(F.struct(F.col("own")[0]["page"].alias("page"), side(F.array_min, "x0").alias("x0"), side(F.array_min, "y0").alias("y0"), side(F.array_max, "x1").alias("x1"), side(F.array_max, "y1").alias("y1"))).alias("anchors"))

    every = blocks.unionByName(paragraphs).where(F.size("anchors") > 0).join(html, ["doc_id", "ref"], "left")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    return every.select("doc_id", order.alias("ord"), "type", "anchors", *[F.col("anchors")[0][c].alias(c) for c in ("page", "x0", "y0", "x1", "y1")], "text", "level", "marker", "html")
