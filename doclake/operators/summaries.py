"""Sections and points of a model's summary, whatever shape it gave them.

Replies are VARIANT values, and each shape is an expression over them that yields the same list of parts: a list of
sections, sections by key, one section alone, and sections mixed into another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.functions import text as T
from doclake.functions import udfs

PART = "array<struct<key: string, name: string, points: array<variant>>>"
# Fixed value: what is left of a text that is only block ids.
NO_WORDS = "[ ,，、;；\\[\\]【】()（）]+"


def _list(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _objects(v: Column) -> Column:
    """A list whose entries are all objects; null if it is none."""
    found = _list(v)
    return F.when(F.forall(found, lambda x: F.schema_of_variant(x).startswith("OBJECT")), found)


def _part(key: Column, name: Column, points: Column) -> Column:
    return F.struct(key.cast("string").alias("key"), name.cast("string").alias("name"), points.alias("points"))


def _entries(v: Column) -> Column:
    return F.map_entries(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))


def _flat(v: Column, known: list[str]) -> Column:
    """One object: the section that it is, and those that it holds under a known key or name."""
    text = lambda path: F.try_variant_get(v, path, "string")
    own = F.try_variant_get(v, "$.points", "variant")
    itself = F.filter(F.array(_part(text("$.key"), text("$.name"), _objects(own))), lambda p: p["points"].isNotNull())
    inner = F.filter(F.transform(_entries(v), lambda e: _part(e["key"], F.lit(None), _objects(e["value"]))), lambda p: p["key"].isin(known) & p["points"].isNotNull())
    return F.concat(itself, inner)


def parts(reply: Column, known: list[str]) -> Column:
    """The parts (key, name, points) of a reply, in order; the sections of one object by key."""
    sections = F.try_variant_get(reply, "$.sections", "variant")
    listed = F.flatten(F.transform(F.filter(_list(sections), lambda s: F.schema_of_variant(s).startswith("OBJECT")), lambda s: _flat(s, known)))
    by_key = F.filter(F.transform(_entries(sections), lambda e: _part(e["key"], F.lit(None), _objects(e["value"]))), lambda p: p["points"].isNotNull())
    return F.when(_list(sections).isNotNull(), listed).when(F.try_variant_get(sections, "$", "map<string,variant>").isNotNull(), by_key).otherwise(_flat(reply, known))


def section_points(replies: DataFrame, template: list[tuple[str, str]], blocks: DataFrame) -> DataFrame:
    """(doc_id, section, place, text, block_ids, untraced, invalid): the points of each section of ``template`` (key, name).

    ``replies``: doc_id, reply (text, with talk around it or cut off); ``blocks``: doc_id, block_id.  A part's section is
    its key, else the section of that name, else the one of its name, else the one at its place; of several parts the
    first counts.  A point's block ids stand in it or in its text, which loses them; those without a block are counted
    as ``invalid``.  Points of nothing but ids are left out.
    """
    keys, names = [k for k, _ in template], [n for _, n in template]
    rows = replies.withColumn("json", udfs.json_object("reply")).withColumn("v", F.try_parse_json("json"))
    placed = rows.select("doc_id", F.posexplode(parts(F.col("v"), [*keys, *names])).alias("at", "p"))
    by_name = F.create_map(*[F.lit(x) for k, n in reversed(template) for x in (n, k)]) if template else F.create_map().cast("map<string,string>")
    by_place = F.get(F.array(*map(F.lit, keys)), F.col("at"))
    section = F.coalesce(F.when(F.col("p.key").isin(keys), F.col("p.key")), F.element_at(by_name, F.coalesce("p.key", F.lit(""))), F.element_at(by_name, F.coalesce("p.name", F.lit(""))), by_place)
    first = placed.withColumn("section", section).where("section IS NOT NULL").groupBy("doc_id", "section").agg(F.min_by("p.points", "at").alias("points"))
    points = first.select("doc_id", "section", F.posexplode("points").alias("place", "x"))
    said = lambda path: F.nullif(F.try_variant_get("x", path, "string"), F.lit(""))
    raw = points.withColumn("raw", F.coalesce(said("$.text"), said("$.point"), F.lit("")))
    inline = F.array_join(F.regexp_extract_all("raw", F.lit(f"({T.INLINE_IDS})"), 1), " ")
    listed = F.coalesce(said("$.block_ids"), said("$.citations"), F.lit(""))
    clean = raw.withColumns({"text": T.stripped(F.regexp_replace("raw", T.INLINE_IDS, "")), "ids": T.normal_ids(F.concat(listed, F.lit(" "), inline))})
    worded = clean.where(F.regexp_replace(F.regexp_replace("text", "(?i)(d_[0-9a-f]+#)?b[_-]?[0-9]+", ""), NO_WORDS, "") != "").select("doc_id", "section", "place", "text", "ids")
    asked = worded.select("doc_id", "section", "place", F.posexplode_outer("ids").alias("n", "block_id"))
    there = asked.join(blocks.select("doc_id", "block_id", F.lit(True).alias("there")).distinct(), ["doc_id", "block_id"], "left")
    found = there.groupBy("doc_id", "section", "place").agg(F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("n", "block_id")))).alias("f"), F.count_if(F.col("there").isNull() & F.col("block_id").isNotNull()).alias("invalid"))
    order = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("place")) - 1
    out = worded.join(found, ["doc_id", "section", "place"]).withColumn("block_ids", F.transform("f", lambda x: x["block_id"]))
    return out.select("doc_id", "section", order.alias("place"), "text", "block_ids", (F.size("block_ids") == 0).alias("untraced"), "invalid")
