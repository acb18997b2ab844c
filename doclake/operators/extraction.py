"""Entities and relations from a model's replies: coerced, traced to blocks, verified, merged over a document.

Replies come by group (``doc_id``, ``grp``), as do the blocks they may cite.  All checks are joins on keys; only the merge,
whose result depends on the order, is a fold over the norms of a document's entities.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from doclake import constants as K
from doclake.functions import text as T
from doclake.functions import udfs
from doclake.operators.dictionary import Finder
from doclake.sources.shared import saved_large

REPLY = (
    "entities array<struct<id string, key string, type string, name string, aliases array<string>, description string, block_ids array<string>>>, "
    "relations array<struct<src string, dst string, type string, block_id string, block_ids array<string>, evidence string, confidence double, attrs map<string, string>>>"
)
GROUP = ["doc_id", "grp"]
ATTRS = ("metric", "unit", "dataset", "setting")


def _among(raw: Column, names: tuple[str, ...]) -> Column:
    """The name that ``raw`` means, whatever its case; null if none."""
    by_lower = F.create_map(*[F.lit(x) for n in names for x in (n.lower(), n)])
    return F.element_at(by_lower, F.lower(F.trim(raw)))


def _quoteless(text: Column, most: int) -> Column:
    return F.left(F.regexp_replace(T.collapse(F.coalesce(text, F.lit(""))), "^[\"'“”‘’ ]+|[\"'“”‘’ ]+$", ""), F.lit(most))


def _distinct(forms: Column) -> Column:
    """The first form of each norm, as many as are kept."""
    norms = F.transform(forms, lambda f: f["norm"])
    return F.slice(F.filter(forms, lambda f, i: F.array_position(F.slice(norms, 1, i + 1), f["norm"]) == i + 1), 1, K.MOST_ALIASES)


@pandas_udf(StringType())
def surface(names: pd.Series, texts: pd.Series) -> pd.Series:
    """The longest of some names that a text contains; of Latin letters, as a word of its own."""
    found = (Finder((a for a in n if len(a) > 1), plural=False).of(t) for n, t in zip(names, texts, strict=True))
    return pd.Series([next(iter(f), None) for f in found])


def entities(replies: DataFrame) -> DataFrame:
    """doc_id, grp, pos, type, name, aliases, ids, ...: every item of the replies; ``ok`` if its type and name are known."""
    items = replies.select(*GROUP, F.from_json("reply", REPLY).alias("r")).select(*GROUP, F.posexplode("r.entities").alias("pos", "e"))
    names = F.concat(F.array(F.left(F.col("e.name"), F.lit(K.MOST_NAME))), F.coalesce("e.aliases", F.array().cast("array<string>")))
    named = items.withColumn("every", udfs.name_forms(names)).withColumn("forms", _distinct(F.col("every"))).drop("every").withColumn("type", _among(F.col("e.type"), K.ENTITY_TYPES))
    name = F.col("forms")[0]["alias"]
    usable = F.col("type").isNotNull() & (F.size("forms") > 0) & F.col("e.name").rlike("[\\p{L}\\p{N}]")
    return named.select(*GROUP, "pos", "type", name.alias("name"), F.coalesce(F.nullif("e.id", F.lit("")), F.nullif("e.key", F.lit("")), name).alias("key"), "forms", _quoteless(F.col("e.description"), K.MOST_DESCRIPTION).alias("description"), T.normal_ids(F.array_join(F.coalesce("e.block_ids", F.array().cast("array<string>")), ",")).alias("claimed"), F.coalesce(usable, F.lit(False)).alias("ok"))


def mentions(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, grp, pos, block_id, surface: blocks that contain an alias, and those that the model names.

    A Latin alias is looked for only in blocks that have one of its words; the others, without words, in all of the group.
    """
    names = F.transform("forms", lambda f: f["alias"])
    forms = found.select(*GROUP, "pos", F.explode(names).alias("alias")).where(F.length("alias") > 1)
    word = F.regexp_extract(F.lower("alias"), "([a-z0-9]+)", 1)
    latin = F.col("alias").rlike("^[\\w\\s\\-./+()'’]+$") & (word != "")
    words = blocks.select(*GROUP, "block_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1))).alias("word"))
    near = forms.where(latin).withColumn("word", word).join(words, [*GROUP, "word"]).select(*GROUP, "pos", "block_id")
    other = forms.where(~latin).join(blocks.select(*GROUP, "block_id", "text"), GROUP).where(F.contains(F.lower(F.regexp_replace("text", "\\s+", "")), F.lower(F.regexp_replace("alias", "\\s+", "")))).select(*GROUP, "pos", "block_id")
    pairs = near.unionByName(other).distinct().join(blocks.select(*GROUP, "block_id", "text"), [*GROUP, "block_id"]).join(found.select(*GROUP, "pos", names.alias("names")), [*GROUP, "pos"])
    seen = pairs.select(*GROUP, "pos", "block_id", surface("names", "text").alias("surface")).where("surface is not null")
    claimed = found.select(*GROUP, "pos", "name", F.explode("claimed").alias("block_id")).join(blocks.select(*GROUP, "block_id"), [*GROUP, "block_id"]).select(*GROUP, "pos", "block_id", F.col("name").alias("surface"))
    return _first(seen, claimed)


def _first(*sources: DataFrame) -> DataFrame:
    """Of the surfaces of an entity in a block, that of the first source."""
    rows = [s.withColumn("rank", F.lit(i)) for i, s in enumerate(sources)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy(*GROUP, "pos", "block_id").agg(F.min_by("surface", F.struct("rank", "surface")).alias("surface"))


def relations(replies: DataFrame, found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every relation of the replies with its ends, block, confidence and ``fault``: bad_relations, no_source, unverified_values or null."""
    items = replies.select(*GROUP, F.from_json("reply", REPLY).alias("r")).select(*GROUP, F.posexplode("r.relations").alias("rel", "x"))
    # an end is the last entity with that key, else the first with that name
    keys = found.select(*GROUP, F.col("key").alias("k"), "pos", F.lit(0).alias("kind"), (-F.col("pos")).alias("turn")).unionByName(found.select(*GROUP, F.col("name").alias("k"), "pos", F.lit(1).alias("kind"), F.col("pos").alias("turn")))
    ends = keys.groupBy(*GROUP, "k").agg(F.min_by("pos", F.struct("kind", "turn")).alias("pos"))
    ids = T.normal_ids(F.coalesce(F.nullif("x.block_id", F.lit("")), F.array_join("x.block_ids", ","), F.lit("")))
    cited = items.select(*GROUP, "rel", F.posexplode(ids).alias("n", "block_id")).join(blocks.select(*GROUP, "block_id", "text"), [*GROUP, "block_id"])
    source = cited.groupBy(*GROUP, "rel").agg(F.min_by(F.struct("block_id", "text"), "n").alias("s"))
    src, dst = (ends.select(*GROUP, F.col("k").alias(f"{e}_key"), F.col("pos").alias(e)) for e in ("src", "dst"))
    rows = items.withColumns({"src_key": F.col("x.src"), "dst_key": F.col("x.dst")}).join(src, [*GROUP, "src_key"], "left").join(dst, [*GROUP, "dst_key"], "left").join(source, [*GROUP, "rel"], "left")
    named = rows.withColumns({"type": _among(F.regexp_replace(F.trim("x.type"), "[ -]", "_"), K.RELATION_TYPES), "evidence": _quoteless(F.col("x.evidence"), K.MOST_EVIDENCE)})
    stated = T.collapse(F.coalesce(F.element_at("x.attrs", F.lit("value")), F.lit("")))
    stated = F.regexp_replace(stated, "^[\"'“”‘’ ]+|[\"'“”‘’ ]+$", "")
    first = F.regexp_extract(stated, f"({T.NUMBER})", 1)
    shown = F.when(F.length(stated) <= K.MOST_VALUE, stated).otherwise(first)
    number = named.withColumns({"quoted": udfs.quoted("evidence", "s.text"), "number": T.number_value(first), "shown": shown})
    there = T.has_value(F.col("number"), F.col("s.text"))
    seen = number.withColumn("c", F.struct("quoted", F.when(there, F.col("number")).alias("value"), F.when(there, F.col("shown")).alias("value_text")))
    bad = F.col("type").isNull() | F.col("src").isNull() | F.col("dst").isNull() | (F.col("src") == F.col("dst"))
    valued = F.col("type") == "achieves"
    fault = F.when(bad, "bad_relations").when(F.col("s").isNull(), "no_source").when(valued & F.col("c.value").isNull(), "unverified_values")
    unsupported = (F.col("evidence") != "") & ~F.col("c.quoted")
    sure = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x.confidence"))), F.lit(K.CONFIDENCE))
    attrs = [F.when(valued, F.nullif(_quoteless(F.element_at("x.attrs", F.lit(a)), K.MOST_NAME), F.lit(""))).alias(a) for a in ATTRS]
    return seen.select(
        *GROUP, "rel", "src", "dst", "type", F.col("s.block_id").alias("block_id"), F.when(unsupported, "").otherwise(F.col("evidence")).alias("evidence"), F.round(sure * F.when(unsupported, K.UNSUPPORTED).otherwise(1.0), 3).alias("confidence"),
        F.when(valued, F.col("c.value")).alias("value"), F.when(valued, F.col("c.value_text")).alias("value_text"), *attrs, fault.alias("fault"), (unsupported & F.coalesce(~fault.isin("bad_relations", "no_source"), F.lit(True))).alias("unsupported"),
    )


def _same(doc: pa.Table) -> pa.Table:
    """The document's entity that each entity of a group is: the first of its type that has one of its norms so far."""
    index: dict[tuple[str, str], int] = {}
    norms: list[list[str]] = []
    out: list[int] = []
    doc = doc.sort_by([("grp", "ascending"), ("pos", "ascending")])
    for kind, own in zip(doc.column("type").to_pylist(), doc.column("norms").to_pylist(), strict=True):
        at = next((index[kind, n] for n in own if (kind, n) in index), len(norms))
        if at == len(norms):
            norms.append([])
        norms[at] = list(dict.fromkeys(norms[at] + own))[: K.MOST_ALIASES]
        for n in norms[at]:
            index.setdefault((kind, n), at)
        out.append(at)
    return doc.select(["doc_id", "grp", "pos"]).append_column("entity", pa.array(out, pa.int32()))


def document_graph(replies: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and counts of what was dropped, of each document.

    Entities: doc_id, entity, type, name, aliases, description, block_ids; relations: doc_id, src, dst, type, block_id, ...
    What several branches read is written once (replies, blocks, entities, relations, mentions, who is who), so that no
    branch works it out anew.  Entities without any source are dropped.  Of relations that agree in ends, type and block, the most confident stays.
    """
    replies, blocks = saved_large(replies, "replies"), saved_large(blocks, "blocks")
    items = saved_large(entities(replies), "entities")
    found = items.where("ok")
    checked = saved_large(relations(replies, found, blocks), "relations")
    good = checked.where("fault is null")
    ends = good.select(*GROUP, "block_id", F.explode(F.array("src", "dst")).alias("pos")).distinct()
    linked = ends.join(found.select(*GROUP, "pos", "name"), [*GROUP, "pos"]).select(*GROUP, "pos", "block_id", F.col("name").alias("surface"))
    shown = saved_large(_first(mentions(found, blocks), linked), "mentions")
    sourced = found.join(shown.select(*GROUP, "pos").distinct(), [*GROUP, "pos"], "left_semi")
    kinds = dict(found.dtypes)
    keys = sourced.select(*GROUP, "pos", "type", F.transform("forms", lambda f: f["norm"]).alias("norms"))
    same = saved_large(keys.groupBy("doc_id").applyInArrow(_same, f"doc_id {kinds['doc_id']}, grp {kinds['grp']}, pos int, entity int"), "same")
    placed = sourced.join(same, [*GROUP, "pos"])
    first = F.struct("grp", "pos")
    forms = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("grp", "pos", "forms"))), lambda x: x["forms"]))
    merged = placed.groupBy("doc_id", "entity").agg(F.first("type").alias("type"), F.min_by("name", first).alias("name"), forms.alias("forms"), F.coalesce(F.min_by("description", F.when(F.col("description") != "", first)), F.lit("")).alias("description"))
    norms = F.array_distinct(F.transform("forms", lambda f: f["norm"]))
    aliases = F.slice(F.transform(norms, lambda n: F.filter("forms", lambda f: f["norm"] == n)[0]["alias"]), 1, K.MOST_ALIASES)
    where = shown.join(same, [*GROUP, "pos"]).groupBy("doc_id", "entity").agg(F.array_sort(F.collect_set("block_id")).alias("block_ids"))
    nodes = merged.select("doc_id", "entity", "type", "name", aliases.alias("aliases"), "description").join(where.hint("merge"), ["doc_id", "entity"])

    src, dst = (same.select(*GROUP, F.col("pos").alias(e), F.col("entity").alias(f"{e}_entity")) for e in ("src", "dst"))
    moved = good.join(src, [*GROUP, "src"]).join(dst, [*GROUP, "dst"]).withColumns({"src": F.col("src_entity"), "dst": F.col("dst_entity")}).where("src <> dst").drop("src_entity", "dst_entity")
    w = Window.partitionBy("doc_id", "src", "dst", "type", "block_id").orderBy(F.desc("confidence"), "grp", "rel")
    edges = moved.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("doc_id", "src", "dst", "type", "block_id", "evidence", "confidence", "value", "value_text", *ATTRS)

    faults = checked.select("doc_id", F.explode(F.filter(F.array("fault", F.when(F.col("unsupported"), F.lit("unsupported_evidence"))), lambda x: x.isNotNull())).alias("fault"))
    lost = items.join(sourced.select(*GROUP, "pos"), [*GROUP, "pos"], "left_anti").select("doc_id", F.lit("bad_entities").alias("fault"))
    return nodes, edges, faults.unionByName(lost).groupBy("doc_id", "fault").agg(F.count(F.lit(1)).alias("n"))


def pruned(nodes: DataFrame, edges: DataFrame, most: int = K.KG_MAX, concepts: int = K.KG_CONCEPTS) -> tuple[DataFrame, DataFrame]:
    """Of each document, the best entities that are linked or named by two blocks, few of them concepts; edges between them."""
    degree = edges.select("doc_id", F.explode(F.array("src", "dst")).alias("entity")).groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("degree"))
    scored = nodes.join(degree, ["doc_id", "entity"], "left").withColumn("score", 2 * F.coalesce("degree", F.lit(0)) + F.size("block_ids")).where((F.col("degree") > 0) | (F.size("block_ids") > 1))
    best = [F.desc("score"), "entity"]
    few = scored.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", F.col("type") == "Concept").orderBy(*best))).where((F.col("type") != "Concept") | (F.col("nth") <= concepts))
    kept = few.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(*best))).where(F.col("rank") <= most).drop("nth", "rank", "degree")
    src, dst = (kept.select("doc_id", F.col("entity").alias(e)) for e in ("src", "dst"))
    return kept, edges.join(src, ["doc_id", "src"], "left_semi").join(dst, ["doc_id", "dst"], "left_semi")
