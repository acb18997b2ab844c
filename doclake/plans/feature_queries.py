"""Queries of the stored index, the dictionary, whole mappings and layouts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import constants as K
from doclake.functions import text as T
from doclake.operators import dictionary as D
from doclake.operators import evaluation as E
from doclake.operators import fulltext as X
from doclake.operators import layout as L
from doclake.operators import lineage as N
from doclake.operators import offsets as O
from doclake.operators import trees as Q
from doclake.operators.summaries import section_points
from doclake.plans.queries import QUERIES, _blocks, query
from doclake.sources import tables as S
from doclake.sources.shared import shared_dir

# --- the stored index ---


def _index(spark, d) -> X.Index:
    index = X.Index(f"{shared_dir(spark)}/doclake-{uuid.uuid4().hex}/index")
    X.build(index, _blocks(spark, d))
    return index


@query
def search_index(spark, d):
    """The rows of ``search_bm25``, from an index of the documents."""
    return X.best(X.search(spark, _index(spark, d), ["ing", "tion"])).drop("ord")


@query
def search_index_phrase(spark, d):
    """Every block with a longer run of letters, blanks among them; the postings of a dozen grams meet."""
    return X.search(spark, _index(spark, d), ["of the", "ering"]).drop("ord")


@query
def search_index_replaced(spark, d):
    """The same after the documents of one source have got their new version and those of another have gone."""
    index, docs = _index(spark, d), S.table(spark, d, "documents")
    fresh = S.new_version(_blocks(spark, d)).join(docs.where("source = 'src1'").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("new_ord").alias("ord"), F.col("new_id").alias("block_id"), "text")
    X.replace(index, fresh, docs.where("source IN ('src1', 'src2')").select("doc_id"))
    return X.best(X.search(spark, index, ["ing", "tion"])).drop("ord")


# --- the dictionary ---


def _words(text: Column, n: int) -> Column:
    """The first words of a text, without what ends a sentence."""
    return F.trim(F.regexp_replace(F.array_join(F.slice(F.split(text, " "), 1, n), " "), "[.,;:!?\\n]+", ""))


def _terms(spark, d) -> DataFrame:
    parts = S.table(spark, d, "part").select(F.col("p_name").alias("term"))
    heads = S.table(spark, d, "benchmark").select(F.explode(F.array(_words(F.col("text"), 1), _words(F.col("text"), 2))).alias("term"))
    return parts.unionByName(heads).where("term <> ''").distinct()


@query
def dictionary_terms(spark, d):
    """The documents that use names of parts or the first words of benchmark texts."""
    return D.uses(S.table(spark, d, "documents").select("doc_id", "text"), _terms(spark, d), keep_text=False)


@query
def dictionary_terms_joined(spark, d):
    """The same through the join that any number of terms can take."""
    return D.uses(S.table(spark, d, "documents").select("doc_id", "text"), _terms(spark, d), most_terms=0, keep_text=False)


@query
def glossary_blocks(spark, d):
    """The glossary entries for each block: first words of benchmark texts for all, a document's own first word for itself."""
    heads = S.table(spark, d, "benchmark").select(F.lit(None).cast("long").alias("doc_id"), _words(F.col("text"), 1).alias("term")).where("term <> ''").distinct()
    own = S.table(spark, d, "documents").select("doc_id", _words(F.col("text"), 1).alias("term")).where("term <> ''")
    entries = heads.withColumn("target", T.upper_by_letter(F.col("term"))).unionByName(own.withColumn("target", F.concat("term", F.lit("!"))))
    found = D.glossary(_blocks(spark, d).select("doc_id", "block_id", "text"), entries, K.BLOCK_TERMS)
    return found.groupBy("doc_id", "block_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term", "target"))), lambda x: F.concat(x["term"], F.lit("="), x["target"])), ";")).alias("digest"))


# --- a whole mapping ---


@query
def map_blocks_fuzzy(spark, d):
    """Where each block of a document is in its new version: by equal text, else on the same page by place and likeness."""
    old = S.anchors(_blocks(spark, d)).withColumn("id", F.col("block_id"))
    new = S.anchors(S.new_version(_blocks(spark, d)).withColumn("ord", F.col("new_ord"))).withColumn("id", F.col("new_id"))
    return N.mapped(old, new)


# --- layouts and places ---


@query
def table_grid(spark, d):
    """The lines of an order as a table: headers of one or two rows, some bodies, and a footer across."""
    first = [F.min(c).alias(c) for c in ("l_quantity", "l_suppkey", "l_returnflag", "l_linestatus")]
    rows = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).cast("int").alias("col"), "l_quantity", "l_suppkey", "l_returnflag", "l_linestatus").repartition("table_id")  # moves once
    lines = rows.groupBy("table_id", "col").agg(*first).withColumn("row_end", F.col("l_quantity").cast("int") % 2 + 1)
    tables = lines.groupBy("table_id").agg(F.collect_list(F.struct("col", "row_end", "l_suppkey", "l_returnflag", "l_linestatus")).alias("lines"), F.max("col").alias("last"))

    def cell(row: int, col: Column, row_end: Column, col_end: Column, header: bool, text: Column) -> Column:
        return F.struct(F.lit(row).alias("row"), col.alias("col"), row_end.alias("row_end"), col_end.alias("col_end"), F.lit(header).alias("header"), text.alias("text"))

    heads = F.transform("lines", lambda x: cell(0, x["col"], x["row_end"], x["col"] + 1, True, x["l_returnflag"]))
    bodies = F.transform(F.filter("lines", lambda x: (x["row_end"] == 1) & (x["l_suppkey"] % 3 != 0)), lambda x: cell(1, x["col"], F.lit(2), x["col"] + 1, False, F.concat(x["l_linestatus"], F.lit("<"), x["col"].cast("string"))))
    foot = F.array(cell(2, F.lit(0), F.lit(3), F.col("last") + 1, False, F.lit("& all")))
    return L.table_html(tables.select("table_id", F.inline(F.concat(heads, bodies, foot)))).select("table_id", F.length("html").alias("n"), F.md5("html").alias("digest"))


def drawn_pages(spark, d) -> DataFrame:
    """Pages of ten lines with two pictures side by side, the mark of the second, a third picture on some, and a caption."""
    rows, slot = S.anchors(_blocks(spark, d)), F.col("ord") % K.LINES_PER_PAGE
    kind = F.when(slot.isin(2, 3) | ((slot == 6) & (F.col("doc_id") % 3 == 0)), "figure").when(slot.isin(4, 5), "caption").otherwise("paragraph")
    text = F.when(kind == "figure", "").when(slot == 4, "(b)").when(slot == 5, F.concat(F.lit("Figure "), F.col("page").cast("string"), F.lit(". "), F.left("text", F.lit(20)))).otherwise(F.col("text"))
    box = {"x0": F.when(slot == 3, 300.0).when(slot == 4, 290.0).otherwise(72.0), "x1": F.when(slot == 2, 285.0).when(slot == 4, 298.0).otherwise(540.0), "y0": F.when(slot.isin(2, 3), 160.0).when(slot == 4, 220.0).when(slot == 5, 290.0).when(slot == 6, 330.0).otherwise(F.col("y0")), "y1": F.when(slot.isin(2, 3), 280.0).when(slot == 4, 232.0).when(slot == 5, 320.0).when(slot == 6, 450.0).otherwise(F.col("y1"))}
    return rows.select("doc_id", "page", "ord", kind.alias("type"), text.alias("text"), *[c.cast("double").alias(n) for n, c in box.items()])


@query
def figure_merge(spark, d):
    """The blocks of those pages, with pictures that belong together made one."""
    return L.merged_figures(drawn_pages(spark, d)).select("doc_id", "page", "ord", "type", "x0", "y0", "x1", "y1")


@query
def mark_segments(spark, d):
    """Every block cut by three marks that overlap."""
    rows = _blocks(spark, d)
    mark = lambda seq, start, stop, rows: rows.select("doc_id", "block_id", F.lit(seq).alias("seq"), F.lit(start).alias("start"), stop.cast("int").alias("stop"))
    marks = mark(0, 5, F.lit(20), rows).unionByName(mark(1, 15, F.lit(30), rows)).unionByName(mark(2, 0, F.floor(F.length("text") / 2), rows.where("ord % 3 = 0")))
    return O.segments(rows.select("doc_id", "block_id", "text"), marks)


def _outlines(spark, d) -> DataFrame:
    """25 trees of customers: each is below the one of half its number; some parents are unknown, every fifth tree is a loop at its top."""
    rows = S.table(spark, d, "customer").select((F.col("c_custkey") % 25).alias("tree"), F.col("c_custkey").alias("id"), F.expr("c_custkey div 25").alias("n"), F.col("c_mktsegment").alias("name"))
    up = F.when(F.col("n") % 7 == 3, -1).when(F.col("n") > 0, F.expr("(n - 1) div 2 * 25 + tree")).when(F.col("tree") % 5 == 0, F.col("tree") + 25)
    return rows.select("tree", "id", up.cast("long").alias("parent"), "name")


@query
def outline_order(spark, d):
    return Q.preorder(_outlines(spark, d))


@query
def outline_roots(spark, d):
    return Q.climbed_roots(_outlines(spark, d))


@query
def numbers_stated(spark, d):
    """How many numbers a document states, the least and the greatest."""
    return S.table(spark, d, "documents").select("doc_id", T.numbers_in(F.col("text")).alias("v")).select("doc_id", F.size("v").alias("n"), F.array_min("v").alias("low"), F.array_max("v").alias("high"))


# --- evaluation ---


@query
def detection_report(spark, d):
    """Precision, recall and F1 of a parser, over all types and of each."""
    gold = S.anchors(_blocks(spark, d))
    pred = E.predictions(gold).where("ord % 8 <> 6")
    return E.report(gold, pred, E.matched(E.overlapping(gold, pred, K.MAP_IOU)))


@query
def kendall_weighted(spark, d):
    """The mean concordance of all pages, weighted by their pairs of blocks."""
    rows = S.anchors(_blocks(spark, d)).select(F.struct("doc_id", "page").alias("key"), "ord", F.length("text").alias("length"))
    return E.kendall(rows, "key", "ord", "length").agg(F.count("*").alias("pages"), F.sum("pairs").alias("pairs"), F.round(F.sum("s") / F.sum("pairs"), 6).alias("tau"))


@query
def citation_micro(spark, d):
    """Coverage and validity of all citations together: long documents count by what they cite."""
    each = QUERIES["citation_validity"](spark, d)
    return each.agg(F.sum("points").alias("points"), F.round(F.sum("cited_points") / F.sum("points"), 4).alias("coverage"), F.round(F.sum("valid") / F.sum(F.col("valid") + F.col("invalid")), 4).alias("validity"))


@query
def point_located(spark, d):
    """A point on each page: the smallest block around it, or the nearest."""
    rows = S.anchors(_blocks(spark, d)).withColumns({"x1": 72.0 + F.col("ord") % 5 * 90.0 + 60.0, "y1": F.col("y1") + F.col("ord") % 3 * 40.0})
    points = rows.select("doc_id", "page", (F.col("doc_id") * 37 % 560).cast("double").alias("x"), ((F.col("doc_id") * 53 + F.col("page") * 17) % 792).cast("double").alias("y")).distinct()
    return L.located(points, rows).select("doc_id", "page", "ord", F.round("gap", 6).alias("gap"))


@query
def caption_pairs(spark, d):
    """Captions of the drawn pages with their figures; every third says table, of which a page has one at its foot."""
    rows = drawn_pages(spark, d)
    says = F.when(F.col("page") % 3 == 1, "table").otherwise("figure")
    bodies = rows.where("type = 'figure'").unionByName(rows.where("ord % 10 = 9").withColumn("type", F.lit("table")))
    return L.paired_captions(rows.where("type = 'caption'").withColumn("says", says), bodies)


# --- summaries ---

SECTIONS = [("goal", "What for"), ("method", "How"), ("result", "What came out")]


@query
def summary_points(spark, d):
    """The points of summaries whose shape goes by document: sections listed, by key, alone, and under their names."""
    blocks = _blocks(spark, d)
    name = lambda n: F.concat(F.lit("b_"), F.lpad(n.cast("string"), 4, "0"))
    point = F.struct(F.concat(F.lit("Line "), F.col("ord").cast("string"), F.lit(" ["), "block_id", F.lit("]")).alias("text"), F.array(name(F.col("ord") + 1), F.lit("b_99999")).alias("block_ids"))
    own = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("ord") % 3 == k, F.struct("ord", point.alias("p"))))), lambda x: x["p"])
    said = blocks.where("type = 'paragraph'").groupBy("doc_id").agg(*[own(i).alias(k) for i, (k, _) in enumerate(SECTIONS)])
    listed = lambda by: F.struct(F.array(*[F.struct(F.lit(by(k, n)).alias("key"), F.col(k).alias("points")) for k, n in SECTIONS]).alias("sections"))
    keyed = F.struct(*[F.col(k) for k, _ in SECTIONS])
    shape = F.col("doc_id") % 4
    reply = F.when(shape == 0, F.to_json(listed(lambda k, _: k))).when(shape == 1, F.to_json(F.struct(keyed.alias("sections")))).when(shape == 2, F.to_json(keyed)).otherwise(F.to_json(listed(lambda _, n: n)))
    found = section_points(said.select("doc_id", F.concat(F.lit("Here: "), reply, F.lit(" Done.")).alias("reply")), SECTIONS, blocks)
    return found.select("doc_id", "section", "place", "text", F.size("block_ids").alias("ids"), "invalid")
