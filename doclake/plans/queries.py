"""One query for each operator, over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclake import constants as K
from doclake.functions import text as T
from doclake.operators import blocks as B
from doclake.operators import evaluation as E
from doclake.operators import graph as G
from doclake.operators import jobs as J
from doclake.operators import library as L
from doclake.operators import retrieval as R
from doclake.operators import trees as Q
from doclake.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    if f.__name__ in QUERIES:
        raise ValueError(f"there is a query {f.__name__} already")
    QUERIES[f.__name__] = f
    return f


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return S.blocks(S.table(spark, d, "documents"))


def _old(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("doc_id", "ord", "text")


# --- retrieval ---


@query
def search_bm25(spark, d):
    found = R.bm25(_blocks(spark, d), ["ing", "tion"])
    return found.orderBy(F.desc("score"), "doc_id", "ord").limit(K.SEARCH_CANDIDATES).drop("ord")


@query
def search_like_fallback(spark, d):
    return R.like_all(_blocks(spark, d), ["ou", "ñ"])


@query
def search_knn(spark, d):
    v = S.table(spark, d, "embeddings")
    return R.knn(v, v.where("vec_id = 0").select(F.col("embedding").alias("q")), K.SEARCH_CANDIDATES)


@query
def search_knn_partitioned(spark, d):
    v = S.table(spark, d, "embeddings")
    return R.knn(v, v.where("vec_id = 0").select(F.col("embedding").alias("q")), 5, "label").select("label", "vec_id", "distance", F.col("rank").cast("int").alias("rank"))


@query
def search_hybrid_topk(spark, d):
    v = S.table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.hybrid(_blocks(spark, d), v, "ing tion", v.where("vec_id = 0").select(F.col("embedding").alias("q")))


# --- text and blocks ---


@query
def approx_tokens_by_lang(spark, d):
    return S.table(spark, d, "documents").groupBy("lang").agg(F.sum(T.approx_tokens(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("n"))


@query
def lang_cjk_ratio(spark, d):
    t = S.table(spark, d, "documents").groupBy("source").agg(F.sum(T.wide_count(F.col("text"))).alias("wide"), F.sum(F.length("text")).alias("n"))
    return t.select("source", F.when(F.col("wide") / F.col("n") > 0.2, "zh").otherwise("en").alias("language"), "n")


@query
def html_plain_text(spark, d):
    plain = T.html_text(F.col("html"))
    return S.table(spark, d, "pages").select("page_id", F.md5(plain).alias("digest"), F.length(plain).alias("n_chars"))


@query
def content_hash_dupes(spark, d):
    return S.table(spark, d, "documents").groupBy(T.content_hash(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query
def section_assign(spark, d):
    return B.with_section(_blocks(spark, d)).select("doc_id", "block_id", "section")


@query
def section_tree_parent(spark, d):
    return B.section_parents(_blocks(spark, d))


@query
def section_root(spark, d):
    return B.section_roots(B.section_parents(_blocks(spark, d)))


@query
def block_ranges(spark, d):
    return B.section_ranges(_blocks(spark, d))


@query
def section_groups(spark, d):
    return B.islands(_blocks(spark, d))


@query
def prev_paragraph(spark, d):
    return B.previous_paragraph(_blocks(spark, d))


@query
def reference_mark(spark, d):
    return B.mark_references(_blocks(spark, d), "the").groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query
def chunk_pack(spark, d):
    return B.chunks(_blocks(spark, d))


@query
def chunk_texts(spark, d):
    """Chunks as they are embedded, by the hash of their text."""
    return B.chunk_texts(_blocks(spark, d)).select("doc_id", "chunk", F.size("ords").alias("n_blocks"), F.sha2("text", 256).alias("text_hash"))


@query
def chunk_text_hash(spark, d):
    return _blocks(spark, d).select("doc_id", "block_id", F.sha2("text", 256).alias("text_hash"))


@query
def decoration_repeat(spark, d):
    return B.repeated_edges(S.anchors(_blocks(spark, d)))


@query
def decoration_boilerplate(spark, d):
    t = F.lower("text")
    is_url, is_right = t.rlike("https?://|www\\."), t.rlike("copyright|license|all rights reserved|permission")
    return _blocks(spark, d).where((F.length("text") <= 400) & (is_url | is_right)).select("doc_id", "block_id", is_url.alias("url"), is_right.alias("rights"))


@query
def caption_nearest(spark, d):
    return B.nearest_captions(S.anchors(_blocks(spark, d)))


@query
def validate_blocks(spark, d):
    return B.violations(_blocks(spark, d))


@query
def export_markdown_body(spark, d):
    line = F.when(F.col("type") == "title", F.concat(F.lit("# "), "text")).when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level") + 1), F.lit(" "), "text")).otherwise(F.col("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n\n")
    return _blocks(spark, d).groupBy("doc_id").agg(F.md5(body).alias("digest"))


@query
def point_in_block(spark, d):
    a = S.anchors(_blocks(spark, d)).where("doc_id % 10 = 0 or page >= 0")
    y = F.lit(131.0)
    inside = (F.col("y0") <= y) & (F.col("y1") >= y)
    gap = F.greatest(F.lit(0.0), F.col("y0") - y, y - F.col("y1"))
    near = a.withColumn("gap", gap).where(inside | (gap <= 8))
    return near.groupBy("doc_id", "page").agg(F.min_by("block_id", F.struct((~inside).cast("int"), "gap", -F.col("ord"))).alias("block_id"))


@query
def span_merge(spark, d):
    """Overlapping highlights of a document as one: gaps and islands over spans [13 * ord, 13 * ord + length % 40)."""
    spans = _blocks(spark, d).select("doc_id", (F.col("ord") * 13).alias("a"), (F.col("ord") * 13 + F.length("text") % 40).alias("b"))
    w = Window.partitionBy("doc_id").orderBy("a")
    top = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = spans.withColumn("new", (F.coalesce(top, F.lit(-1)) < F.col("a")).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("doc_id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run")


# --- library ---


@query
def library_list_sorted(spark, d):
    return L.listing(S.items(S.table(spark, d, "customer")), "active", 10, 50)


@query
def library_search_ilike(spark, d):
    return L.title_search(S.items(S.table(spark, d, "customer")), "r#00000000")


@query
def collection_counts(spark, d):
    names = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("collection_id"), F.col("n_name").alias("name"))
    return L.collection_counts(S.items(S.table(spark, d, "customer")), names)


@query
def collection_descendants(spark, d):
    """Items below each root of the two-level collection tree."""
    items, nation, region = S.items(S.table(spark, d, "customer")), S.table(spark, d, "nation"), S.table(spark, d, "region")
    return items.join(nation, F.col("collection_id") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n_items"))


@query
def item_detail_nested(spark, d):
    lines = L.nested(S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey", "l_linenumber", "l_returnflag")
    return lines.select("l_orderkey", F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["l_linenumber"].cast("string"), p["l_returnflag"])), ",").alias("parts"))


@query
def eav_pivot(spark, d):
    p = S.table(spark, d, "part")
    eav = p.select("p_partkey", F.explode(F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string"))).alias("field", "value"))
    return L.pivot(eav, "p_partkey", "field", "value", ["brand", "type", "size"])


@query
def archive_anti_join(spark, d):
    """Active items that no order names."""
    items, orders = S.items(S.table(spark, d, "customer")), S.table(spark, d, "orders").select(F.col("o_custkey").alias("item_id"))
    return items.where("status = 'active'").join(orders, "item_id", "left_anti").select("item_id", "title")


@query
def needs_parse(spark, d):
    """Orders that wait, without those whose lines are already being shipped."""
    o, busy = S.table(spark, d, "orders").where("o_orderstatus in ('P', 'F')"), S.table(spark, d, "lineitem").where("l_linestatus = 'O'")
    return o.join(busy, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderstatus")


@query
def doc_status_counts(spark, d):
    o = S.table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("ready"), F.count_if(F.col("o_orderstatus") == "O").alias("pending"))


@query
def snapshot_merge(spark, d):
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("version"))
    old, new = c.where("key % 7 <> 1"), c.where("key % 5 <> 2").withColumn("version", F.when(F.col("key") % 3 == 0, F.col("version") + 1).otherwise(F.col("version")))
    return L.merged(old, new, "key", "version")


@query
def incremental_changed(spark, d):
    orders = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("version"))
    lines = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.to_date("l_shipdate").alias("version"))
    return L.changed_since(lines, orders, "key", F.lit("1998-06-01").cast("date"))


@query
def translation_active(spark, d):
    """Of the rows of a (user, type), the last is active."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return S.table(spark, d, "events").select("event_id", (F.row_number().over(w) == 1).alias("is_active"))


# --- trees ---


@query
def qa_ancestors(spark, d):
    return Q.ancestors(S.turns(S.table(spark, d, "conversations")))


@query
def qa_subtree(spark, d):
    """Size of the subtree of every node."""
    t = S.turns(S.table(spark, d, "conversations"))
    return t.select("conv_id", "node").unionByName(Q.ancestors(t).select("conv_id", F.col("ancestor").alias("node"))).groupBy("conv_id", "node").agg(F.count(F.lit(1)).alias("n"))


@query
def qa_latest_leaf(spark, d):
    return Q.latest_leaf(S.turns(S.table(spark, d, "conversations")))


@query
def qa_sessions_turns(spark, d):
    return S.table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("questions"), F.max("turn").alias("last_turn"))


@query
def qa_lag_chain(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return S.table(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("parent"))


# --- citations, glossary, placeholders ---


@query
def citation_normalize(spark, d):
    cited = F.concat(F.lit("see B-"), (F.col("turn") % 7).cast("string"), F.lit(" and [b_0"), (F.col("turn") % 3).cast("string"), F.lit("], b_12, B_12"))
    return S.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.normal_ids(cited), ",").alias("ids"))


@query
def citation_coverage(spark, d):
    """Share of a document's paragraphs that hold a citation-like number."""
    b = _blocks(spark, d).where("type = 'paragraph'")
    t = b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("text").rlike("[0-9]")).alias("cited"))
    return t.withColumn("coverage", F.round(F.col("cited") / F.col("points"), 4))


@query
def glossary_hits(spark, d):
    """Blocks that use a term as a word, in any case, with an optional plural."""
    terms = ["the", "der", "los", "les"]
    hits = F.filter(F.array(*[F.when(F.lower("text").rlike(f"(^|[^a-z]){t}(s|es)?([^a-z]|$)"), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
    return _blocks(spark, d).select("doc_id", F.explode(hits).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("blocks"))


@query
def glossary_override(spark, d):
    """Terms of a supplier's nation override the global term of equal key."""
    glob = S.table(spark, d, "nation").select(F.lower("n_name").alias("term"), F.lit(0).alias("scope"), F.col("n_name").alias("target"))
    own = S.table(spark, d, "region").select(F.lower("r_name").alias("term"), F.lit(1).alias("scope"), F.concat("r_name", F.lit("!")).alias("target"))
    both = glob.unionByName(own).unionByName(glob.where("term < 'f'").select("term", F.lit(1).alias("scope"), F.concat("target", F.lit("?")).alias("target")))
    return L.latest(both, ["term"], F.desc("scope"), F.col("target")).select("term", "target")


@query
def placeholder_protect_counts(spark, d):
    t = F.col("text")
    return S.table(spark, d, "documents").select("doc_id", F.regexp_count(t, F.lit("https?://[^ \n]+")).alias("urls"), F.regexp_count(t, F.lit("\\[[0-9]+\\]")).alias("cites"), F.regexp_count(t, F.lit("`[^`\n]+`")).alias("codes"))


# --- graph ---


@query
def kg_scores(spark, d):
    return G.degrees(S.relations(S.table(spark, d, "lineitem")))


@query
def kg_prune(spark, d):
    return G.prune(G.degrees(S.relations(S.table(spark, d, "lineitem"))), "s")


@query
def kg_relations_best(spark, d):
    return G.best_relations(S.relations(S.table(spark, d, "lineitem"))).select("src", "dst", "type", "block", "seq", F.round("confidence", 6).alias("confidence"))


@query
def kg_link_bundle(spark, d):
    return G.bundles(S.relations(S.table(spark, d, "lineitem")))


@query
def kg_numbers_in_text(spark, d):
    found = F.transform(F.regexp_extract_all("text", F.lit("(^|[^A-Za-z0-9_.])([0-9]+)"), 2), lambda x: F.length(x))
    return S.table(spark, d, "documents").select("doc_id", F.size(found).alias("n"), F.aggregate(found, F.lit(0), lambda a, x: a + x).alias("digits"))


# --- lineage and evaluation ---


@query
def map_blocks_exact(spark, d):
    return E.same_hash(_old(spark, d), S.new_version(_blocks(spark, d)))


@query
def lineage_translations(spark, d):
    """Old rows follow their block; those without one are stale."""
    old = _old(spark, d)
    m = E.same_hash(old, S.new_version(_blocks(spark, d)))
    j = old.select("doc_id", "ord").join(m, ["doc_id", "ord"], "left")
    return j.groupBy("doc_id").agg(F.count_if(F.col("new_ord").isNull()).alias("stale"), F.count("new_ord").alias("moved"), F.sum("new_ord").alias("checksum"))


@query
def iou_candidates(spark, d):
    gold = S.anchors(_blocks(spark, d))
    return E.overlapping(gold, E.predictions(gold), K.MAP_IOU).drop("g_type", "p_type")


@query
def detection_metrics(spark, d):
    gold = S.anchors(_blocks(spark, d))
    pred = E.predictions(gold)
    m = E.matched(E.overlapping(gold, pred, K.MAP_IOU)).groupBy((F.col("doc_id") % 5).alias("shift")).agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("g_type") == F.col("p_type")).alias("right"))
    n = gold.groupBy((F.col("doc_id") % 5).alias("shift")).agg(F.count(F.lit(1)).alias("gold"))
    j = n.join(m, "shift", "left").fillna(0)
    return j.withColumns({"recall": F.round(F.col("matched") / F.col("gold"), 4), "type_accuracy": F.when(F.col("matched") > 0, F.round(F.col("right") / F.col("matched"), 4))})


@query
def kendall_tau_pages(spark, d):
    rows = S.anchors(_blocks(spark, d)).withColumn("key", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("page").cast("string"))).withColumn("length", F.length("text"))
    return E.kendall(rows, "key", "ord", "length").withColumn("tau", F.round(F.col("s") / F.col("pairs"), 6))


@query
def levenshtein_ned(spark, d):
    b = _blocks(spark, d).where("type in ('title', 'abstract')").groupBy("doc_id").agg(F.max(F.when(F.col("type") == "title", F.col("text"))).alias("a"), F.max(F.when(F.col("type") == "abstract", F.col("text"))).alias("b")).where("a is not null and b is not null")
    return b.select("doc_id", F.when((F.length("a") == 0) & (F.length("b") == 0), 0.0).otherwise(F.round(F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")), 6)).alias("ned"))


@query
def category_rollup(spark, d):
    j = S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id")
    tagged = j.select(F.explode(F.array(F.lit("all"), "lang", "source")).alias("category"), "quality", "n_chars")
    return tagged.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.median("n_chars").alias("median_chars"))


@query
def consensus_votes(spark, d):
    """The most frequent status of a part's lines, alphabetically first on ties, and whether two agree."""
    v = S.table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy("l_partkey").agg(F.min(F.struct((-F.col("n")).alias("m"), "l_returnflag")).alias("s")).select("l_partkey", F.col("s.l_returnflag").alias("vote"), (-F.col("s.m") >= 2).alias("agreed"))


@query
def startup_regression(spark, d):
    """Intercept and slope of price by quantity; null with under three points or no variance."""
    t = S.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.var_pop("l_quantity").alias("v"), F.regr_intercept("l_extendedprice", "l_quantity").alias("i"), F.regr_slope("l_extendedprice", "l_quantity").alias("s"))
    ok = (F.col("n") >= 3) & (F.col("v") > 0)
    return t.select("l_returnflag", "l_linestatus", F.when(ok, F.round("i", 2)).alias("intercept"), F.when(ok, F.round("s", 4)).alias("slope"))


# --- usage and jobs ---


@query
def usage_report(spark, d):
    return J.usage(S.calls(S.table(spark, d, "events")))


@query
def job_latest_state(spark, d):
    return J.latest_state(S.jobs(S.table(spark, d, "events"))).select("job", "kind", "status", "depends_on", "event_id")


@query
def job_claimable(spark, d):
    return J.claimable(J.latest_state(S.jobs(S.table(spark, d, "events")))).select("job", "kind")


@query
def job_admission(spark, d):
    states = J.latest_state(S.jobs(S.table(spark, d, "events")))
    return J.admitted(states.where("status = 'queued'"), states.where("status = 'running'"), {"k0": 1000, "k1": 1000, "k2": 1000}, 1000)


@query
def usage_windows(spark, d):
    """An addition of ours: hourly totals of model usage."""
    c = S.calls(S.table(spark, d, "events"))
    return c.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "task").agg(F.count(F.lit(1)).alias("n"), F.sum("input").alias("input"))
