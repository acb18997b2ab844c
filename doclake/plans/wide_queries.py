"""Further operators of the reference: search text, citations, library rules, graph and evaluation details, lineage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from doclake.functions import text as T
from doclake.functions import udfs
from doclake.operators import blocks as B
from doclake.operators import evaluation as E
from doclake.operators import jobs as J
from doclake.plans.queries import _blocks, _old, query
from doclake.sources import tables as S

SEARCHABLE = ("title", "abstract", "paragraph")


# --- search ---


@query
def fts_terms(spark, d):
    """The terms that a document's first line would search for."""
    terms = T.terms_of(F.col("text"))
    return _blocks(spark, d).where("ord = 0").select("doc_id", F.size(terms).alias("n_terms"), F.array_join(terms, " ").alias("terms"))


@query
def fts_index(spark, d):
    """One row for each searchable block: its plain text, line ends kept."""
    body = F.trim(F.regexp_replace("text", "[ \\t\\r\\f]+", " "))
    return _blocks(spark, d).where(F.col("type").isin(*SEARCHABLE)).select("doc_id", "block_id", F.md5(body).alias("digest"), F.length(body).alias("n")).where("n > 0")


@query
def search_highlight(spark, d):
    """Snippets of all blocks that contain a term."""
    hit = F.contains(F.lower("text"), F.lit("tion")) | F.contains(F.lower("text"), F.lit("ing"))
    return _blocks(spark, d).where(hit).select("doc_id", "block_id", T.highlight(F.col("text"), ["tion", "ing"]).alias("snippet"))


@query
def sentence_split(spark, d):
    parts = T.sentences(F.col("text"))
    return _blocks(spark, d).select("doc_id", "block_id", F.size(parts).alias("n"), F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)).alias("longest"))


@query
def embed_reuse(spark, d):
    """Blocks of a new version whose text the old one had keep their vectors, the rest is to be computed."""
    old = _old(spark, d).select("doc_id", F.sha2("text", 256).alias("h")).distinct().withColumn("known", F.lit(1))
    new = S.new_version(_blocks(spark, d)).select("doc_id", F.sha2("text", 256).alias("h"))
    return new.join(old, ["doc_id", "h"], "left").groupBy("doc_id").agg(F.count("known").alias("reused"), F.count_if(F.col("known").isNull()).alias("computed"))


# --- citations and answers ---


@query
def citation_validity(spark, d):
    """Every paragraph cites two blocks that may not exist: valid and invalid ids, coverage of points."""
    b = _blocks(spark, d)
    name = lambda n: F.concat(F.lit("b_"), F.lpad(n.cast("string"), 4, "0"))
    cites = b.where("type = 'paragraph'").select("doc_id", "ord", F.explode(F.array(name(F.col("ord") * 2), name(F.col("ord") * 3))).alias("block_id"))
    found = cites.join(b.select("doc_id", "block_id", F.lit(1).alias("there")), ["doc_id", "block_id"], "left")
    points = found.groupBy("doc_id", "ord").agg(F.count("there").alias("valid"), F.count(F.lit(1)).alias("all"))
    return points.groupBy("doc_id").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("valid") > 0).alias("cited_points"), F.sum("valid").alias("valid"), F.sum(F.col("all") - F.col("valid")).alias("invalid"), F.round(F.count_if(F.col("valid") > 0) / F.count(F.lit(1)), 4).alias("coverage"))


@query
def answer_metrics(spark, d):
    """Ids that the assistant's answers show: distinct in an answer, valid in the context of earlier turns, out of it."""
    said = F.concat("text", F.lit(" [b_"), F.col("turn").cast("string"), F.lit(", B-"), (F.col("turn") - 1).cast("string"), F.lit("; b_0"), (F.col("turn") - 1).cast("string"), F.lit("]"))
    answers = S.table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.explode(T.normal_ids(said)).alias("id"))
    inside = F.regexp_extract("id", "([0-9]+)", 1).cast("long") < F.col("turn")
    return answers.groupBy("conv_id").agg(F.countDistinct("turn").alias("answers"), F.count(F.lit(1)).alias("shown"), F.count_if(inside).alias("valid"), F.count_if(~inside).alias("out_of_context"))


@query
def citation_split(spark, d):
    """A text with ids in brackets, without them, and the ids."""
    said = F.concat("text", F.lit(" [b_0012, B-7；b_12]"))
    return _blocks(spark, d).select("doc_id", "block_id", F.md5(T.without_ids(said)).alias("digest"), F.array_join(T.normal_ids(F.concat_ws(" ", F.regexp_extract_all(said, F.lit(T.INLINE_IDS), 0))), ",").alias("ids"))


@query
def query_rewrite(spark, d):
    """A follow-up question is searched with its parent question."""
    t = S.turns(S.table(spark, d, "conversations"))
    up = t.select("conv_id", F.col("node").alias("parent"), F.col("text").alias("before"))
    return t.where("role = 'user'").join(up, ["conv_id", "parent"], "left").select("conv_id", "node", F.md5(F.concat_ws(" ", "text", "before")).alias("digest"))


@query
def section_change(spark, d):
    """Blocks before which a context prints the heading of their section."""
    b = B.with_section(_blocks(spark, d)).where("type <> 'heading'")
    changed = ~F.lag("section").over(B.in_order()).eqNullSafe(F.col("section")) & F.col("section").isNotNull()
    return b.select("doc_id", "ord", "section", changed.alias("changed")).where("changed").drop("changed")


# --- library ---


@query
def library_page_total(spark, d):
    """The second page of twenty by title, with the number of all."""
    items = S.items(S.table(spark, d, "customer")).where("status = 'active'")
    page = items.orderBy("title", "item_id").offset(20).limit(20)
    return page.crossJoin(F.broadcast(items.agg(F.count(F.lit(1)).alias("total")))).select("item_id", "title", "total")  # one row


@query
def translatable_blocks(spark, d):
    """Blocks with text, of a type that is translated, in another language than the target (de)."""
    docs = S.table(spark, d, "documents").where(F.lower(F.split("lang", "-")[0]) != "de")
    return S.blocks(docs).where(F.col("type").isin(*SEARCHABLE, "heading") & (F.trim("text") != "")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query
def job_by_payload(spark, d):
    """The newest event of each type whose payload has k = 3."""
    hit = S.table(spark, d, "events").where(F.get_json_object("props", "$.k") == "3")
    return hit.groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query
def parse_decision(spark, d):
    """Cached with the same engine and version, skipped when a better engine parsed it, else to be parsed."""
    rank = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in (("pymupdf", 0), ("docling", 1), ("mineru", 2)) for x in kv]), c)
    engine = lambda c: F.element_at(F.array(F.lit("pymupdf"), F.lit("docling"), F.lit("mineru")), (c % 3 + 1).cast("int"))
    rows = S.table(spark, d, "customer").select("c_custkey", engine(F.col("c_nationkey")).alias("old"), engine(F.col("c_custkey")).alias("new"), (F.col("c_acctbal") >= 0).alias("same_version"))
    return rows.select("c_custkey", F.when((F.col("old") == F.col("new")) & F.col("same_version"), "cached").when(rank(F.col("old")) > rank(F.col("new")), "skipped").otherwise("parse").alias("decision"))


@query
def glossary_junk(spark, d):
    """Terms by their key: empty ones and those over 200 characters go, the first of a key stays."""
    rows = S.table(spark, d, "part").select("p_partkey", T.collapse(F.col("p_name")).alias("term")).where((F.col("term") != "") & (F.length("term") <= 200))
    return rows.groupBy(F.lower("term").alias("term_key")).agg(F.min("p_partkey").alias("first"), F.count(F.lit(1)).alias("n"))


@query
def author_strings(spark, d):
    """The first three names of a collection and a mark for more."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"])
    rows = S.table(spark, d, "customer").groupBy("c_nationkey").agg(names.alias("names"))
    return rows.select("c_nationkey", F.concat(F.array_join(F.slice("names", 1, 3), "; "), F.when(F.size("names") > 3, " et al.").otherwise("")).alias("authors"))


@query
def latest_summary(spark, d):
    """Of the versions of a (customer, priority), the last one stays."""
    return S.table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.count(F.lit(1)).alias("versions"))


@query
def sync_truncation_guard(spark, d):
    """A snapshot with under half of the items that a collection had is not believed."""
    known = S.items(S.table(spark, d, "customer")).groupBy("collection_id").agg(F.count(F.lit(1)).alias("known"), F.count_if(F.col("status") == "active").alias("live"))
    return known.select("collection_id", "known", "live", (F.col("live") * 2 < F.col("known")).alias("refused"))


@query
def utc_strings(spark, d):
    """Times as text, and whether they are over seven days before the last."""
    e = S.table(spark, d, "events")
    last = F.broadcast(e.agg(F.max("ts").alias("last")))  # one row
    return e.crossJoin(last).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"), (F.col("ts") < F.col("last") - F.expr("INTERVAL 7 DAYS")).alias("old"))


@query
def display_fallbacks(spark, d):
    """A plausible title has eight characters and no file extension; its normal form is lower-case letters and digits, 60 at most."""
    first = T.collapse(F.split("text", "\n")[0])
    plausible = (F.length(first) >= 8) & ~F.lower(first).rlike("\\.(pdf|docx?|tex|dvi|ps)$")
    return S.table(spark, d, "documents").where("text is not null").select("doc_id", plausible.alias("plausible"), F.left(F.regexp_replace(F.lower(first), "[^a-z0-9]+", ""), F.lit(60)).alias("title_key"))


@query
def markdown_quote(spark, d):
    """Each line, also an empty last one, behind a mark; only a line feed ends a line."""
    return S.table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> ")))).alias("digest"))


# --- graph ---


@query
def kg_relation_dedupe(spark, d):
    """Relations that agree in ends, type and block are one: the most confident, the first of equals; no loops."""
    w = Window.partitionBy("src", "dst", "type", "block").orderBy(F.desc("confidence"), "seq")
    rel = S.relations(S.table(spark, d, "lineitem")).where("src <> dst")
    return rel.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("src", "dst", "type", "block", "seq")


@query
def kg_read_model(spark, d):
    """Each node with its ordered blocks and aliases of at most ten neighbours."""
    rel = S.relations(S.table(spark, d, "lineitem"))
    return rel.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("block")), ",").alias("blocks"), F.array_join(F.slice(F.array_sort(F.collect_set("dst")), 1, 10), ",").alias("neighbours"))


@query
def kg_histogram(spark, d):
    rel = S.relations(S.table(spark, d, "lineitem"))
    return rel.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("block").alias("docs"))


@query
def kg_node_radius(spark, d):
    rel = S.relations(S.table(spark, d, "lineitem"))
    value = rel.groupBy("dst").agg(F.count(F.lit(1)).alias("value"))
    return value.select("dst", "value", F.round(F.least(F.lit(14.0), 4 + 2.2 * F.sqrt(F.col("value") - 1)), 6).alias("radius"))


@query
def hash_unit(spark, d):
    """A name's place in [0, 1): FNV-1a over its characters."""
    codes = F.transform(F.split("p_name", ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, c: F.pmod(a.bitwiseXOR(c) * F.lit(16777619).cast("long"), F.lit(4294967296).cast("long")))
    return S.table(spark, d, "part").select("p_partkey", F.round(h / F.lit(4294967296.0), 9).alias("unit"))


# --- evaluation ---


@query
def bounding_boxes(spark, d):
    """Union and component-wise median of the rectangles of a page."""
    a = S.anchors(_blocks(spark, d))
    return a.groupBy("doc_id", "page").agg(F.round(F.min("y0"), 6).alias("y0"), F.round(F.max("y1"), 6).alias("y1"), F.round(F.median("y0"), 6).alias("mid_y0"), F.round(F.median("y1"), 6).alias("mid_y1"), F.median(F.length("text")).alias("body_size"))


@query
def medoid_names(spark, d):
    """The name of each region's nations with the least sum of normalised edit distances to the others, the first of equals."""
    n = S.table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name")
    other = n.select("n_regionkey", F.col("n_nationkey").alias("k2"), F.col("n_name").alias("name2"))
    far = n.join(other, "n_regionkey").where("n_nationkey <> k2").withColumn("ned", F.levenshtein("n_name", "name2") / F.greatest(F.length("n_name"), F.length("name2")))
    sums = far.groupBy("n_regionkey", "n_nationkey").agg(F.first("n_name").alias("n_name"), F.round(F.sum("ned"), 6).alias("far"))
    return sums.groupBy("n_regionkey").agg(F.min(F.struct("far", "n_nationkey", "n_name")).alias("s")).select("n_regionkey", F.col("s.n_name").alias("medoid"), F.col("s.far").alias("far"))


@query
def bounding_sphere(spark, d):
    """Centre of a label's vectors (first three components) and the radius that covers 90 % of them."""
    v = S.table(spark, d, "embeddings").where("embedding is not null").select("label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    mid = v.groupBy("label").agg(*[F.round(F.avg(c), 9).alias(f"m{c}") for c in "xyz"], F.count(F.lit(1)).alias("n"))
    far = v.join(mid, "label").withColumn("r", F.round(F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "xyz"), F.lit(0.0))), 6))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("r"))
    return far.withColumn("rank", rank).where(F.col("rank") == F.ceil(F.col("n") * 9 / 10)).select("label", "n", F.col("r").alias("radius"))


@query
def warning_kinds(spark, d):
    """Messages by the first class that fits."""
    t = F.lower("text")
    kind = F.when(t.rlike("https?://"), "link").when(t.rlike("[0-9]{4}"), "number").when(t.rlike("\\?"), "question").otherwise("other")
    return S.table(spark, d, "conversations").where("text is not null").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def key_differences(spark, d):
    """Words of a document's first line or of its second, not of both."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]+)"), 1))
    b = _blocks(spark, d).where("ord < 2").groupBy("doc_id").agg(F.max(F.when(F.col("ord") == 0, words)).alias("a"), F.max(F.when(F.col("ord") == 1, words)).alias("b")).where("a is not null and b is not null")
    return b.select("doc_id", F.size(F.array_union(F.array_except("a", "b"), F.array_except("b", "a"))).alias("n"))


@query
def reference_runs(spark, d):
    """Runs of three or more blocks of a type of which at least half look like citations: first and last hit."""
    hit = F.col("text").rlike("[0-9]").cast("int")
    new = F.coalesce(F.col("type") != F.lag("type").over(B.in_order()), F.lit(True)).cast("int")
    runs = _blocks(spark, d).withColumns({"hit": hit, "new": new}).withColumn("run", F.sum("new").over(B.so_far()))
    found = runs.groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("ord"))).alias("first_hit"), F.max(F.when(F.col("hit") == 1, F.col("ord"))).alias("last_hit"))
    return found.where("n >= 3 and hits * 2 >= n").drop("run")


# --- models, lineage, jobs ---


@query
def usage_audit(spark, d):
    """A row for each call; what a cache answered cost no tokens."""
    c = S.calls(S.table(spark, d, "events"))
    return c.groupBy("task").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.when(F.col("cache_hit"), 0).otherwise(F.col("input"))).alias("input"), F.sum(F.when(F.col("cache_hit"), 0).otherwise(F.col("cached"))).alias("cached"))


@query
def summary_fake_map(spark, d):
    """Map and reduce with a fake model: a section's point cites its first two blocks, a document's summary joins the points."""
    b = B.with_section(_blocks(spark, d)).where("type <> 'heading'")
    first = b.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("ord"))).where("rn <= 2")
    points = first.groupBy("doc_id", "section").agg(F.array_join(F.array_sort(F.collect_list("block_id")), ",").alias("cites"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("section", F.lit(-1)).alias("s"), "cites"))), lambda x: x["cites"]), ";")
    return points.groupBy("doc_id").agg(F.count(F.lit(1)).alias("points"), F.md5(joined).alias("summary"))


@query
def lineage_relations(spark, d):
    """Relations between neighbouring blocks move to a new version if both ends do; the others are stale."""
    pairs = E.same_hash(_old(spark, d), S.new_version(_blocks(spark, d)))
    rel = _blocks(spark, d).where("ord > 0").select("doc_id", F.col("ord").alias("src"), (F.col("ord") - 1).alias("dst"))
    a, b = (pairs.select("doc_id", F.col("ord").alias(s), F.col("new_ord").alias(f"new_{s}")) for s in ("src", "dst"))
    moved = rel.join(a, ["doc_id", "src"], "left").join(b, ["doc_id", "dst"], "left")
    ok = F.col("new_src").isNotNull() & F.col("new_dst").isNotNull()
    return moved.groupBy("doc_id").agg(F.count_if(ok).alias("moved"), F.count_if(~ok).alias("stale"))


@query
def job_progress(spark, d):
    s = J.latest_state(S.jobs(S.table(spark, d, "events")))
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("jobs"), F.round(F.count_if(F.col("status").isin("done", "failed")) / F.count(F.lit(1)), 4).alias("progress"))


@query
def job_triggers(spark, d):
    """Done jobs that no other job depends on start the next step."""
    s = J.latest_state(S.jobs(S.table(spark, d, "events")))
    return s.where("status = 'done'").join(s.select(F.col("depends_on").alias("job")).where("job is not null").distinct(), "job", "left_anti").select("job", "kind")


@query
def placeholder_roundtrip(spark, d):
    """Links, numeric citations and code become placeholders and come back."""
    both = udfs.protected(F.concat("text", F.lit(" see https://x.example/a?b=1 [3, 4] and `code`")))
    made = _blocks(spark, d).select("doc_id", "text", both.alias("p"))
    return made.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("p.restored") == F.concat("text", F.lit(" see https://x.example/a?b=1 [3, 4] and `code`"))).alias("restored"), F.count_if(F.contains("p.text", F.lit("⟦URL"))).alias("with_link"))
