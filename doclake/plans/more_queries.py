"""Further operators: contexts, budgets, sets, queues, routing, sampling, display strings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from doclake import constants as K
from doclake.functions import text as T
from doclake.operators import blocks as B
from doclake.operators import evaluation as E
from doclake.operators import graph as G
from doclake.operators import jobs as J
from doclake.operators import lineage as N
from doclake.plans.queries import _blocks, query
from doclake.sources import tables as S


@query
def search_rrf(spark, d):
    """Fusion of two rankings of documents: by length and by tokens."""
    from doclake.operators.retrieval import fuse

    docs = S.table(spark, d, "documents").select("doc_id", F.length("text").alias("n"), T.approx_tokens(F.col("text")).alias("tokens"))
    top = lambda s, c: docs.orderBy(F.desc(c), "doc_id").limit(K.SEARCH_CANDIDATES).select(F.lit(s).alias("source"), F.row_number().over(Window.orderBy(F.desc(c), "doc_id")).alias("pos"), "doc_id")
    fused = fuse(top(0, "n").unionByName(top(1, "tokens")), ["doc_id"])
    return fused.select("doc_id", F.round("score", 9).alias("score"), F.size("sources").alias("n_sources"))


@query
def context_neighbours(spark, d):
    """Blocks next to a hit within the same section."""
    rows = B.with_section(_blocks(spark, d)).select("doc_id", "ord", F.coalesce("section", F.lit(-1)).alias("section"), F.contains("text", F.lit("tion")).alias("hit"))
    near = rows.where("hit").select("doc_id", "section", F.col("ord").alias("hit_ord"), F.explode(F.array(F.col("ord") - 1, F.col("ord") + 1)).alias("ord"))
    return near.join(rows.select("doc_id", "section", "ord"), ["doc_id", "section", "ord"]).select("doc_id", "hit_ord", "ord")


@query
def context_budget(spark, d):
    """The first blocks of a document whose running cost stays within the budget."""
    cost = F.sum(T.approx_tokens(F.col("text")) + K.LINE_COST).over(B.so_far())
    return _blocks(spark, d).withColumn("spent", cost).where("spent <= 200").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("spent").alias("spent"))


@query
def placeholder_check(spark, d):
    """Words of a block against those of a copy that lost its articles, as multisets: what is missing of each."""
    words = lambda t, n: _blocks(spark, d).select("doc_id", "ord", F.explode(F.regexp_extract_all(t, F.lit("([a-z]+)"), 1)).alias("k"), F.lit(n).alias("n"))
    gap = words(F.col("text"), 1).unionByName(words(F.regexp_replace("text", "\\bthe\\b", ""), -1)).groupBy("doc_id", "ord", "k").agg(F.sum("n").alias("n")).where("n <> 0")
    return gap.groupBy("doc_id").agg(F.sum("n").alias("missing"), F.count(F.lit(1)).alias("kinds"))


@query
def version_diff(spark, d):
    """Distinct texts kept, dropped and added between two versions of a document."""
    old = _blocks(spark, d).select("doc_id", F.md5("text").alias("h")).distinct().withColumn("o", F.lit(1))
    new = S.new_version(_blocks(spark, d)).select("doc_id", F.md5("text").alias("h")).distinct().withColumn("n", F.lit(1))
    j = old.join(new, ["doc_id", "h"], "full")
    return j.groupBy("doc_id").agg(F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("kept"), F.count_if(F.col("n").isNull()).alias("dropped"), F.count_if(F.col("o").isNull()).alias("added"))


@query
def annotation_relocate(spark, d):
    """A quote (a whole block) goes to the one block of its document's next version that contains it, or is stale."""
    b = _blocks(spark, d)
    quotes = b.where("length(text) > 20 and size(split(text, ' ')) >= 3").select("doc_id", F.col("ord").alias("at"), F.col("text").alias("quote"))
    return N.relocated(quotes, S.new_version(b).select("doc_id", "new_ord", "text"))


@query
def engine_regression(spark, d):
    """Pages that two parsers both find, and where the second finds fewer blocks."""
    gold = S.anchors(_blocks(spark, d))
    one = E.overlapping(gold, E.predictions(gold), 0.5).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("a"))
    two = E.overlapping(gold, E.predictions(gold), 0.8).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("b"))
    return one.join(two, ["doc_id", "page"]).where("b < a").select("doc_id", "page", "a", "b")


@query
def document_features(spark, d):
    """Characters a page, mean and least, and headings a page."""
    pages = S.anchors(_blocks(spark, d)).groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("n"), F.count_if(F.col("type") == "heading").alias("h"))
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("n"), 4).alias("mean_chars"), F.min("n").alias("least_chars"), F.round(F.avg("h"), 4).alias("headings"))


@query
def best_page(spark, d):
    """The page with most headings and short lines, the first on ties."""
    score = F.sum(F.when(F.col("type") == "heading", 2).otherwise(0) + F.when(F.length("text") < 40, 1).otherwise(0))
    pages = S.anchors(_blocks(spark, d)).groupBy("doc_id", "page").agg(score.alias("score"))
    return pages.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "page")).alias("x")).select("doc_id", F.col("x.page").alias("page"), (-F.col("x.s")).alias("score"))


@query
def quota_sample(spark, d):
    """Of each source the five longest documents, then every seventh of the rest: a sampling operator."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    ranked = S.table(spark, d, "documents").select("doc_id", "source", "n_chars").withColumn("rn", F.row_number().over(w))
    return ranked.where("rn <= 5 or rn % 7 = 0").select("doc_id", "source", F.col("rn").cast("int").alias("rn"))


@query
def reference_ids(spark, d):
    """r_<n> for the first entry with a number, r_x<k> for the others."""
    number = F.length("text") % 50
    rows = _blocks(spark, d).where("type = 'paragraph'").select("doc_id", "ord", number.alias("number"))
    again = F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("ord"))
    rows = rows.withColumn("extra", (again > 1).cast("int")).withColumn("k", F.sum("extra").over(B.so_far()))
    return rows.select("doc_id", "ord", F.when(F.col("extra") == 0, F.concat(F.lit("r_"), F.col("number").cast("string"))).otherwise(F.concat(F.lit("r_x"), F.col("k").cast("string"))).alias("ref"))


@query
def continuation_merge(spark, d):
    """A block that starts in lower case continues the one before: merged runs."""
    starts = ~F.col("text").rlike("^[a-z]")
    run = _blocks(spark, d).withColumn("run", F.sum(starts.cast("int")).over(B.so_far()))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    return run.groupBy("doc_id", "run").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n"), F.md5(joined).alias("digest"))


@query
def kg_top_edges(spark, d):
    """Edges between the best nodes, by the sum of their scores."""
    rel = S.relations(S.table(spark, d, "lineitem"))
    top = G.degrees(rel).orderBy(F.desc("score"), "node").limit(40)
    a, b = (F.broadcast(top.select(F.col("node").alias(n), F.col("score").alias(f"{n}_score"))) for n in ("src", "dst"))  # 40 rows
    edges = rel.select("src", "dst").distinct().join(a, "src").join(b, "dst").withColumn("value", F.col("src_score") + F.col("dst_score"))
    return edges.orderBy(F.desc("value"), "src", "dst").limit(25).select("src", "dst", "value")


@query
def kg_visible(spark, d):
    """The graph without nodes of hidden types: an edge stays if both its ends do."""
    rel = S.relations(S.table(spark, d, "lineitem"))
    shown = S.table(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("src"))
    live = S.table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("dst"))
    return rel.join(shown, "src", "left_semi").join(live, "dst", "left_semi").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"))


@query
def job_cancel_closure(spark, d):
    """Queued jobs that wait for a failed one, directly or through other queued jobs."""
    return J.cancelled(J.latest_state(S.jobs(S.table(spark, d, "events"))))


@query
def job_queue_positions(spark, d):
    s = J.latest_state(S.jobs(S.table(spark, d, "events"))).where("status in ('queued', 'running')")
    w = Window.partitionBy("status").orderBy("created", "job")
    return s.select("job", "status", F.row_number().over(w).cast("int").alias("position"))


@query
def model_routing(spark, d):
    """The provider of a task: its own, or that of the task it falls back to."""
    own = S.calls(S.table(spark, d, "events")).groupBy("task").agg(F.min("prompt").alias("route"))
    tasks = spark.createDataFrame([("click", "view"), ("view", "purchase"), ("signup", "view"), ("error", "click"), ("purchase", None)], "task string, fallback string")
    one = tasks.join(own, "task", "left").join(own.select(F.col("task").alias("fallback"), F.col("route").alias("second")), "fallback", "left")
    return one.select("task", F.coalesce("route", "second").alias("route"))


@query
def inflight_dedupe(spark, d):
    """Requests of a user and type within the same hour are answered by the first."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return S.table(spark, d, "events").groupBy("user_id", "event_type", hour.cast("timestamp_ntz").alias("hour")).agg(F.min("event_id").alias("answered_by"), F.count(F.lit(1)).alias("n"))


@query
def display_strings(spark, d):
    """Short titles and years as a list shows them."""
    short = T.collapse(F.col("text"))
    return S.table(spark, d, "documents").select("doc_id", F.when(F.length(short) > 40, F.concat(F.left(short, F.lit(39)), F.lit("…"))).otherwise(short).alias("title"), F.nullif(F.regexp_extract("text", "([0-9]{4})", 1), F.lit("")).alias("year"))


@query
def retry_delays(spark, d):
    """The n-th error of a user waits min(2^(n-1), 30) seconds."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(w)
    return S.table(spark, d, "events").where("event_type = 'error'").select("event_id", F.least(F.pow(F.lit(2.0), F.least(n, F.lit(6)) - 1), F.lit(30.0)).alias("delay"))


@query
def label_agreement(spark, d):
    """A rule's output against labels: precision and recall."""
    rule = F.lower("text").rlike("idiot|moron|stupid").cast("int")
    j = S.table(spark, d, "documents").select("doc_id", rule.alias("p")).join(S.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    t = j.agg(F.count_if((F.col("p") == 1) & (F.col("toxic") == 1)).alias("tp"), F.count_if((F.col("p") == 1) & (F.col("toxic") == 0)).alias("fp"), F.count_if((F.col("p") == 0) & (F.col("toxic") == 1)).alias("fn"))
    return t.select("tp", "fp", "fn", F.when(F.col("tp") + F.col("fp") > 0, F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6)).alias("precision"), F.when(F.col("tp") + F.col("fn") > 0, F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6)).alias("recall"))

