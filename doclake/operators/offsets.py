"""Places in texts: cut by marks and placeholders, and found again through what was taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.functions import text as T

BLOCK = ["doc_id", "block_id"]
PLACEHOLDER = "⟦[^⟧]*⟧"


def _stretches(text: Column, pattern: str) -> Column:
    """(n, hit): the lengths of what lies between matches and of the matches, in turn; together they are the text's."""
    part = lambda n, hit: F.struct(F.coalesce(n, F.lit(0)).alias("n"), F.lit(hit).alias("hit"))
    between = F.split(text, pattern, -1)
    return T.let(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda hits: F.flatten(F.transform(between, lambda b, i: F.array(part(F.length(b), False), part(F.length(F.get(hits, i)), True)))))


def segments(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, block_id, start, stop, mark): texts cut so that each piece is under one mark or none, or is a placeholder.

    ``texts``: doc_id, block_id, text; ``marks``: doc_id, block_id, seq, start, stop.  Where marks overlap the one with the
    highest ``seq`` shows, neighbours under one mark are one piece, and a placeholder is never cut or marked (null, as
    without a mark).  Pieces of a block are its text, in order; an empty text has none.
    """
    runs = texts.where(F.length("text") > 0).select(*BLOCK, F.posexplode(_stretches(F.col("text"), PLACEHOLDER)).alias("k", "s")).select(*BLOCK, "k", "s.n", "s.hit")
    upto = Window.partitionBy(*BLOCK).orderBy("k")
    placed = runs.withColumn("stop", F.sum("n").over(upto).cast("int")).withColumn("start", (F.col("stop") - F.col("n")).cast("int")).where("n > 0").drop("n")
    plain = placed.where("NOT hit").select(*BLOCK, "k", F.col("start").alias("a"), F.col("stop").alias("z"))
    inside = plain.join(marks, BLOCK).where("start < z AND stop > a AND start < stop").select(*BLOCK, "k", "a", "z", "seq", F.greatest("start", "a").alias("start"), F.least("stop", "z").alias("stop"))
    cuts = plain.select(*BLOCK, "k", F.explode(F.array("a", "z")).alias("at")).unionByName(inside.select(*BLOCK, "k", F.explode(F.array("start", "stop")).alias("at"))).distinct()
    in_run = Window.partitionBy(*BLOCK, "k").orderBy("at")
    bits = cuts.withColumn("end", F.lead("at").over(in_run)).where("end IS NOT NULL")
    over = bits.join(inside.select(*BLOCK, "k", "seq", "start", "stop"), [*BLOCK, "k"], "left").groupBy(*BLOCK, "k", "at", "end").agg(F.max(F.when((F.col("start") <= F.col("at")) & (F.col("stop") >= F.col("end")), F.col("seq"))).alias("mark"))
    changed = F.coalesce(F.lag("mark").over(in_run).eqNullSafe(F.col("mark")) & F.lag("at").over(in_run).isNotNull(), F.lit(False))
    island = over.withColumn("turn", (~changed).cast("int")).withColumn("turn", F.sum("turn").over(in_run))
    pieces = island.groupBy(*BLOCK, "k", "turn").agg(F.min("at").alias("start"), F.max("end").alias("stop"), F.first("mark").alias("mark")).select(*BLOCK, "start", "stop", "mark")
    kind = dict(pieces.dtypes)["mark"]
    return pieces.unionByName(placed.where("hit").select(*BLOCK, "start", "stop", F.lit(None).cast(kind).alias("mark")))


def anchor_ranges(answers: DataFrame, anchors: DataFrame, marker: str) -> DataFrame:
    """(answer, id, start, stop): the first place of each anchor's words in an answer without its markers, as places of the answer.

    ``answers``: answer, text; ``anchors``: answer, seq, id, text.  Blanks between words may differ or be missing.  An
    anchor that overlaps one before it (by ``seq``) is left out, and so is one without words.
    """
    plain = F.regexp_replace("text", marker, "")
    words = F.filter(F.split("anchor", "(?U)\\s+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.regexp_replace(w, "([.*+?^${}()|\\[\\]\\\\/&~#-])", "\\\\$1"))
    rows = anchors.select("answer", "seq", "id", F.col("text").alias("anchor")).join(answers.select("answer", "text"), "answer").withColumns({"plain": plain, "pattern": F.array_join(quoted, "\\s*")}).where("pattern <> ''")
    hit = F.expr("regexp_substr(plain, pattern)")
    found = rows.withColumn("hit", hit).where("length(hit) > 0").withColumn("at", F.expr("regexp_instr(plain, pattern)") - 1)
    cut = found.withColumns({"kept": F.split("text", marker, -1), "taken": F.regexp_extract_all("text", F.lit(f"({marker})"), 1)})
    # each marker: how many characters lie before it without markers, and its length
    before = F.transform("taken", lambda _, i: F.aggregate(F.slice("kept", 1, i + 1), F.lit(0), lambda n, p: n + F.length(p)))
    holes = cut.withColumn("holes", F.zip_with(before, "taken", lambda at, m: F.struct(at.alias("at"), F.length(m).alias("n"))))
    back = lambda at: F.col(at) + F.aggregate(F.filter("holes", lambda h: h["at"] <= F.col(at)), F.lit(0), lambda n, h: n + h["n"])
    placed = holes.withColumn("last", F.col("at") + F.length("hit") - 1).select("answer", "seq", "id", back("at").alias("start"), (back("last") + 1).alias("stop"))
    every = placed.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("seq", "id", "start", "stop"))).alias("all"))
    none = F.slice("all", 1, 0)
    clear = lambda kept, r: ~F.exists(kept, lambda o: (r["start"] < o["stop"]) & (o["start"] < r["stop"]))
    chosen = F.aggregate("all", none, lambda kept, r: F.when(clear(kept, r), F.concat(kept, F.array(r))).otherwise(kept))
    return every.select("answer", F.explode(chosen).alias("r")).select("answer", "r.id", "r.start", "r.stop")
