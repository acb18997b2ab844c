"""Question-and-answer trees and collection trees.

Trees are walked by repeated self joins on the node key, until a join adds no row; each round is a table.  In a cycle
a node's ancestors are those it meets on its way round, once each and without itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclake.sources.shared import saved, saved_large


def ancestors(turns: DataFrame) -> DataFrame:
    """conv_id, node, ancestor, distance of every node's proper ancestors, by doubling: paths of 1, 2, 4, ... steps."""
    step = turns.where("parent is not null and parent <> node").select("conv_id", "node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    out, reach = saved(step, "ancestors"), 1
    while True:
        a, b = out.alias("a"), out.alias("b")
        far = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.ancestor") == F.col("b.node")) & (F.col("a.distance") == reach) & (F.col("a.node") != F.col("b.ancestor")))
        far = far.select("a.conv_id", "a.node", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        more = saved(far.join(out, ["conv_id", "node", "ancestor"], "left_anti"), "ancestors")
        if more.isEmpty():
            return out
        out, reach = out.unionByName(more), reach * 2


def latest_leaf(turns: DataFrame) -> DataFrame:
    """For each conversation, the last node that has no child."""
    inner = turns.where("parent is not null").select("conv_id", F.col("parent").alias("node")).distinct()
    return turns.join(inner, ["conv_id", "node"], "left_anti").groupBy("conv_id").agg(F.max("node").alias("leaf"))


def preorder(nodes: DataFrame) -> DataFrame:
    """(tree, id, depth, place): each tree's nodes as a sorted outline shows them; ``nodes``: tree, id, parent, name.

    Children stand below their parent by name, then id; a node whose parent is unknown or null is a root.  What only a
    cycle leads to is not shown.  Each round adds a level and is a table; a node's key is the path of names from its root.
    """
    step = F.struct("name", "id")
    known = nodes.select("tree", F.col("id").alias("parent")).distinct()
    roots = nodes.join(known, ["tree", "parent"], "left_anti").select("tree", "id", F.lit(0).alias("depth"), F.array(step).alias("path"))
    inner = saved(nodes.join(known, ["tree", "parent"], "left_semi").select("tree", "id", "parent", "name"), "children")
    level = saved(roots, "level")
    out = level
    while True:
        below = inner.join(level.select("tree", F.col("id").alias("parent"), "depth", "path"), ["tree", "parent"])
        level = saved(below.select("tree", "id", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array(step)).alias("path")), "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("tree", "id", "depth", F.row_number().over(Window.partitionBy("tree").orderBy("path")).alias("place"))


def climbed_roots(nodes: DataFrame) -> DataFrame:
    """(tree, id, root): where climbing from each node ends; ``nodes``: tree, id, parent.

    At a node without a parent, at a parent id that no node has, or where the way meets itself again: the nearest node
    of the cycle, which is the node itself if it is on it.  Of several parents of a node the least counts.

    A row for each node says where it is after 1, 2, 4, ... steps.  Ways that stay open lead to cycles: once a round meets
    as many places as the one before, the steps permute these, so they are the cycles' nodes, where a second climb ends.
    """
    up = nodes.groupBy("tree", "id").agg(F.min("parent").alias("up"))
    way = saved_large(up.select("tree", "id", F.coalesce("up", "id").alias("at"), F.col("up").isNotNull().alias("open")), "way")
    before = None
    while True:
        n, places = way.where("open").agg(F.count("*"), F.countDistinct("tree", "at")).first()
        if n == 0:
            return way.select("tree", "id", F.col("at").alias("root"))
        if places == before:
            break
        before, way = places, saved_large(_twice(way), "way")
    lost = way.where("open").select("tree", "id", "at")
    cycles = saved_large(lost.select("tree", F.col("at").alias("id")).distinct(), "cycles")
    first = up.join(lost.select("tree", "id"), ["tree", "id"], "left_semi").join(cycles.withColumn("on", F.lit(True)), ["tree", "id"], "left")
    found = saved_large(first.select("tree", "id", F.when(F.col("on"), F.col("id")).otherwise(F.col("up")).alias("at"), F.col("on").isNull().alias("open")), "found")
    while not found.where("open").isEmpty():
        found = saved_large(_twice(found), "found")
    return way.where("not open").select("tree", "id", F.col("at").alias("root")).unionByName(found.select("tree", "id", F.col("at").alias("root")))


def _twice(way: DataFrame) -> DataFrame:
    """Ways (tree, id, at, open) of twice as many steps; one ends at an id that no node has."""
    on = way.select("tree", F.col("id").alias("at"), F.col("at").alias("next"), F.col("open").alias("more"))
    far = way.where("open").join(on, ["tree", "at"], "left").select("tree", "id", F.coalesce("next", "at").alias("at"), F.coalesce("more", F.lit(False)).alias("open"))
    return way.where("not open").unionByName(far)
