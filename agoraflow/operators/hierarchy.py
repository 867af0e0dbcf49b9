"""Trees of replies and closure tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reply_tree(rows: DataFrame, node: str, parent: str, scope: list[str], order: list[str], max_depth: int = 1000) -> DataFrame:
    """rows that a root reaches, with depth, path, has_children and position in pre-order within their scope.

    A parent that is not in the same scope makes its child a root. Rows in cycles are reached by no root and vanish.
    Replies deeper than max_depth raise an error. Levels are joined one after the other, so a level costs one join whatever its width; siblings are in `order`.
    """
    keys = [*scope]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    base = rows.withColumn("_place", place)
    ids = base.select(*keys, F.col(node).alias("_parent")).distinct()
    linked = base.withColumn("_up", F.col(parent)).join(ids.withColumn("_known", F.lit(True)).withColumnRenamed("_parent", "_up"), [*keys, "_up"], "left")
    linked = linked.withColumn("_up", F.when(F.col("_known"), F.col("_up"))).drop("_known")
    level = linked.where(F.col("_up").isNull()).withColumns({"depth": F.lit(0), "path": F.array("_place")})
    out = level
    for depth in range(1, max_depth + 1):
        above = level.select(*keys, F.col(node).alias("_up"), F.col("path").alias("_path"))
        level = linked.join(above, [*keys, "_up"]).withColumns({"depth": F.lit(depth), "path": F.concat("_path", F.array("_place"))}).drop("_path")
        if depth % 8 == 0:
            level = level.checkpoint()
        if level.isEmpty():
            break
        out = out.unionByName(level)
    else:
        if not linked.join(level.select(*keys, F.col(node).alias("_up")), [*keys, "_up"], "left_semi").isEmpty():
            raise ValueError(f"replies go deeper than max_depth={max_depth}")
    children = linked.where(F.col("_up").isNotNull()).select(*keys, F.col("_up").alias(node)).distinct().withColumn("has_children", F.lit(True))
    out = out.join(children, [*keys, node], "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))
    return out.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy("path"))).drop("_place", "_up")


def reply_tree_sql(view: str, scope: str, node: str, parent: str, place: str) -> str:
    """The same as one recursive query, for depths within the session's recursion limit."""
    return f"""
    WITH RECURSIVE t AS (
      SELECT r.{scope}, r.{node}, 0 AS depth, array(r.{place}) AS path FROM {view} r
      LEFT ANTI JOIN {view} p ON r.{scope} = p.{scope} AND r.{parent} = p.{node}
      UNION ALL
      SELECT r.{scope}, r.{node}, t.depth + 1, concat(t.path, array(r.{place})) FROM t JOIN {view} r ON r.{scope} = t.{scope} AND r.{parent} = t.{node})
    SELECT * FROM t"""


def closing_tags(tree: DataFrame, scope: list[str]) -> DataFrame:
    """How many open levels end after each row of a tree in pre-order."""
    after = F.lead("depth").over(W.partitionBy(*scope).orderBy("position"))
    d = F.col("depth")
    return tree.withColumn("closes", F.when(after.isNull(), d + 1).when(after > d, 0).otherwise(d - after + 1))


def closure(edges: DataFrame, nodes: DataFrame, node: str = "node", max_depth: int = 1000) -> DataFrame:
    """(ancestor, descendant, depth) with a row of depth 0 for each node; edges have parent and child.

    Paths double in length with every round, so the rounds are the logarithm of the depth; they end when no pair is new, and
    raise an error where pairs are left beyond max_depth.
    """
    known = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("depth"))
    reach = 1
    while True:
        a, b = known.alias("a"), known.alias("b")
        longer = a.join(b, F.col("a.descendant") == F.col("b.ancestor")).select("a.ancestor", "b.descendant", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        grown = known.unionByName(longer).groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth")).checkpoint()
        if grown.count() == known.count():
            break
        if reach >= max_depth:
            raise ValueError(f"paths are longer than max_depth={max_depth}")
        known, reach = grown, 2 * reach
    own = nodes.select(F.col(node).alias("ancestor"), F.col(node).alias("descendant"), F.lit(0).alias("depth"))
    return own.unionByName(known)


def direct_children(pairs: DataFrame) -> DataFrame:
    """(parent, child): descendants with exactly one proper ancestor among the parent and its descendants."""
    proper = pairs.where("ancestor <> descendant")
    a, b, c = pairs.alias("a"), proper.alias("b"), proper.alias("c")
    # c: descendant of the parent; b: a proper ancestor of it that is the parent or below the parent
    met = c.join(b, F.col("b.descendant") == F.col("c.descendant")).join(a, (F.col("a.ancestor") == F.col("c.ancestor")) & (F.col("a.descendant") == F.col("b.ancestor")))
    counted = met.groupBy(F.col("c.ancestor").alias("parent"), F.col("c.descendant").alias("child")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n = 1").select("parent", "child")


def inserted(pairs: DataFrame, new, parent) -> DataFrame:
    """pairs with a new leaf below parent: its own row and one for each ancestor of the parent."""
    above = pairs.where(F.col("descendant") == parent).select("ancestor", F.lit(new).alias("descendant"))
    own = pairs.sparkSession.createDataFrame([(new, new)], above.schema)
    return pairs.select("ancestor", "descendant").unionByName(above).unionByName(own)


def removed(pairs: DataFrame, node) -> DataFrame:
    """pairs without the node; what was below it is not moved."""
    return pairs.where((F.col("ancestor") != node) & (F.col("descendant") != node))


def include_path(pairs: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Each node with the names of its ancestors and itself in order of their keys, joined by /."""
    held = pairs.join(names.select(F.col(key).alias("ancestor"), F.col(name).alias("_name")), "ancestor")
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ancestor", "_name"))), lambda s: s["_name"]), "/")
    return held.groupBy("descendant").agg(path.alias("path"))
