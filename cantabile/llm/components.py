"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantabile.llm.common import Shelf, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: links each node's neighbours (large: the larger ones; small: the others) to the least node around it."""
    if large:
        around = edges.union(edges.select("b", "a"))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    linked = around.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """From edges (a, b) to a row (node, root) for every node that has an edge to another; root is the least node reached.

    Each round is written and the one before deleted, the driver sees two numbers a round, and a round's work is joins and
    partial aggregates on the edge table. Self-links and repeated edges make no difference.
    """
    shelf = shelf or Shelf(edges.sparkSession)
    mark = shelf.mark()
    edges = shelf.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        edges = shelf.put(_star(_star(edges, True), False))
        shelf.drop_since(mark, edges)
        release(edges.sparkSession)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
    # every edge now leads to its root; a root has none
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
