"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeboard.session import shared_dir


def _least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Every node's neighbours, itself included, tied to the least of them: one star step.

    The large star moves the neighbours beyond the node, the small star those before it.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    kept = both if larger_only else both.filter("b < a")
    least = kept.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    near = both.filter("b > a") if larger_only else kept
    moved = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger_only:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; a component is named by its least node.

    Alternating stars: neighbours are tied to the least node around, until every
    edge leads to the least node of its component.  A chain of n nodes takes
    about log n rounds; each is checkpointed.  A node with very many edges is
    reduced by partial aggregates, and its join is split by adaptive execution.
    """
    shared_dir(edges.sparkSession)
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    while True:
        step = _least(_least(now, True), False).checkpoint()
        same = step.join(now, ["a", "b"], "left_anti").isEmpty() and now.join(step, ["a", "b"], "left_anti").isEmpty()
        now = step
        if same:
            break
    nodes = edges.select("a").union(edges.select("b")).distinct().toDF("node")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
