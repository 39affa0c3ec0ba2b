"""Connected components by contraction: every node hooks to its smallest neighbour, edges follow.

A round is a minimum per node (summed up on the map side) and joins of edges with it. A hub with
a third of all edges is one aggregation key and otherwise a join key that adaptive execution
may split. Edges between nodes of one component vanish, so rounds grow with the logarithm of
the longest path and stop when no edge is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.base import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b); ``root`` names the component."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    edges = scratch.settle(f"{name}-edges-0", edges)
    both = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = scratch.settle(f"{name}-labels-0", both.select("node", F.col("node").alias("root")))
    step = 0
    while not edges.isEmpty():
        step += 1
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = ends.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up"))
        hooks = scratch.settle(f"{name}-hooks-{step}", hooks)
        second = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
        tops = scratch.settle(f"{name}-tops-{step}", hooks.join(second, "up").select("node", "top"))
        left = tops.select(F.col("node").alias("a"), F.col("top").alias("ta"))
        right = tops.select(F.col("node").alias("b"), F.col("top").alias("tb"))
        edges = edges.join(left, "a").join(right, "b").where(F.col("ta") != F.col("tb"))
        edges = edges.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        edges = scratch.settle(f"{name}-edges-{step}", edges)
        moved = tops.select(F.col("node").alias("root"), "top")
        labels = labels.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        labels = scratch.settle(f"{name}-labels-{step}", labels)
    return labels
