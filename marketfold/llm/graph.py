"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

JUMPS = 2


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b); root is the least node.

    Each round hooks every node to its least neighbour, shortens the chains, and joins
    edges to the roots found; edges inside a component vanish. Only counts reach the
    driver. No links give no rows; loops and repeated links change nothing.
    """
    edges = save(links.select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        ends = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
        step = ends.groupBy("node").agg(F.min("other").alias("other")).select(
            "node", F.least("node", "other").alias("root"))
        step = save(step, "hooks")
        for _ in range(JUMPS):
            over = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
            step = step.join(over, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        step = save(step, "roots")
        if labels is None:
            labels = step
        else:
            over = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
            labels = save(labels.join(over, "root", "left").select(
                "node", F.coalesce("further", "root").alias("root")), "labels")
        left, right = step.toDF("a", "ra"), step.toDF("b", "rb")
        edges = save(edges.join(left, "a", "left").join(right, "b", "left")
                     .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
                     .where("a <> b").distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
