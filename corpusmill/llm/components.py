"""Connected components of an edge table by alternating large-star and small-star steps, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import written_table


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the least node of its component) for every node of ``edges`` (``a, b``).

    Each step is an aggregation by node, so a node with very many neighbours is summed up before it is
    shuffled; the sums are written before they are joined, so that the edges of such a node can be split
    there. The number of steps grows with the logarithm of the longest path.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    links = written_table(links)
    while True:
        side = lambda node, other, up: links.select(F.col(node).alias("node"), F.col(other).alias("other"), F.lit(up).alias("up"))  # noqa: E731, B023
        nodes = side("high", "low", 1).unionByName(side("low", "high", 0)).groupBy("node")
        nodes = written_table(nodes.agg(F.least("node", F.min("other")).alias("least"), F.sum("up").alias("up"), F.min("up").alias("never_low")))
        # stars are left when every node has one lower neighbour and that is no one's higher one
        if nodes.where("up > 1 or (up = 1 and never_low = 0)").isEmpty():
            break
        # large star: neighbours above a node move to its least neighbour
        large = links.join(nodes.select(F.col("node").alias("low"), "least"), "low").select("high", F.col("least").alias("low"))
        # small star: a node and its lower neighbours move to the least of them
        lower = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(lower, "high").select("high", "low", "least")
        moved = small.select(F.col("low").alias("high"), F.col("least").alias("low")).unionByName(lower.select("high", F.col("least").alias("low")))
        links = written_table(moved.where("high <> low").distinct())
    return nodes.select("node", F.col("least").alias("root"))
