"""Connected components of an edge table by alternating star contractions.

A large star hangs every larger neighbour of a node on the node's smallest neighbour, a small star
every smaller one. Paths shorten by a constant factor each round, so rounds grow with the logarithm
of the longest path. Edges stay distributed; only counts reach the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloop.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low"))
    least = least.select("u", F.least("u", "low").alias("low"))
    hung = both.join(least, "u").filter(F.col("v") > F.col("u"))
    return hung.select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``u`` is the larger end of each edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return hung.union(least.select("u", F.col("low").alias("v"))).filter("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the smallest node names a component.

    Loops and repeated edges are allowed; an empty table gives no rows. Every round is written to
    the shared folder, so a lost executor costs at most one round.
    """
    edges = edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).filter("u != v")
    edges = written(edges.distinct(), "edges")
    mark = None
    while True:
        edges = written(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    tops = edges.select(F.col("v").alias("node")).distinct()
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(tops.select("node", F.col("node").alias("component")))
