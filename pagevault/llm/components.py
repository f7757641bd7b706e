"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagevault.llm.frames import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of its neighbourhood. Edges are (larger, smaller), each once."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of these. Takes and gives edges (larger, smaller); gives each once."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    ties = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return ties.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of an edge (columns a and b, longs): label is the smallest node of its component.

    Takes a number of rounds logarithmic in the number of nodes. Every round is written to the shared folder, so lost executors
    cost one round at most. Nodes without an edge to another node are left out.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        stats = now.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(a, b) as decimal(20, 0)))")).first()
        if stats == mark or stats[0] == 0:  # a round that changes nothing leaves stars only
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        mark = stats
        now = written(_small_star(_large_star(now)))
