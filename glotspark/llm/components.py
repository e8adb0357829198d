"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved


def _stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (u, v) is either the end v of edges or the start u of one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR ups > 0 AND least = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node that links reach.

    Alternates large-star and small-star steps until only stars are left: the number of rounds grows with the logarithm
    of the number of nodes, and each round moves at most one row for each link. A node with
    very many links has its minimum pre-aggregated before the shuffle; the join that hands
    it back out is one that Spark splits when skewed. Every round is a table in the shared
    folder.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    while not _stars(edges):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        # Large star: neighbours above a node go to the smallest of its neighbourhood.
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its neighbours below it go to the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = saved(small, "cc")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select("v", "v").distinct())
