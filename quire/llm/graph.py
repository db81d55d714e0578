"""Connected components by alternating large and small stars, each round kept in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, release


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component): every node that has an edge, with the smallest node that it can reach.

    A node's least neighbour is found by a partial aggregate and joined back, so a hub's edges are never gathered.
    Edges of a null or to the node itself say nothing and are left out. The number of rounds grows with the logarithm
    of the longest path.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u > v").distinct()
    e = checkpointed(e)
    mark = _mark(e)
    while mark[0]:
        # Large star: each neighbour above a node is linked to the node's least neighbour.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each neighbour below a node, and the node, are linked to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        e = checkpointed(small)
        del both, least, large, small
        release(e.sparkSession)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(v as decimal(38, 0)))")).first())
