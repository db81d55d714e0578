"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.scratch import shared_folder


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each linked node with the least node that it can reach, itself included.

    Every round tells each node the least node known to its neighbours, by partial minima and not by gathering them, and
    then follows what that node itself knows, so distances halve and the rounds grow with the logarithm of the longest
    path. Each round is kept in the checkpoint folder.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = kept(one.union(one.select("v", "u")).distinct())
    label = kept(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    while True:
        seen = both.join(label, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("m"))
        near = label.join(seen, F.col("node") == F.col("u"), "left").select("node", F.col("component").alias("before"), F.least("component", F.coalesce("m", "component")).alias("m"))
        far = label.select(F.col("node").alias("m"), F.col("component").alias("further"))
        now = kept(near.join(far, "m", "left").select("node", "before", F.least("m", F.coalesce("further", "m")).alias("component")))
        if not now.where("component <> before").limit(1).count():
            return now.select("node", "component")
        label = now.select("node", "component")
