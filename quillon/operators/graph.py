"""Connected components by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.lineage import written


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, component being the smallest node.

    Alternates large-star and small-star steps until no edge changes, a number of rounds in proportion to the logarithm of the
    longest chain; every round is written, so a lost executor costs one round at most. No links: an empty table.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = written(small.where("a <> b").distinct(), "edges")
        if _same(now, after):
            break
        now = after
    labels = after.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())


def _same(before: DataFrame, after: DataFrame) -> bool:
    """Whether two edge tables hold the same rows, by count and an order-free digest."""
    digest = [F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))]
    return before.agg(*digest).first() == after.agg(*digest).first()
