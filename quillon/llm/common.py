"""Helpers that the training-data operators share: table access, scratch tables, bounded joins, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows below which the ids of one side of a join are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows of whole texts that go to a Python worker at once; more rows only cost memory outside the heap.
BATCH_ROWS = 512

_local_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; without it a temporary one on a local master, and an error elsewhere."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local_scratch:
        folder = tempfile.TemporaryDirectory(prefix="quillon-")
        atexit.register(folder.cleanup)
        _local_scratch.append(f"file://{folder.name}")
    return _local_scratch[0]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/quillon/{uuid.uuid4().hex}-{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when the counted number of narrow rows is within ``BROADCAST_ROWS``; otherwise leave the shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows, for operators that hand whole texts to Python.

    Results don't depend on it. It stays lowered, since a returned table is planned only when it is used.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def with_text(df: DataFrame) -> DataFrame:
    """The table's doc_id and text alone, so that further columns cannot clash."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, component being the smallest node.

    Alternates large-star and small-star steps until no edge changes; every round is written to the
    shared folder, so a lost executor costs one round at most. No links: an empty table.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = materialise(small.where("a <> b").distinct(), "edges")
        if _same(now, after):
            break
        now = after
    labels = after.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())


def _same(before: DataFrame, after: DataFrame) -> bool:
    """Whether two edge tables hold the same rows, by count and an order-free digest."""
    digest = [F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))]
    return before.agg(*digest).first() == after.agg(*digest).first()
