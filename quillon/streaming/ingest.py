"""Incremental ingestion: documents stream in, are cleaned and classified, and units are appended once per text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions.clean import cleaned
from quillon.operators.knowledge import units


def documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def start(docs: DataFrame, out: str, checkpoint: str, time: str | None = None, delay: str = "1 hour") -> StreamingQuery:
    """Write units of new texts to ``out``; with a time column, repeats are remembered for ``delay`` only."""
    hashed = docs.withColumn("text_hash", F.sha2("text", 256))
    fresh = hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_hash"]) if time else hashed.dropDuplicates(["text_hash"])

    def write(batch: DataFrame, number: int) -> None:
        found = units(cleaned(batch.select("doc_id", "text"), nfkc=False), ["doc_id"])
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
