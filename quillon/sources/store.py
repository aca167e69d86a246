"""Keyed tables as appended batches: skills, graphs, vectors, cached values and a ledger of finished work.

A write or a deletion appends one batch; readers take the last batch of each key. Nothing is rewritten but by ``compact``,
so a lost executor costs a repeated task, and a writer that fails leaves the table as it was. One writer at a time.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quillon.functions.text import file_slug
from quillon.operators.skills import markdown

_TEXTS = "array<string>"
SKILL = (
    f"id string, knowledge_ids {_TEXTS}, book_id string, source_book string, source_chapters {_TEXTS}, name string, description string, version string, "
    f"examples array<struct<title:string,code:string>>, best_practices {_TEXTS}, pitfalls {_TEXTS}, workflow array<struct<title:string,description:string>>, "
    f"checklist {_TEXTS}, references {_TEXTS}, tags {_TEXTS}, category string, related_skills {_TEXTS}, status string, score int, quality_score double, "
    f"review_feedback string, review_notes {_TEXTS}, created_at timestamp, updated_at timestamp"
)
NODE = f"graph_id string, id string, name string, category string, tags {_TEXTS}, description string, created_at timestamp"
EDGE = "graph_id string, source string, target string, type string, weight double"
VECTOR = "id string, source_type string, text string, vector array<double>"
VALUE = "key string, value string, expires_at timestamp"
ERROR = "file_hash string, file_name string, stage string, error string"
LEDGER = "file_hash string, stage string, settings string"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    at, fs = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def remove_folder(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


class KeyedTable:
    """Rows by key in a folder of batches. Columns that a write lacks are null; columns outside the schema are left out."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = StructType.fromDDL(schema)

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        path, fs = self._folder()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and fs.exists(done(f"{self.path}/{n}/_SUCCESS")))

    def _append(self, rows: DataFrame, deleted: bool) -> int:
        have = set(rows.columns)
        cells = [(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in self.schema]
        batch = max([time.time_ns(), *(b + 1 for b in self._batches())])
        rows.select(*cells, F.lit(deleted).alias("_deleted")).write.parquet(f"{self.path}/batch={batch}")
        return batch

    def save(self, rows: DataFrame) -> None:
        """Insert or replace. Of repeated keys in one write, any one row is kept."""
        self._append(rows.dropDuplicates(list(self.keys)), False)

    def delete(self, where: Column) -> int:
        """Delete matching rows; returns how many there were."""
        gone = self.current().where(where).select(*self.keys)
        number = gone.count()
        if number:
            self.remove(gone)
        return number

    def remove(self, rows: DataFrame) -> None:
        """Delete the keys of ``rows``."""
        self._append(rows.select(*self.keys), True)

    def current(self) -> DataFrame:
        """The last version of every key that is not deleted."""
        batches = self._batches()
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        raw = self.spark.read.schema(StructType.fromDDL(f"{self.schema.toDDL()}, _deleted boolean")).option("basePath", self.path)
        rows = raw.parquet(*[f"{self.path}/batch={b}" for b in batches])
        if len(batches) == 1:
            return rows.where("NOT _deleted").select(*self.schema.names)
        # the last batch of each key is found on keys alone; other columns aren't sorted or aggregated
        last = rows.groupBy(*self.keys).agg(F.max("batch").alias("_last"))
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"l.{k}")) for k in self.keys]
        kept = rows.alias("n").join(last.alias("l"), [*same, F.col("n.batch") == F.col("l._last")], "left_semi")
        return kept.where("NOT _deleted").select(*self.schema.names)

    def get(self, key: str) -> Row | None:
        return self.current().where(F.col(self.keys[0]) == key).first()

    def exists(self, key: str) -> bool:
        return self.get(key) is not None

    def count(self) -> int:
        return self.current().count()

    def clear(self) -> None:
        path, fs = self._folder()
        fs.delete(path, True)

    def compact(self) -> None:
        """Rewrite the current rows as one batch and remove those before it."""
        old = self._batches()
        if len(old) > 1:
            self._append(self.current(), False)
            path, fs = self._folder()
            for b in old:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={b}"), True)

    def stats(self) -> DataFrame:
        """Files and bytes on disk, and rows."""
        path, fs = self._folder()
        use = fs.getContentSummary(path) if fs.exists(path) else None
        return self.spark.createDataFrame([(use.getFileCount() if use else 0, use.getLength() if use else 0, self.count())], "files long, bytes long, rows long")


class Skills(KeyedTable):
    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, SKILL, ("id",))

    def save(self, rows: DataFrame) -> None:
        """As for any table; the time of change is set, that of creation where there is none yet."""
        created = F.coalesce("created_at", F.current_timestamp()) if "created_at" in rows.columns else F.current_timestamp()
        super().save(rows.withColumns({"created_at": created, "updated_at": F.current_timestamp()}))


class Graphs:
    """Named graphs: their nodes in one table and their edges in another, both by the graph's id."""

    def __init__(self, spark: SparkSession, root: str):
        self.nodes = KeyedTable(spark, f"{root}/nodes", NODE, ("graph_id", "id"))
        self.edges = KeyedTable(spark, f"{root}/edges", EDGE, ("graph_id", "source", "target", "type"))

    def save(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Add or replace nodes and edges; nodes without a time of creation get that of now."""
        created = F.coalesce("created_at", F.current_timestamp()) if "created_at" in nodes.columns else F.current_timestamp()
        self.nodes.save(nodes.withColumn("created_at", created))
        self.edges.save(edges)

    def list(self, limit: int | None = 10, offset: int = 0) -> DataFrame:
        """``(graph_id, nodes, edges, created_at)``, the last made first."""
        made = self.nodes.current().groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"), F.min("created_at").alias("created_at"))
        tied = self.edges.current().groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))
        found = made.join(tied, "graph_id", "left").select("graph_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "created_at").orderBy(F.desc("created_at"), "graph_id").offset(offset)
        return found if limit is None else found.limit(limit)

    def load(self, graph_id: str) -> tuple[DataFrame, DataFrame] | None:
        """The nodes and edges of one graph; None if there is no such graph."""
        nodes = self.nodes.current().where(F.col("graph_id") == graph_id)
        return (nodes, self.edges.current().where(F.col("graph_id") == graph_id)) if nodes.limit(1).count() else None

    def delete(self, graph_id: str) -> bool:
        """Delete one graph; whether there was one."""
        self.edges.delete(F.col("graph_id") == graph_id)
        return self.nodes.delete(F.col("graph_id") == graph_id) > 0


class Values(KeyedTable):
    """Cached texts by key, each for a number of hours."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, VALUE, ("key",))
        self.hits = self.misses = 0

    def put(self, rows: DataFrame, hours: float = 168) -> None:
        until = F.timestamp_micros(F.unix_micros(F.current_timestamp()) + F.lit(int(hours * 3_600_000_000)).cast("long"))
        self.save(rows.withColumn("expires_at", until))

    def invalidate(self, key: str) -> bool:
        """Forget a key; whether it was there."""
        return self.delete(F.col("key") == key) > 0

    def get_or_compute(self, key: str, work: Callable[[], str], hours: float = 168) -> str:
        """The valid value of a key, else that of ``work``, which is kept."""
        known = self.valid().where(F.col("key") == key).first()
        if known:
            self.hits += 1
            return known["value"]
        self.misses += 1
        value = work()
        self.put(self.spark.createDataFrame([(key, value)], "key string, value string"), hours)
        return value

    def valid(self) -> DataFrame:
        return self.current().where("expires_at > current_timestamp() AND value IS NOT NULL").select("key", "value")


def read_json(spark: SparkSession, folder: str) -> DataFrame:
    """Skills from one JSON file each; broken files are skipped, missing lists and texts get defaults."""
    schema = StructType.fromDDL(f"{SKILL}, _broken string")
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(folder)
    filled = {}
    for f in StructType.fromDDL(SKILL):
        if f.dataType.typeName() == "array":
            filled[f.name] = F.coalesce(f.name, F.array().cast(f.dataType))
        elif f.dataType.typeName() == "string" and f.name != "id":
            filled[f.name] = F.coalesce(f.name, F.lit({"version": "1.0.0", "status": "draft"}.get(f.name, "")))
    return rows.where("_broken IS NULL AND id IS NOT NULL").drop("_broken").withColumns(filled)


def file_names(skills: DataFrame, longest: int | None = None) -> DataFrame:
    """``skills`` with ``file_name``: the name's slug, the id where that is empty, both where several share a slug.

    With ``longest``, the name itself cut at so many characters, without hyphens at its end; of those that share one the last by id remains, and
    records without a name are left out.
    """
    if longest is not None:
        short = skills.where("name <> ''").withColumn("file_name", F.regexp_replace(F.substring("name", 1, longest), "-+$", ""))
        last = short.groupBy("file_name").agg(F.max("id").alias("id"))
        return short.join(last, ["file_name", "id"], "left_semi")
    slug = file_slug(F.coalesce("name", F.lit("")))
    base = skills.withColumn("_slug", F.when(slug == "", F.col("id")).otherwise(slug))
    rank = F.row_number().over(Window.partitionBy("_slug").orderBy("id"))
    return base.withColumn("file_name", F.when(rank > 1, F.concat_ws("-", "_slug", "id")).otherwise(F.col("_slug"))).drop("_slug")


def export_markdown(skills: DataFrame, folder: str, longest: int | None = None) -> int:
    """One ``<file_name>.md`` a record in a folder that all executors share; returns their number.

    A file is written beside its place and moved there, so a repeated task leaves the same files.
    """

    def write(rows: Iterator[Row]) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = f"{folder}/.{r['file_name']}.{os.getpid()}"
            with open(part, "w", encoding="utf-8") as f:
                f.write(r["markdown"])
            os.replace(part, f"{folder}/{r['file_name']}.md")

    named = file_names(skills, longest)
    named.select("file_name", markdown(named).alias("markdown")).foreachPartition(write)
    return skills.count()
