"""From a folder of files to stored skills, graphs and vectors; and the reads on them.

All new files of a folder go through each stage as one table. Topics, duplicates and relations stay within a book, so
no stage pairs records of different books; a book has at most ``skills_per_book`` records when pairs are formed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import vocabulary as V
from quillon.functions.clean import cleaned
from quillon.functions.text import token_estimate
from quillon.operators import chunk, embed, models, relations, search, similar, skills, topics
from quillon.operators.lineage import written
from quillon.plans import report
from quillon.sources import files, store

#: Files of a run up to which their paths are broadcast.
MOST_FILES = 1_000_000
STAGES = ("extract", "clean", "chunk", "knowledge", "skill_gen", "review", "embed", "dedup", "graph", "store")


@dataclass(frozen=True)
class Settings:
    """What results depend on; a change makes finished files new again."""

    strategy: str = "semantic"
    chunk_words: int = 800
    chunk_least: int = 80
    chunk_overlap: int = 100
    units_per_chunk: int = 10
    least_confidence: float = 0.3
    skills_per_book: int = 50
    dim: int = 384
    provider: str = ""
    small_provider: str = ""
    extractor: str = "direct"
    fallback: bool = True
    types: tuple[str, ...] = V.UNIT_TYPES

    def __post_init__(self):
        if self.chunk_overlap >= self.chunk_words:
            raise ValueError("chunk_overlap must be smaller than chunk_words")
        if self.strategy != "fixed_size" and self.strategy not in chunk.STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.extractor not in files.MODES:
            raise ValueError(f"unknown extractor {self.extractor!r}")
        if unknown := set(self.types) - set(V.UNIT_TYPES):
            raise ValueError(f"unknown types {sorted(unknown)}")

    def fingerprint(self) -> str:
        return ",".join(f"{k}={v}" for k, v in sorted(asdict(self).items()))


class Engine:
    """Stores under ``root``, a folder that driver and executors share.

    ``after`` has own steps, from table to table, that follow a stage; ``scanned`` reads the pages of scans.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), progress: Callable[[str], None] = lambda stage: None, scanned: Callable[[bytes], list[str]] | None = None):
        self.spark, self.root, self.settings, self.progress, self.scanned = spark, root, settings, progress, scanned
        self.log = report.log(store=root)
        self.after: dict[str, list[Callable[[DataFrame], DataFrame]]] = {}
        self.skills = store.Skills(spark, f"{root}/skills")
        self.graphs = store.Graphs(spark, root)
        self.nodes, self.edges = self.graphs.nodes, self.graphs.edges
        self.vectors = store.KeyedTable(spark, f"{root}/vectors", store.VECTOR, ("id", "source_type"))
        self.embeddings = store.KeyedTable(spark, f"{root}/embeddings", embed.CACHE_SCHEMA, ("text_hash", "backend", "dim"))
        self.ledger = store.KeyedTable(spark, f"{root}/ledger", store.LEDGER, ("file_hash", "stage", "settings"))
        self.errors = store.KeyedTable(spark, f"{root}/errors", store.ERROR, ("file_hash", "stage"))
        self.metrics = report.Metrics()

    # Stages: each takes what the one before it made.

    def extract(self, books: DataFrame) -> DataFrame:
        """``(book_id, source_book, text)`` of readable files; pages joined by blank lines, in order. What can't be read is listed in ``errors``."""
        s = self.settings
        every = written(files.read(books, s.extractor, self.scanned, s.fallback), "pages")
        self.errors.save(every.where("error IS NOT NULL").join(books.groupBy("file_hash").agg(F.min("file_name").alias("file_name")), "file_hash").select("file_hash", "file_name", F.lit("extract").alias("stage"), "error"))
        pages = every.where("error IS NULL")
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"])
        text = pages.groupBy("file_hash").agg(F.trim(F.array_join(ordered, "\n\n")).alias("text"))
        named = books.groupBy("file_hash").agg(F.min("file_name").alias("source_book"))
        return text.join(named, "file_hash").select(F.col("file_hash").alias("book_id"), "source_book", "text")

    def chunks(self, docs: DataFrame) -> DataFrame:
        s = self.settings
        if s.strategy == "fixed_size":
            made = chunk.fixed(docs, "book_id", s.chunk_words, s.chunk_overlap)
        else:
            made = chunk.folded(docs, "book_id", s.strategy, s.chunk_words, s.chunk_least, s.chunk_overlap)
        return made.withColumn("chunk_id", F.format_string("%s-%08d", "book_id", "index"))

    def units(self, chunks: DataFrame) -> DataFrame:
        s = self.settings
        make = models.provider(s.provider) if s.provider else None
        small = models.provider(s.small_provider) if s.small_provider else None
        found = models.extracted(chunks, "chunk_id", make, s.least_confidence, s.units_per_chunk, small=small, allowed=s.types)
        return found.withColumn("book_id", F.substring_index("chunk_id", "-", 1)).withColumn("unit_id", F.concat_ws("-", "chunk_id", F.lpad(F.col("ord").cast("string"), 6, "0"))).drop("ord").withColumn("source_reference", F.concat(F.lit("chunk_"), F.substring_index("chunk_id", "-", -1).cast("int")))

    def records(self, units: DataFrame) -> DataFrame:
        """Skills of the topics of each book, at most ``skills_per_book``, those of the most confidence first."""
        within = units.select("unit_id", F.transform("tags", lambda t: F.concat_ws(":", "book_id", t)).alias("tags"))
        grouped = written(units.join(topics.components(within), "unit_id").withColumnRenamed("topic", "id"), "units")
        ranks = grouped.groupBy("id").agg(F.min("book_id").alias("book_id"), F.struct((-F.sum("confidence")).alias("c"), F.min("unit_id").alias("u")).alias("_rank"))
        kept = skills.capped(ranks, "book_id", F.col("_rank"), self.settings.skills_per_book)
        made = skills.records(grouped.join(kept.select("id"), "id", "left_semi"), "id", "unit_id").join(kept, "id")
        if self.settings.provider:
            shown = models.shown_units(grouped.join(kept.select("id"), "id", "left_semi"), "id", "unit_id")
            made = models.built(made.join(shown, "id", "left"), models.provider(self.settings.provider)).drop("shown")
        made = made.where("name <> '' AND description <> ''")
        return skills.unique_names(made.withColumn("_o", F.struct("book_id", "_rank")), "_o", "book_id").drop("_o")

    def reviewed(self, made: DataFrame) -> DataFrame:
        return models.reviewed(made, models.provider(self.settings.provider)) if self.settings.provider else skills.reviewed(made)

    def embedded(self, rows: DataFrame) -> DataFrame:
        """Rows ``(…, text)`` with vectors; new ones go to the cache."""
        out, fresh = embed.embedded(rows, self.embeddings.current(), dim=self.settings.dim)
        out, fresh = written(out, "vectors"), written(fresh, "fresh")
        new = fresh.count()
        self.metrics.count("embed_misses", new)
        self.metrics.count("embed_hits", out.where("vector IS NOT NULL").join(fresh.select("text_hash"), F.sha2("text", 256) == F.col("text_hash"), "left_anti").count())
        self.embeddings.save(fresh)
        return out

    # Runs

    def run(self, folder: str, incremental: bool = True, skip_on_error: bool = False) -> DataFrame:
        """Process a folder's files, all or those not yet done under these settings; returns the skills stored.

        What each stage made is kept until the run ends, so a run that failed goes on where it stopped. With ``skip_on_error``
        a failing stage that only changes rows is left out and the run goes on.
        """
        return self._process(self.pending(folder, incremental), STAGES[-1], skip_on_error)

    def run_file(self, path: str) -> DataFrame:
        """Process one file, done before or not."""
        return self._process(files.books(self.spark, path), STAGES[-1], False)

    def run_stage(self, folder: str, stage: str) -> DataFrame:
        """All stages up to one, over all files of a folder; returns what that one makes. A later run goes on from there."""
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}; one of {', '.join(STAGES)}")
        return self._process(self.pending(folder, False), stage, False)

    def pending(self, folder: str, incremental: bool = True, by_skills: bool = False) -> DataFrame:
        """The files of a folder; if ``incremental`` without those done under these settings, and with ``by_skills`` without those of any stored skill."""
        new = files.books(self.spark, folder)
        if incremental:
            new = search.unprocessed(new, self.ledger.current(), "store", self.settings.fingerprint())
        if by_skills:
            new = new.join(self.skills.current().select(F.col("book_id").alias("file_hash")).distinct(), "file_hash", "left_anti")
        return new

    def _process(self, new: DataFrame, last: str, skip: bool) -> DataFrame:
        first = written(new.groupBy("file_hash").agg(F.min("file_path").alias("file_path")), "files")  # contents aren't shuffled
        new = new.join(F.broadcast(first) if first.count() <= MOST_FILES else first, ["file_hash", "file_path"], "left_semi")
        mark = first.agg(F.sha2(F.concat_ws(",", F.lit(self.settings.fingerprint()), F.count(F.lit(1)).cast("string"), F.sum(F.xxhash64("file_hash").cast("decimal(38,0)")).cast("string")), 256)).first()[0]
        made: dict[str, DataFrame] = {}

        def embed_records() -> DataFrame:
            return self.embedded(made["review"].withColumn("text", embed.skill_text())).drop("text")

        work: dict[str, Callable[[], DataFrame]] = {
            "extract": lambda: self.extract(new), "clean": lambda: cleaned(made["extract"]), "chunk": lambda: self.chunks(made["clean"]), "knowledge": lambda: self.units(made["chunk"]),
            "skill_gen": lambda: self.records(made["knowledge"]), "review": lambda: self.reviewed(made["skill_gen"]), "embed": embed_records,
            "dedup": lambda: self._deduplicated(made["embed"]), "graph": lambda: self._graph(made["dedup"]),
        }
        instead = {"clean": lambda: made["extract"], "dedup": lambda: made["embed"].withColumn("no", F.row_number().over(Window.partitionBy("book_id").orderBy("_rank")).cast("long"))}
        for done, stage in enumerate(STAGES[:-1], 1):
            self.progress(stage)
            made[stage] = self._stage(mark, stage, work[stage], instead.get(stage) if skip else None)
            if stage == "review":
                self._documents(made[stage])
            self.log.info("%s %s", report.bar(done, len(STAGES)), stage)
            if stage == last:
                return made[stage]
        self.progress("store")
        with self.metrics.stage("store") as record:
            out = self._stored(made["clean"], made["chunk"], made["dedup"], made["graph"], new)
            record.items = out.count()
        store.remove_folder(self.spark, f"{self.root}/runs/{mark}")
        return out

    def _stage(self, mark: str, stage: str, work: Callable[[], DataFrame], instead: Callable[[], DataFrame] | None) -> DataFrame:
        """A stage's table, from an earlier attempt of the same run if it was finished there; the engine's own steps after a stage belong to it."""
        path = f"{self.root}/runs/{mark}/{stage}"
        try:
            with self.metrics.stage(stage) as record:
                record.restored = store.finished(self.spark, path)
                if not record.restored:
                    out = work()
                    for step in self.after.get(stage, []):
                        out = out.transform(step)
                    out.write.mode("overwrite").parquet(path)
                out = self.spark.read.parquet(path)
                tokens = F.sum(token_estimate(F.col("text"))) if "text" in out.columns else F.lit(0)
                record.items, record.tokens = out.agg(F.count(F.lit(1)), F.coalesce(tokens, F.lit(0))).first()
                return out
        except Exception as problem:
            self.log.error("%s: %s", stage, problem)
            if instead is None:
                raise
            return instead()

    def _documents(self, made: DataFrame) -> None:
        """A ``markdown/<name>.md`` for every record of a run, also of those that go as duplicates; a run goes on if they can't be written."""
        folder = self.root.removeprefix("file://")
        if "://" not in folder:  # files need a folder that is mounted on the executors
            try:
                store.export_markdown(made, f"{folder}/markdown", 200)
            except Exception as problem:
                self.log.error("markdown: %s", problem)

    def _deduplicated(self, made: DataFrame) -> DataFrame:
        numbered = made.withColumn("no", F.row_number().over(Window.partitionBy("book_id").orderBy("_rank")).cast("long"))
        return similar.merged(numbered, relations.survivors(numbered, "book_id", "no"), "book_id", "no")

    def _graph(self, kept: DataFrame) -> DataFrame:
        found = similar.edges(kept, "book_id", "no")
        ids = kept.select("book_id", "no", "id")
        for side in ("source", "target"):
            found = found.join(ids.select("book_id", F.col("no").alias(side), F.col("id").alias(f"_{side}")), ["book_id", side])
        return found.select(F.col("book_id").alias("graph_id"), F.col("_source").alias("source"), F.col("_target").alias("target"), "type", "weight")

    def _stored(self, docs: DataFrame, parts: DataFrame, kept: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
        out = kept.join(docs.select("book_id", "source_book"), "book_id")
        done = written(docs.select("book_id").distinct(), "done")
        for table, column in ((self.skills, "book_id"), (self.nodes, "graph_id"), (self.edges, "graph_id")):  # earlier results of the same files
            table.remove(table.current().join(done.withColumnRenamed("book_id", column), column, "left_semi"))
        out = written(search.unsaved(out.withColumn("_o", F.struct("book_id", "no")), self.skills.current(), "name", "_o").drop("_o"), "new")  # a name is stored once
        self.skills.save(out)
        self.graphs.save(kept.select(F.col("book_id").alias("graph_id"), "id", "name", "category", "tags", F.substring("description", 1, 200).alias("description")), edges)
        self.vectors.save(embed.payloads(self.embedded(parts), kept, "chunk_id", "id"))
        self.ledger.save(done.select(F.col("book_id").alias("file_hash"), F.lit("store").alias("stage"), F.lit(self.settings.fingerprint()).alias("settings")))
        return self.skills.current().join(done, "book_id", "left_semi")

    # Reads

    def list_books(self, folder: str) -> DataFrame:
        return files.books(self.spark, folder).drop("content").orderBy("file_name")

    def list_skills(self, category: str = "", status: str = "", tags: list[str] | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
        return skills.listed(self.skills.current(), category, status, tags, limit, offset, (F.desc("updated_at"), F.col("id")))

    def search(self, query: str, limit: int = 10) -> DataFrame:
        fields, lists = skills.searched()
        return search.keyword(self.skills.current(), query, fields, F.col("name"), "id", limit, lists)

    def similar_to(self, text: str, limit: int = 5, source_type: str = "") -> DataFrame:
        """Exact vector search for a text among chunks and skills."""
        asked = self.spark.createDataFrame([(0, text)], "id int, text string")
        vector = embed.dense(asked, "id", F.col("text"), self.settings.dim).first()["vector"]
        rows = self.vectors.current()
        return search.vectors(rows.where(F.col("source_type") == source_type) if source_type else rows, vector, "id", "vector", limit)

    def stats(self) -> DataFrame:
        return skills.stats(self.skills.current().withColumn("_source", F.coalesce(F.nullif("source_book", F.lit("")), "book_id")), "_source")

    def settings_table(self) -> DataFrame:
        return self.spark.createDataFrame([(k, str(v)) for k, v in asdict(self.settings).items()], "setting string, value string")

    def report(self) -> DataFrame:
        return self.metrics.table(self.spark)

    def histogram(self, column: str) -> DataFrame:
        return skills.histogram(self.skills.current(), column)

    def export_markdown(self, folder: str, longest: int | None = None) -> int:
        return store.export_markdown(self.skills.current(), folder, longest)
