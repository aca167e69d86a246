"""Persisted indexes: words to rows for keyword search, lists around centroids for vector search.

Both are Parquet folders of batches that any number of readers share. A batch is added as a whole; of rows of one key the last batch counts.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import dot, norm

#: Folders that a batch's words are dealt to by hash, and words whose folders are told one by one; beyond that all are read.
BUCKETS, MOST_WORDS = 64, 10_000
#: Rows that centroids are learned from at most, rows of them that are asked when probes are set, and rows of a list that one task takes.
SAMPLE, ASKED, CHUNK = 20_000, 200, 4_096
#: Queries whose scores a task holds at once, scores of rows against centroids, and queries of a list that one task takes.
STEP, SCORES, QUERIES = 64, 500_000, 8_192


class TermIndex:
    """Which words stand in which field of which row; answers as :func:`search.keyword` does, without reading texts.

    A query's term is found where it is part of a word, so the words that occur, far fewer than the texts, are looked through, and of
    the rest only the folders that hold matching words are read.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: str = "string"):
        self.spark, self.path, self.key_type = spark, path.rstrip("/"), key_type

    def add(self, rows: DataFrame, key: str, fields: list[Column], name: Column, lists: tuple[Column, ...] = ()) -> None:
        """Index rows as one batch; rows of keys that are known replace them. Empty fields count for nothing; repeated keys of a batch count as one row."""
        batch = time.time_ns()
        texts = F.concat(F.array(*fields), *[F.coalesce(x, F.array().cast("array<string>")) for x in lists]) if lists else F.array(*fields)
        parts = F.concat(F.array(F.struct(F.lit(-1).alias("part"), name.cast("string").alias("text"))), F.transform(texts, lambda t, i: F.struct(i.alias("part"), t.alias("text"))))
        each = rows.select(F.col(key).cast(self.key_type).alias("key"), F.explode(parts).alias("p")).where("p.text IS NOT NULL")
        words = each.select("key", "p.part", F.explode(F.array_distinct(F.filter(F.split(F.lower("p.text"), r"\s+"), lambda w: w != ""))).alias("word"))
        placed = words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)))
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        self._read("postings").where(F.col("batch") == batch).select("word", "bucket").distinct().write.parquet(f"{self.path}/words/batch={batch}")
        rows.select(F.col(key).cast(self.key_type).alias("key")).distinct().write.parquet(f"{self.path}/keys/batch={batch}")

    def _read(self, part: str, below: str = "") -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{part}").parquet(f"{self.path}/{part}{below}")

    def matching(self, terms: list[str]) -> DataFrame:
        """Words that have a term in them: ``(word, bucket, t0, t1, …)``."""
        hits = [F.col("word").contains(t).alias(f"t{i}") for i, t in enumerate(terms)]
        some = hits[0]
        for t in terms[1:]:
            some = some | F.col("word").contains(t)
        return self._read("words").where(some).select("word", "bucket", *hits).distinct()

    def postings(self, found: DataFrame) -> DataFrame | None:
        """The postings in the folders of the words found; None if there are none."""
        words = found.limit(MOST_WORDS + 1).select("bucket").collect()
        if not words:
            return None
        if len(words) > MOST_WORDS:
            return self._read("postings")
        buckets = sorted({r["bucket"] for r in words})
        return self._read("postings", f"/batch=*/bucket={{{','.join(map(str, buckets))}}}")

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """``(key, score)`` of the rows in whose fields every term occurs, by the fields with a term plus twice the terms in the name."""
        terms = query.lower().split()
        found = self.matching(terms) if terms else None
        postings = self.postings(found) if terms else None
        if postings is None:
            return self.spark.createDataFrame([], f"key {self.key_type}, score int")
        hits = postings.join(found.drop("bucket"), "word")
        here = F.col("part") >= 0
        seen = [F.max(F.col(f"t{i}") & here).alias(f"f{i}") for i in range(len(terms))] + [F.max(F.col(f"t{i}") & ~here).cast("int").alias(f"n{i}") for i in range(len(terms))]
        rows = hits.groupBy("key", "batch").agg(F.count_distinct(F.when(here, F.col("part"))).alias("fields"), *seen)
        for i in range(len(terms)):
            rows = rows.where(f"f{i}")
        last = self._read("keys").groupBy("key").agg(F.max("batch").alias("batch"))
        score = F.col("fields") + 2 * sum((F.col(f"n{i}") for i in range(len(terms))), F.lit(0))
        return rows.join(last, ["key", "batch"], "left_semi").select("key", score.cast("int").alias("score")).orderBy(F.desc("score"), "key").limit(limit)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _ranked(a: pd.DataFrame, b: pd.DataFrame, limit: int) -> pd.DataFrame:
    """The ``limit`` rows of ``b`` nearest to each query of ``a``; scores are held of ``STEP`` queries at a time."""
    if not len(a) or not len(b):
        return pd.DataFrame({"query": [], "key": [], "score": []})
    b = b.sort_values("key", ignore_index=True)
    y, keys, out = _unit(np.stack(b["vector"].to_numpy())), b["key"].to_numpy(), []
    for low in range(0, len(a), STEP):
        part = a.iloc[low : low + STEP]
        scores = np.round(_unit(np.stack(part["vector"].to_numpy())) @ y.T, 9)
        best = np.argsort(-scores, axis=1, kind="stable")[:, :limit]
        out.append(pd.DataFrame({"query": np.repeat(part["query"].to_numpy(), best.shape[1]), "key": keys[best.ravel()], "score": np.take_along_axis(scores, best, axis=1).ravel()}))
    return pd.concat(out)


def _slices(batches: Iterator[pd.DataFrame], centroids: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches in slices of so many rows that ``SCORES`` products with the centroids are held at once, and these products."""
    step = max(1, SCORES // max(1, len(centroids)))
    for b in batches:
        for at in range(0, len(b), step):
            part = b.iloc[at : at + step]
            yield part, _unit(np.array(part["vector"].tolist())) @ centroids.T


class VectorIndex:
    """Inverted lists around centroids, by cosine: a search reads the lists nearest to its vector and ranks what they hold exactly.

    Centroids are learned from a sample of about ``SAMPLE`` distinct vectors by hash, all if there are fewer; every row is in a list. How many lists are probed is set on the
    sample, so that ``recall`` of the true neighbours are found there. Vectors without length, or of another length than most, have no list.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.centroids, self.probes = np.zeros((0, 0)), 0

    def build(self, rows: DataFrame, key: str, vector: str, recall: float = 0.95, k: int = 10, lists: int | None = None) -> VectorIndex:
        """Learn centroids and write every row to its list; repeated keys stay repeated."""
        x = F.col(vector).cast("array<double>")
        usual = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = usual["n"] if usual else 0
        known = rows.where((F.size(vector) == dim) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e)) & (norm(x) > 0)).select(F.col(key).alias("key"), x.alias("vector"))
        n = known.count()
        if not n:
            raise ValueError("no vector to index")
        share = math.ceil(1_000_000 * min(1.0, SAMPLE / n))
        points = known.select("vector").where(F.pmod(F.xxhash64("vector"), F.lit(1_000_000)) < share).distinct().toPandas()["vector"].tolist()  # about SAMPLE at most
        unit = _unit(np.array(points, dtype="float64").reshape(len(points), dim))
        unit = unit[np.lexsort(unit.T)] if len(unit) else unit
        lists = min(lists or max(1, round(math.sqrt(n))), 4_096, max(1, len(unit)))
        if lists > 1:
            trained = KMeans(k=lists, seed=7, maxIter=10, featuresCol="f").fit(self.spark.createDataFrame([(u.tolist(),) for u in unit], "v array<double>").select(array_to_vector("v").alias("f")))
            self.centroids = _unit(np.array(trained.clusterCenters()))
        else:
            self.centroids = _unit(unit[:1]) if len(unit) else np.ones((1, dim)) / math.sqrt(dim)
        self.probes = self._calibrated(unit, recall, k)
        centroids = self.centroids

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, scores in _slices(batches, centroids):
                yield part.assign(list=scores.argmax(axis=1).astype("int32"))

        kind = known.schema["key"].dataType.simpleString()
        placed = known.mapInPandas(place, f"key {kind}, vector array<double>, list int")
        placed.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(self.path)
        return self

    def _calibrated(self, unit: np.ndarray, recall: float, k: int) -> int:
        """The fewest lists to probe so that a sample's rows find ``recall`` of their ``k`` nearest in the sample."""
        asked = unit[:ASKED]
        if not len(asked):
            return len(self.centroids)
        true = np.argsort(-(asked @ unit.T), axis=1, kind="stable")[:, :k]
        own = (unit @ self.centroids.T).argmax(axis=1)
        order = np.argsort(-(asked @ self.centroids.T), axis=1, kind="stable")
        depth = np.array([[int(np.flatnonzero(order[i] == own[j])[0]) for j in true[i]] for i in range(len(asked))])
        return next((p for p in range(1, len(self.centroids) + 1) if (depth < p).mean() >= recall), len(self.centroids))

    def probed(self, query: list[float], probes: int | None = None) -> list[int]:
        q = _unit(np.array([query], dtype="float64"))
        return [int(i) for i in np.argsort(-(q @ self.centroids.T)[0], kind="stable")[: probes or self.probes]]

    def rows(self, wanted: list[int]) -> DataFrame:
        """What lists hold; only their folders are read."""
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/list={{{','.join(map(str, wanted))}}}")

    def search(self, query: list[float], limit: int = 5, probes: int | None = None) -> DataFrame:
        """``(key, score)`` of the nearest rows of the probed lists, by exact cosine, ties by key."""
        q = F.array(*[F.lit(float(x)) for x in query])
        present = {r["list"] for r in self.spark.read.parquet(self.path).select("list").distinct().collect()}
        wanted = [i for i in self.probed(query, probes) if i in present]
        if not wanted:
            return self.spark.createDataFrame([], "key long, score double")
        scored = self.rows(wanted).select("key", (dot(F.col("vector"), q) / (norm(F.col("vector")) * norm(q))).alias("score"))
        return scored.orderBy(F.desc("score"), "key").limit(limit).withColumn("score", F.round("score", 6))

    def nearest(self, queries: DataFrame, key: str, vector: str, limit: int = 10, probes: int | None = None) -> DataFrame:
        """``(query, key, score, rank)`` of many queries at once: each goes to its lists, whose chunks answer parts of its queries, both of bounded size; then the best of all remain."""
        centroids, depth = self.centroids, probes or self.probes
        kind = queries.schema[key].dataType.simpleString()

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, scores in _slices(batches, centroids):
                yield part.assign(lists=list(np.argsort(-scores, axis=1, kind="stable")[:, :depth].astype("int32")))

        # a vector is sent to its lists by Spark, row by row; a worker holds it once
        told = queries.select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("vector")).mapInPandas(ask, f"query {kind}, vector array<double>, lists array<int>")
        asked = told.select("query", "vector", F.explode("lists").alias("list"))
        held = self.spark.read.parquet(self.path)
        sizes = held.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
        calls = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
        sizes = F.broadcast(sizes.join(calls, "list"))  # a row for each list
        chunk, part = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("chunks", "parts"))
        held = held.join(sizes, "list").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")).select("key", "vector", "list", "chunk", part.alias("part"))
        asked = asked.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int")).select("query", "vector", "list", chunk.alias("chunk"), "part")
        own = held.schema["key"].dataType.simpleString()

        def answer(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return _ranked(a, b, limit)

        found = asked.groupBy("list", "chunk", "part").cogroup(held.groupBy("list", "chunk", "part")).applyInPandas(answer, f"query {kind}, key {own}, score double")
        by = Window.partitionBy("query").orderBy(F.desc("score"), "key")
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).select("query", "key", F.round("score", 6).alias("score"), "rank")
