"""Keyword and vector search, upserts and incremental skips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import cosine


def keyword(rows: DataFrame, query: str, fields: list[Column], name: Column, key: str, limit: int = 10, lists: tuple[Column, ...] = ()) -> DataFrame:
    """Rows in whose fields every term occurs, by the number of fields with a term plus twice the terms in the name.

    Every text of ``lists`` is a field of its own. Blank queries find nothing.
    """
    terms = query.lower().split()
    if not terms:
        return rows.select(key).limit(0).withColumn("score", F.lit(0).cast("int"))
    texts = F.concat(F.array(*fields), *[F.coalesce(x, F.array().cast("array<string>")) for x in lists]) if lists else F.array(*fields)
    known = rows.withColumn("_fields", F.transform(F.filter(texts, lambda f: F.coalesce(f, F.lit("")) != ""), F.lower)).withColumn("_hay", F.array_join("_fields", " "))
    every, score = F.lit(True), F.lit(0)
    for t in terms:
        every = every & F.col("_hay").contains(t)
        score = score + 2 * F.coalesce(F.lower(name).contains(t).cast("int"), F.lit(0))

    def hit(f: Column) -> Column:
        some = F.lit(False)
        for t in terms:
            some = some | f.contains(t)
        return some

    score = score + F.size(F.filter("_fields", hit))
    return known.where(every).select(key, score.cast("int").alias("score")).orderBy(F.desc("score"), key).limit(limit)


def phrase(rows: DataFrame, wanted: str, fields: list[Column], best: Column, key: str, limit: int = 30) -> DataFrame:
    """Rows with a whole phrase in one of the fields, in any case, best first; a blank phrase finds nothing."""
    low, some = wanted.strip().lower(), F.lit(False)
    for f in fields:
        some = some | F.lower(F.coalesce(f, F.lit(""))).contains(low)
    return rows.where(some if low else F.lit(False)).orderBy(best, key).limit(limit)


def vectors(rows: DataFrame, query: list[float], key: str, vector: str, limit: int = 5) -> DataFrame:
    """Exact cosine search: rows of the query's length, best first, ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.where(F.size(vector) == len(query)).select(key, cosine(F.col(vector), q).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(limit).withColumn("score", F.round("score", 6))


def distance_score(distance: Column, metric: str = "cosine") -> Column:
    """The score of a distance: for cosine what is left of 1, 0 at least, to four places; else its negative."""
    return F.round(F.greatest(F.lit(0.0), 1 - distance), 4) if metric == "cosine" else -distance


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of every key."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return old.unionByName(new).withColumn("_n", last).where("_n = 1").drop("_n")


def unsaved(new: DataFrame, saved: DataFrame, name: str, order: str) -> DataFrame:
    """The first record of every name that isn't saved yet."""
    fresh = new.join(saved.select(name).distinct(), name, "left_anti")
    first = fresh.groupBy(name).agg(F.min(order).alias(order))  # combined before the shuffle
    return fresh.join(first, [name, order], "left_semi")


def unprocessed(books: DataFrame, ledger: DataFrame, stage: str, settings: str) -> DataFrame:
    """Books whose content the ledger doesn't list for a stage under these settings."""
    done = ledger.where((F.col("stage") == stage) & (F.col("settings") == settings)).select("file_hash")
    return books.join(done, "file_hash", "left_anti")
