"""Vectors of texts: dense hash vectors, any other backend as a batch function, and a cache keyed by text and backend."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillon.functions import text as T

#: A backend turns a list of texts into one vector each; it is called once a batch, on executors.
Backend = Callable[[list[str]], list[list[float]]]

#: Rows whose tokens a task counts at once.
ROWS = 2_000

CACHE_SCHEMA = "text_hash string, backend string, dim int, vector array<double>"


def skill_text(name: Column = None) -> Column:
    """What is embedded of a skill record; empty parts keep their place."""
    lists = [F.array_join(c, " ") for c in ("best_practices", "pitfalls", "checklist", "references")]
    return F.concat_ws(" ", F.col("name") if name is None else name, F.col("description"), *lists)


@functools.lru_cache(200_000)
def _place(token: str) -> tuple[int, float]:
    """A number for the bucket and a sign, as in :func:`similar.hashed_vector`."""
    h = hashlib.md5(token.encode()).digest()
    return int.from_bytes(h[:4], "little"), -1.0 if h[4] % 2 else 1.0


def _spread(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Unit vectors of rows of tokens, row by row the sum over its tokens in order of their first place."""
    n = len(lists)
    rows = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    words = lists.flatten().dictionary_encode()
    codes, places = words.indices.to_numpy(), [_place(t) for t in words.dictionary.to_pylist()]
    if not len(codes):
        return np.zeros((n, dim))
    bucket, sign = np.array([p % dim for p, _ in places]), np.array([s for _, s in places])
    _, first, times = np.unique(rows * len(places) + codes, return_index=True, return_counts=True)
    order = np.argsort(first)
    first, times = first[order], times[order]
    roots = np.array([k**0.5 for k in range(times.max() + 1)])
    out = np.bincount(rows[first] * dim + bucket[codes[first]], sign[codes[first]] * roots[times], n * dim).reshape(n, dim)
    for row in out:
        length = np.sqrt(row @ row)
        row /= length if length > 0 else 1.0
    return out


def hashed(text: Column, dim: int = 384) -> Column:
    """The vector of a text by hashing, as :func:`similar.hashed_vector` has it in long form; a text without tokens has the zero vector."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def vectors(tokens: pa.Array) -> pa.Array:
        made = [_spread(tokens.slice(at, ROWS), dim).ravel() for at in range(0, len(tokens), ROWS)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1) * dim, "int32"), pa.array(np.concatenate([np.zeros(0), *made])))

    return vectors(T.tokens(text))


def dense(docs: DataFrame, key: str, text: Column, dim: int = 384) -> DataFrame:
    """``(key, vector)`` by :func:`hashed`. Rows stay where they are."""
    return docs.select(key, hashed(text, dim).alias("vector"))


def encoded(texts: DataFrame, backend: Backend) -> DataFrame:
    """``(text_hash, vector)`` of ``(text_hash, text)`` by a backend, an Arrow batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"text_hash": batch["text_hash"], "vector": backend(batch["text"].tolist()) if len(batch) else []})

    return texts.select("text_hash", "text").mapInPandas(run, "text_hash string, vector array<double>")


def missing(rows: DataFrame, cache: DataFrame, name: str, dim: int) -> DataFrame:
    """Distinct texts ``(text_hash, text)`` without a cached vector of this backend and length."""
    known = cache.where((F.col("backend") == name) & (F.col("dim") == dim)).select("text_hash")
    hashed = rows.select(F.sha2("text", 256).alias("text_hash"), "text")
    return hashed.dropDuplicates(["text_hash"]).join(known, "text_hash", "left_anti")


def embedded(rows: DataFrame, cache: DataFrame, name: str = "hash", dim: int = 384, backend: Backend | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with ``vector``, and the cache rows to add. Each distinct text is computed once; null and blank texts have none.

    The first frame reads ``cache`` and the second, so write the second before relying on either again.
    """
    ready = rows.where(F.trim("text") != "")
    todo = missing(ready, cache, name, dim)
    made = encoded(todo, backend) if backend else dense(todo, "text_hash", F.col("text"), dim)
    fresh = made.select("text_hash", F.lit(name).alias("backend"), F.lit(dim).alias("dim"), "vector")
    every = cache.where((F.col("backend") == name) & (F.col("dim") == dim)).unionByName(fresh).select("text_hash", "vector")
    keyed = rows.withColumn("text_hash", F.when(F.trim("text") != "", F.sha2("text", 256)))
    return keyed.join(every, "text_hash", "left").drop("text_hash"), fresh


def payloads(chunks: DataFrame, skills: DataFrame, chunk_key: str, skill_key: str) -> DataFrame:
    """One table to search: ``(id, source_type, text, vector)`` of the chunks and skills that have a vector."""
    full = F.concat(F.col("name"), F.lit(". "), F.col("description"), F.lit(" "), F.array_join("best_practices", " "))
    a = chunks.where(F.size("vector") > 0).select(F.col(chunk_key).cast("string").alias("id"), F.lit("chunk").alias("source_type"), "text", "vector")
    b = skills.where(F.size("vector") > 0).select(F.col(skill_key).cast("string").alias("id"), F.lit("skill").alias("source_type"), full.alias("text"), "vector")
    return a.unionByName(b)
