"""Language models behind a function from prompt to answer: extraction, building and review, each with a rule to fall back on.

A provider is a factory; it is called once a worker task and gives the function. Answers are written before use, since
another call may answer otherwise.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from quillon.functions import text as T
from quillon.functions import vocabulary as V
from quillon.operators import knowledge, skills
from quillon.operators.lineage import written

Completer = Callable[[str], str]
Provider = Callable[[], Completer]
PROVIDERS: dict[str, Provider] = {}
CATEGORIES = tuple(name for name, _ in V.CATEGORY_KEYWORDS)


def register(name: str, provider: Provider) -> None:
    PROVIDERS[name] = provider


def provider(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; registered: {sorted(PROVIDERS)}")
    return PROVIDERS[name]


def completed(rows: DataFrame, prompt: Column, make: Provider, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """``rows`` with ``response``; a failing call is repeated after growing pauses, then null."""
    out = rows.drop("response").withColumn("_prompt", prompt)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = make()

        def ask(text: str) -> str | None:
            for n in range(tries):
                try:
                    return complete(text)
                except Exception:  # noqa: BLE001  any failure of a provider counts as no answer
                    if n + 1 < tries:
                        time.sleep(wait * 2**n)
            return None

        for batch in batches:
            yield batch.assign(response=[None if p is None else ask(p) for p in batch.pop("_prompt")])

    schema = StructType([*(f for f in rows.schema.fields if f.name != "response"), StructField("response", StringType())])
    return written(out.mapInPandas(run, schema), "answers")


def _answer(fields: str) -> Column:
    return F.from_json(F.regexp_extract("response", r"(?s)(\{.*\})", 1), fields)


def extracted(chunks: DataFrame, key: str, make: Provider | None = None, least: float = 0.3, most: int = 10, longest: int = 4000, small: Provider | None = None, allowed: tuple[str, ...] = V.UNIT_TYPES, **calls) -> DataFrame:
    """Units of chunks ``(key, text)`` by a model, or by ``small`` where it gives no answer; by line patterns without one, or if its answers hold no unit at all.

    Returns ``(key, ord, unit_type, title, content, confidence, tags)``. ``longest`` is the room for text in a prompt.
    By model, ``most`` bounds the average of a chunk, in order of chunks; by pattern, each chunk.
    """
    names = (key, "ord", "unit_type", "title", "content", "confidence", "tags")
    if make is not None:
        ask = F.concat(F.lit(f"List the knowledge units of this text as JSON objects with unit_type ({', '.join(sorted(allowed))}), title, content, confidence and tags.\n\n"), F.substring("text", 1, longest))
        answers = completed(chunks.select(F.col(key).alias("chunk_id"), "text"), ask, make, **calls)
        if small is not None:
            plainer = F.concat(ask, F.lit('\n\nReturn only a JSON object {"units": [...]}.'))
            answers = answers.where("response IS NOT NULL").unionByName(completed(answers.where("response IS NULL"), plainer, small, **calls))
        answers = answers.drop("text")
        first = F.row_number().over(Window.partitionBy("chunk_id", "unit_type", "title").orderBy("ord"))
        found = knowledge.coerced(answers, allowed).withColumn("_n", first).where(F.col("_n") == 1).where(F.col("confidence") >= least)
        found = written(found.withColumnRenamed("chunk_id", key).select(*names), "units")
        if found.limit(1).count():
            return first_rows(found, key, "ord", most * chunks.count())
    return knowledge.units(chunks.select(key, "text"), [key], least=least, most=most, allowed=allowed).withColumnRenamed("line_no", "ord").select(*names)


def first_rows(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows in order of key and ``order``, by a running count of the keys' rows; no task sorts all rows."""
    counts = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_c")), "counts")
    if counts.agg(F.sum("_c")).first()[0] <= most:
        return rows
    ranged = counts.repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    before = ranged.groupBy("_p").agg(F.sum("_c").alias("_s")).select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row a partition
    inside = F.coalesce(F.sum("_c").over(Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.withColumn("_i", inside).join(F.broadcast(before), "_p").select(key, (F.col("_i") + F.col("_b")).alias("_at")).where(F.col("_at") < most)
    number = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.join(starts, key).withColumn("_n", F.col("_at") + number).where(F.col("_n") <= most).drop("_n", "_at")


def shown_units(units: DataFrame, group: str, order: str, most: int = 12) -> DataFrame:
    """``(group, shown)``: each group's units of most confidence, numbered, contents in one line of 300 characters."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("confidence"), order))
    top = units.withColumn("_n", rank).where(F.col("_n") <= most)
    told = F.concat(F.col("_n").cast("string"), F.lit(". ["), "unit_type", F.lit("] "), "title", F.lit("\n   "), F.substring(F.trim(F.regexp_replace("content", r"(?U)\s+", " ")), 1, 300))
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", told.alias("t")))), lambda x: x["t"]), "\n").alias("shown"))


def built(made: DataFrame, make: Provider, **calls) -> DataFrame:
    """Records, with their units in a column ``shown`` if there is one, with name, description, category and tags by a model, each kept as it was where the answer has none fit."""
    shown = F.coalesce("shown", F.lit("")) if "shown" in made.columns else F.to_json(F.struct("name", "description", "best_practices", "pitfalls", "tags"))
    ask = F.concat(F.lit("Give name, description, category and tags of this skill as a JSON object.\n\n"), shown)
    answered = completed(made, ask, make, **calls).withColumn("_a", _answer("name string, description string, category string, tags array<string>"))
    name = F.coalesce(F.nullif(T.skill_name(F.col("_a.name")), F.lit("")), F.nullif("name", F.lit("")), F.lit("generated-skill"))
    description = F.when(F.length(F.trim("_a.description")) >= 20, F.substring(F.trim("_a.description"), 1, 500)).otherwise(F.col("description"))
    category = F.lower(F.trim("_a.category"))
    own = F.coalesce(T.clean_tags(F.col("_a.tags"), 10), F.array().cast("array<string>"))
    return answered.withColumns({
        "name": name, "description": description, "category": F.when(category.isin(*CATEGORIES), category).otherwise(F.col("category")),
        "tags": F.slice(F.array_union(own, F.array_sort("tags")), 1, 10),
        "quality_score": F.when(F.col("_a.name").isNotNull(), F.least(F.round(F.col("quality_score") + 0.1, 2), F.lit(1.0))).otherwise(F.col("quality_score")),
    }).drop("response", "_a")


def reviewed(made: DataFrame, make: Provider, **calls) -> DataFrame:
    """Scores by a model, held to 0..10; by the rubric where it gives none."""
    rated = skills.reviewed(made)
    shown = F.to_json(F.struct("name", "description", "best_practices", "pitfalls", "workflow", "examples", "checklist", "tags", "category"))
    ask = F.concat(F.lit("Review this skill; answer with a JSON object with score (0 to 10) and notes.\n\n"), shown)
    answered = completed(rated, ask, make, **calls).withColumn("_a", _answer("score double, quality_score double, feedback string, notes array<string>")).withColumn("_a", F.col("_a").withField("score", F.coalesce("_a.score", "_a.quality_score")))
    score = F.when(F.col("_a.score").isNotNull(), F.round(F.least(F.greatest(F.col("_a.score"), F.lit(0.0)), F.lit(10.0)), 1))
    out = answered.withColumns({"_s": F.coalesce(score, F.col("score").cast("double")), "review_feedback": F.when(score.isNotNull(), F.coalesce("_a.feedback", "review_feedback")).otherwise(F.col("review_feedback")), "review_notes": F.when(score.isNotNull(), F.coalesce("_a.notes", F.array().cast("array<string>"))).otherwise(F.col("review_notes"))})
    return out.withColumns({"status": skills.status(F.col("_s")), "score": F.floor("_s").cast("int"), "reviewed_by": F.when(score.isNotNull(), "model").otherwise("rubric")}).drop("response", "_a", "_s")
