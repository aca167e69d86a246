"""Cleaning of extracted text, step by step, with a record of the steps that changed something."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.functions import vocabulary as V
from quillon.functions.text import bound, word_count

#: Where lines break, besides at the end of the text.
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def lines(text: Column) -> Column:
    """The lines of a text; one break at its end opens no further line."""
    return F.split(F.regexp_replace(text, f"(?:{BREAK})\\z", ""), BREAK)


#: Any line that is dropped.
_DROPPED = "|".join(f"(?:{p})" for p in V.DROPPED_LINES)


def without_page_marks(text: Column) -> Column:
    def kept(line: Column) -> Column:
        return ~F.regexp_replace(line, r"(?U)^\s+|\s+$", "").rlike(_DROPPED)

    def joined(every: Column) -> Column:
        return bound(F.filter(every, kept), lambda left: F.when(F.size(left) < F.size(every), F.array_join(left, "\n")).otherwise(text))

    return bound(lines(text), joined)


def collapsed_blanks(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def stripped_ends(text: Column) -> Column:
    return F.array_join(F.transform(lines(text), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")


def single_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " {2,}", " ")


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


STEPS = (
    ("footer_header_removal", without_page_marks),
    ("blank_line_collapse", collapsed_blanks),
    ("trailing_whitespace_removed", stripped_ends),
    ("space_normalisation", single_spaces),
    ("control_char_removal", without_controls),
)


@F.pandas_udf(StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def quality(before: Column, after: Column, steps: Column) -> Column:
    """Share of words kept plus a little for steps taken."""
    ratio = after / before
    return F.when(before == 0, F.lit(0.0)).when(ratio < 0.3, F.greatest(F.lit(0.0), ratio)).otherwise(F.least(ratio + F.least(steps / 10, F.lit(0.2)), F.lit(1.0)))


def cleaned(docs: DataFrame, text: str = "text", nfkc: bool = True) -> DataFrame:
    """``docs`` with ``text`` cleaned and transformations, original_word_count, cleaned_word_count and quality_score added."""
    df = docs.withColumn("original_word_count", word_count(F.col(text))).withColumn("_t0", F.col(text)).withColumn("_labels", F.array().cast("array<string>"))
    steps = ((("unicode_nfkc", _nfkc),) if nfkc else ()) + STEPS
    for label, step in steps:
        df = df.withColumn("_t1", step(F.col("_t0")))
        df = df.withColumn("_labels", F.when(F.col("_t1") != F.col("_t0"), F.array_append("_labels", F.lit(label))).otherwise(F.col("_labels"))).withColumn("_t0", F.col("_t1")).drop("_t1")
    df = df.withColumn(text, F.regexp_replace("_t0", r"(?U)^\s+|\s+$", "")).withColumn("cleaned_word_count", word_count(F.col(text)))
    return df.withColumn("quality_score", quality(F.col("original_word_count"), F.col("cleaned_word_count"), F.size("_labels"))).withColumnRenamed("_labels", "transformations").drop("_t0")
