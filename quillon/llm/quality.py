"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Base rules reject texts that are too short or mostly repeated. On top, each stratum gets one step of a ladder of joint
cutoffs, from lenient to strict: at step j a document is rejected if any metric lies above its j-th cutoff. On labelled
documents an exact binomial test asks of each step in turn whether the rate of good documents rejected is below
``alpha``; the ladder ends at the first step that fails (fixed-sequence testing), and the error level is divided by
the number of strata (Bonferroni). With probability ``1 - delta`` no stratum then loses more than ``alpha`` of its good
documents. A stratum without enough labels gets no cutoffs and rejects nothing: at alpha = delta = 0.05 and five strata
it takes 90 good documents, none of them rejected, to pass a step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise

SPACE = r"[\x20\x09-\x0D]"
#: Languages with thresholds of their own; all others, and nulls, share one stratum.
STRATA = ("en", "de", "fr", "es")
#: Ladders of cutoffs, lenient to strict; a document above the cutoff is rejected. Fixed before any label is seen.
LADDERS: dict[str, tuple[float, ...]] = {
    "symbol_rate": (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05),
    "upper_rate": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "bang_rate": (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeat_rate": (0.3, 0.28, 0.26, 0.24, 0.22, 0.2, 0.18, 0.15, 0.12, 0.1),
    "dup_line_rate": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "sameness": (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


STEPS = min(len(ladder) for ladder in LADDERS.values())


def first_step() -> Column:
    """The first step of the ladder that rejects a row with metric columns, ``STEPS + 1`` if none does; all later ones reject it too."""
    return F.least(*[F.lit(STEPS + 1) - sum((F.when(F.col(m) > c, 1).otherwise(0) for c in ladder[:STEPS]), F.lit(0)) for m, ladder in LADDERS.items()])


@dataclass
class Thresholds:
    """Chosen step by stratum, from 1 on; what is absent rejects nothing."""

    steps: dict[str, int] = field(default_factory=dict)

    def rejects(self, stratum: Column) -> Column:
        """Whether any metric of a row with metric columns lies above its stratum's cutoff."""
        found = F.lit(False)
        for name, step in sorted(self.steps.items()):
            above = F.lit(False)
            for metric, ladder in LADDERS.items():
                above = above | (F.col(metric) > ladder[step - 1])
            found = found | ((stratum == name) & above)
        return found


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit("other"))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the five counts, ``base_failed``, the metrics and ``n_lines`` added; needs a column text.

    Null texts count as empty: all counts 0 and ``base_failed`` true. Works row by row, without a
    shuffle; a document's arrays live only while its row is computed.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    helpers = ["_w", "_h", "_g", "_lines"]
    df = docs.withColumns(
        {
            "_w": F.array_remove(F.split(text, SPACE + "+"), ""),
            "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        }
    )
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    for shift in (1, 2, 4):  # hashes of 2, 4 and then 8 words from each position
        df = df.withColumn("_h", F.zip_with("_h", F.slice("_h", shift + 1, F.size("_h")), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_g", F.when(F.size("_w") >= 8, F.slice("_h", 1, F.greatest(F.size("_w") - 7, F.lit(0)))).otherwise(F.slice("_h", 1, 0)))
    repeated = """aggregate(
        transform(array(sort_array(transform(_g, (h, i) -> struct(h AS h, i AS i)))), s ->
            array_sort(transform(filter(s, (e, j) -> (j > 0 AND s[j - 1].h = e.h) OR (j < size(s) - 1 AND s[j + 1].h = e.h)), e -> e.i)))[0],
        struct(0 AS n, -8 AS last), (a, p) -> struct(a.n + least(8, p - a.last) AS n, p AS last), a -> a.n)"""
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_repeat_words": F.when(F.size(F.array_distinct("_g")) == F.size("_g"), F.lit(0)).otherwise(F.expr(repeated)).cast("long"),
            "_kinds": F.size(F.array_distinct("_w")),
            "_bang": F.size(F.filter("_w", lambda w: F.right(w, F.lit(1)).isin("!", "?"))),
        }
    )
    rate = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    words = F.col("n_words")
    df = df.withColumns(
        {
            "base_failed": (words < 20) | (100 * F.col("n_repeat_words") > 30 * words),
            "symbol_rate": rate(F.col("n_symbols"), words),
            "upper_rate": rate(F.col("_upper"), F.col("word_chars")),
            "bang_rate": rate(F.col("_bang"), words),
            "repeat_rate": rate(F.col("n_repeat_words"), words),
            "dup_line_rate": rate(F.col("n_dup_lines"), F.col("n_lines")),
            "sameness": F.when(words > 0, 1 - F.col("_kinds") / F.sqrt(words * F.greatest(words, F.lit(100)))).otherwise(F.lit(0.0)),
        }
    )
    return df.drop(*helpers, "_upper", "_bang", "_kinds")


def lower_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly, in logarithms."""
    if n <= 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in log))


def calibrate(features: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> Thresholds:
    """Cutoffs from ``features(doc_id, stratum, base_failed, metrics...)`` and ``labels(doc_id, quality)``.

    The data only enter through a histogram of at most strata x (steps + 1) x 2 counters. Labels that
    contradict each other count as bad; documents that fail the base rules don't count. Of the steps that pass, the one
    that catches most bad documents less five times the good ones lost is chosen, the most lenient of equals.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("good"))
    judged = features.where(~F.col("base_failed")).select("doc_id", "stratum", first_step().alias("first")).join(marks, "doc_id")
    tally: dict[str, dict[int, list[int]]] = {}
    for row in judged.groupBy("stratum", (F.col("good") >= 1).cast("int").alias("good"), "first").count().toLocalIterator():
        tally.setdefault(row["stratum"], {1: [0] * (STEPS + 1), 0: [0] * (STEPS + 1)})[row["good"]][row["first"] - 1] += row["count"]
    chosen, level = Thresholds(), delta / (len(STRATA) + 1)
    for name, by in tally.items():
        n, best = sum(by[1]), 0
        for step in range(1, STEPS + 1):
            lost, caught = sum(by[1][:step]), sum(by[0][:step])
            if lost > alpha * n or lower_tail(lost, n, alpha) > level:
                break
            if caught - 5 * lost > best:
                best, chosen.steps[name] = caught - 5 * lost, step
    return chosen


def features(docs: DataFrame) -> DataFrame:
    """Narrow table of a document's counts, metrics and stratum, written to the shared folder."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text")
    kept = ["doc_id", stratum(F.col("lang")).alias("stratum"), *COUNTS, "base_failed", *LADDERS]
    return materialise(measured(narrow).select(*kept), "quality")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``kept`` and ``stratum``.

    Null, empty and blank texts have counts of 0, fail the base rules and are not kept. A null or unknown language is of
    the stratum ``other``; without a column lang all are. Labels of null doc_id count for nothing; repeated labels count once,
    but once for each repeated document. Repeated rows are judged each; no rows give none, and no labels leave the base rules.
    """
    rows = features(docs)
    chosen = calibrate(rows, labels, alpha, delta)
    kept = ~F.col("base_failed") & ~chosen.rejects(F.col("stratum"))
    return rows.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "stratum")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The documents that :func:`judge` keeps, with their own columns; measured row by row, so that texts are never shuffled.

    Nulls, repeats, clashing columns and empty tables as there: columns of ``docs`` named like a measure stay as they are.
    """
    chosen = calibrate(features(docs), labels, alpha, delta)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", *(["lang"] if "lang" in docs.columns else [F.lit(None).cast("string").alias("lang")]))
    # the row number, never negative, keeps the optimiser from copying the measures into a pushed-down filter
    judged = measured(inner).withColumn("_at", F.monotonically_increasing_id())
    return judged.where(~F.col("base_failed") & ~chosen.rejects(stratum(F.col("lang"))) & (F.col("_at") >= 0)).select("_row.*")
