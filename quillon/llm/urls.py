"""URL verdicts: host and path rules first, then a log-likelihood ratio of character Markov models. DataFrame expressions only.

Two variable-order Markov models, one of accepted and one of rejected URLs, give each character of a whole URL a
probability after its up to ``ORDER`` predecessors, smoothed by interpolation with the shorter contexts
(Witten-Bell). A URL's score is the mean over its characters of the difference of log-probabilities; the cutoff
is a high quantile of the scores of accepted URLs whose hosts are held out of training. Labels are a table of URLs; :func:`measure`
states recall and precision on held-out hosts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import BROADCAST_ROWS, materialise

ORDER = 3
#: Characters that the models tell apart, after A-Z are lower-cased; all others count as ``~``.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789.-_/:?#=&%+"
#: Hosts of one in ``FOLDS`` are never trained on; scores are told apart by 1 / ``GRID`` when the cutoff is set.
FOLDS, GRID = 5, 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str]
RULES: tuple[Rule, ...] = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Words of hosts by which URLs are labelled rejected for training; fixed values.
REJECTED_WORDS = ("casino", "bets", "pills", "spam", "adult", "ads", "track", "porn", "viagra", "poker", "xxx", "loan")


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.when(F.instr(url, "://") > 0, after).otherwise(F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits a host, or one of its parents, and the start of a path."""
    out = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


def verdict_of(rule: Column, rules: tuple[Rule, ...]) -> Column:
    return reduce(lambda out, r: F.when(rule == r[1], F.lit(r[0])).otherwise(out), rules, F.lit(None).cast("string"))


def spelled(url: Column) -> Column:
    """The characters that the models read: start marks, the whole URL in the alphabet, an end mark."""
    known = "[^" + re.escape(ALPHABET.replace("-", "")) + "-]"
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(F.translate(url, UPPER, LOWER), known, "~"), F.lit("$"))


def held_out(host: Column) -> Column:
    """Whether a host only sets the cutoff and measures; all URLs of a host are on one side."""
    return F.conv(F.substring(F.md5(host), 1, 8), 16, 10).cast("long") % FOLDS == 0


def word_labels(pages: DataFrame, words: tuple[str, ...] = REJECTED_WORDS) -> DataFrame:
    """``(url, rejected)``, one row a URL, for tables without labels of their own: 1 where the host has one of ``words`` between marks, else 0."""
    url = F.col("url").cast("string")
    found = host_of(url).rlike(r"(^|[.-])(" + "|".join(words) + r")([.-]|$)") if words else F.lit(False)
    return pages.where(F.instr(url, "://") > 0).select(url.alias("url"), found.cast("int").alias("rejected")).distinct()


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """One row per character of ``s``: the character with its ``ORDER`` predecessors."""
    at = F.explode(F.sequence(F.lit(1), F.length("s") - ORDER))
    return urls.select(*keep, "s", at.alias("i")).select(*keep, F.expr(f"substring(s, i, {ORDER + 1})").alias("g"))


def model(counts: DataFrame) -> DataFrame:
    """``(g, ratio)``: log-probability of the last character of g under the rejected less under the accepted model.

    ``counts(g, n0, n1)`` has how often accepted (0) and rejected (1) URLs contain each gram, among them all grams to be
    scored. At most (alphabet + 3) ** (ORDER + 1) exist, some six million; in practice tens of thousands.
    """
    base = 1.0 / (len(ALPHABET) + 3)
    out = counts.select("g")
    probability: list[Column] = [F.lit(base), F.lit(base)]
    for order in range(ORDER + 1):
        tail = F.expr(f"right(g, {order + 1})")
        seen = counts.groupBy(tail.alias("tail")).agg(F.sum("n0").alias("x0"), F.sum("n1").alias("x1"))
        seen = seen.withColumn("context", F.expr(f"left(tail, {order})"))
        totals = seen.groupBy("context").agg(*[f for k in (0, 1) for f in (F.sum(f"x{k}").alias(f"s{k}"), F.count_if(F.col(f"x{k}") > 0).alias(f"d{k}"))])
        step = seen.join(totals, "context").select("tail", *[F.col(f"{v}{k}").alias(f"{v}{k}_{order}") for v in "xsd" for k in (0, 1)])
        out = out.join(step, tail == F.col("tail")).drop("tail")
        for k in (0, 1):
            x, s, d = (F.col(f"{v}{k}_{order}") for v in "xsd")
            probability[k] = F.when(s > 0, (x + d * probability[k]) / (s + d)).otherwise(probability[k])
    return out.select("g", (F.log(probability[1]) - F.log(probability[0])).alias("ratio"))


def trained(rows: DataFrame, marked: DataFrame) -> tuple[DataFrame, int] | None:
    """``(g, ratio)`` of all grams of ``rows(s)`` and ``marked(s, rejected, held)``, and their number; None if a class has no URL to train on."""
    counts = grams(marked.where("NOT held"), "rejected").groupBy("g").agg(F.count_if(F.col("rejected") < 1).alias("n0"), F.count_if(F.col("rejected") >= 1).alias("n1"))
    every = grams(rows.select("s")).select("g").union(grams(marked.select("s")).select("g")).distinct()
    counts = materialise(every.join(counts, "g", "left").na.fill(0, ["n0", "n1"]), "grams")
    two = counts.agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"), F.count(F.lit(1)).alias("n")).first()
    return (materialise(model(counts), "ratios"), two["n"]) if two["a"] and two["b"] else None


def scored(rows: DataFrame, ratios: tuple[DataFrame, int]) -> DataFrame:
    """``rows(id, s, …)`` with ``score``. Each row is scored by itself, so that no key is shared by many rows; ``id`` is unique."""
    table = F.broadcast(ratios[0]) if ratios[1] <= BROADCAST_ROWS else ratios[0]
    means = grams(rows, "id").join(table, "g").groupBy("id").agg(F.round(F.avg("ratio"), 9).alias("score"))
    return rows.join(means, "id")


def cutoff(scores: DataFrame, loss: float) -> int:
    """The least step of the grid above which at most ``loss`` of ``scores`` lie, from a histogram of the grid; 0 without scores."""
    steps = scores.groupBy(F.floor(F.col("score") * GRID).alias("k")).count()
    before = F.sum("count").over(Window.orderBy(F.desc("k")))  # a row for each step of the grid that occurs
    above = steps.withColumn("a", before - F.col("count"))
    total = steps.agg(F.sum("count")).first()[0] or 0
    least = above.where(F.col("a") <= loss * total).agg(F.min("k")).first()[0]
    return 0 if least is None else least


def marks(labels: DataFrame) -> DataFrame:
    """Labelled URLs with a host as ``(id, s, host, rejected, held)``, written; of contradicting labels of a URL, the rejection counts."""
    rows = labels.where("url IS NOT NULL AND rejected IS NOT NULL").groupBy(F.col("url").cast("string").alias("url")).agg(F.max("rejected").cast("int").alias("rejected"))
    host = host_of(F.col("url"))
    rows = rows.where(host != "").select(F.monotonically_increasing_id().alias("id"), spelled(F.col("url")).alias("s"), host.alias("host"), "rejected", held_out(host).alias("held"))
    return materialise(rows, "marks")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labels: DataFrame | None = None, loss: float = 0.001) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and the model's score (positive: rejected likelier).

    ``labels(url, rejected)`` trains the models; without it :func:`word_labels` of the pages. Hosts that are held out only set the
    cutoff, so that about ``loss`` of accepted URLs are blocked. Without accepted or without rejected URLs every score is
    0. A null or a URL without ``://`` has empty host and path and fits no rule; null and empty ones score 0 and are allowed. Ties in
    score are judged alike. Repeated pages, and repeated and null page_ids, give a row each; other columns are left out; no rows give none.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select(F.monotonically_increasing_id().alias("id"), "page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), F.when(F.col("url") != "", spelled(F.col("url"))).otherwise(F.lit("")).alias("s"))
    urls = materialise(rows, "urls")
    marked = marks(word_labels(pages) if labels is None else labels)
    ratios = trained(urls, marked)
    if ratios is None:
        known, most = urls.withColumn("score", F.lit(0.0)), 0
    else:
        most = cutoff(scored(marked.where("held AND rejected < 1"), ratios), loss)
        known = scored(urls.where("s <> ''"), ratios).unionByName(urls.where("s = ''").withColumn("score", F.lit(None).cast("double")))
    blocked = F.when(F.floor(F.col("score") * GRID) > most, F.lit("block")).otherwise(F.lit("allow"))
    return known.select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), blocked).alias("verdict"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def measure(labels: DataFrame, loss: float = 0.001) -> dict[str, int]:
    """On the labelled URLs of held-out hosts, by the model alone: how many are rejected, caught, accepted and blocked all the same."""
    marked = marks(labels)
    ratios = trained(marked, marked)
    if ratios is None:
        return {"rejected": 0, "caught": 0, "accepted": 0, "lost": 0}
    tested = materialise(scored(marked.where("held"), ratios), "tested")
    hit = F.floor(F.col("score") * GRID) > cutoff(tested.where("rejected < 1"), loss)
    bad = F.col("rejected") >= 1
    return tested.agg(F.count_if(bad).alias("rejected"), F.count_if(bad & hit).alias("caught"), F.count_if(~bad).alias("accepted"), F.count_if(~bad & hit).alias("lost")).first().asDict()
