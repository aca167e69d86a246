"""Duplicates and relations between skill records within one scope: a book, a source, an ingestion batch."""

from __future__ import annotations

import difflib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType
from pyspark.sql.window import Window

from quillon.functions import text as T
from quillon.functions import vocabulary as V
from quillon.operators.lineage import written


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two names, in this order; null if one is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def hashed_vector(docs: DataFrame, key: str, text: Column, dim: int = 384) -> DataFrame:
    """Long form of the hash embedding: ``(key, bucket, value)``, of unit length; texts without tokens give no rows, buckets whose tokens cancel out a 0.

    A token's bucket and sign come from its MD5; it counts with the root of its frequency.
    """
    words = docs.select(key, F.explode(T.tokens(text)).alias("token")).groupBy(key, "token").count()
    h = F.md5("token")
    little = lambda at: F.concat(*[F.substring(h, at + 2 * k, 2) for k in (3, 2, 1, 0)])
    bucket = (F.conv(little(1), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    cells = words.select(key, bucket.alias("bucket"), (sign * F.sqrt("count")).alias("v")).groupBy(key, "bucket").agg(F.sum("v").alias("v"))
    norms = cells.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return cells.join(norms, key).where("norm > 0").select(key, "bucket", (F.col("v") / F.col("norm")).alias("value"))


def scoped_pairs(skills: DataFrame, scope: str, order: str) -> DataFrame:
    """Ordered pairs within a scope; columns of the two sides end in _a and _b."""
    a = skills.select(*[F.col(c).alias(f"{c}_a") for c in skills.columns])
    b = skills.select(*[F.col(c).alias(f"{c}_b") for c in skills.columns])
    return a.join(b, (F.col(f"{scope}_a") == F.col(f"{scope}_b")) & (F.col(f"{order}_a") < F.col(f"{order}_b")))


def content_pairs(skills: DataFrame, scope: str, order: str) -> DataFrame:
    """Pairs of a scope whose contents have a Jaccard similarity of at least 0.6, rounded to four places.

    Only records that share one of their rarest tokens are compared; no pair is lost by that, however large the scope.
    """
    body = F.concat_ws(" ", "description", F.array_join("best_practices", " "), F.array_join("pitfalls", " "))
    found = similar_sets(skills.select(scope, order, T.content_tokens(body).alias("items")), scope, order, V.DUPLICATE[2] - 5e-5)
    scored = found.withColumn("similarity", F.round("similarity", 4)).where(F.col("similarity") >= V.DUPLICATE[2])
    return scored.select(scope, F.col("a").alias(f"{order}_a"), F.col("b").alias(f"{order}_b"), "similarity")


#: One more shared item is asked of two sets for so many that they must share.
MATCH_PART = 20
#: Sets of one side of a tile, and meetings of items that a task looks through at once.
SETS, MEETINGS = 8_192, 1_000_000
#: Sets that the frequencies of items are estimated from, and items that count as frequent, at most.
SAMPLE, FREQUENT = 20_000, 200_000


def taking_part(rows: DataFrame, pairs: DataFrame, scope: str, key: str) -> DataFrame:
    """Rows whose keys are a or b of a pair, so that wide rows of the others are not sent."""
    keys = pairs.select(scope, F.col("a").alias(key)).unionByName(pairs.select(scope, F.col("b").alias(key))).distinct()
    return rows.join(keys, [scope, key], "left_semi")


def _least_size(size: Column, least: float) -> Column:
    return F.ceil(size * least - 1e-9)


def _rare_first(known: DataFrame, key: str, least: float) -> Column:
    """The items of ``w`` that stand in the places where a similar set must meet it, as numbers, rare ones first.

    Frequencies are estimated from about ``SAMPLE`` sets by hash of the key. Any order that all sets share gives the same pairs; frequencies decide cost only.
    """
    share = math.ceil(1_000_000 * min(1.0, SAMPLE / max(known.count(), 1)))
    sample = known.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < share).select(F.explode(F.transform("w", lambda x: F.xxhash64(x))).alias("t"))
    often = sample.groupBy("t").count().where("count > 1").orderBy(F.desc("count"), "t").limit(FREQUENT).toPandas().sort_values("t")
    seen, times = (np.append(often[c].to_numpy("int64"), last) for c, last in (("t", np.iinfo("int64").max), ("count", 0)))

    @F.arrow_udf(ArrayType(IntegerType()))
    def first(lists: pa.Array) -> pa.Array:
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("int64")
        t = lists.flatten().to_numpy()
        at = np.searchsorted(seen, t)
        rows = np.repeat(np.arange(len(n)), n)
        t = t[np.lexsort((t, np.where(seen[at] == t, times[at], 0), rows))]
        low = np.ceil(n * least - 1e-9).astype("int64")
        kept = np.minimum(n, n - low + 1 + low // MATCH_PART)
        ends = np.append(0, np.cumsum(n))
        t = t[np.arange(len(t)) - ends[rows] < kept[rows]]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept)), "int32"), pa.array(t.astype("int32")))

    return first(F.transform("w", lambda x: F.xxhash64(x)))


def _meeting(a: pd.DataFrame, b: pd.DataFrame, same: bool, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` that share as many of their items ``x`` as similar sets of sizes ``s`` must, in the places where they must."""

    def flat(side: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = side["x"].str.len().to_numpy("int64")
        rows = np.repeat(np.arange(len(side)), n)
        return np.concatenate([np.zeros(0, "int32"), *side["x"]]), rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)

    (ta, ra, pa_), (tb, rb, pb), sa, sb = flat(a), flat(b), a["s"].to_numpy("int64"), b["s"].to_numpy("int64")
    order = np.argsort(tb, kind="stable")
    tb, rb, pb = tb[order], rb[order], pb[order]
    low = np.searchsorted(tb, ta, "left")
    times = np.searchsorted(tb, ta, "right") - low
    asked = np.ceil(np.arange(max(sa.max(initial=0) + sb.max(initial=0) + 1, 1)) * share - 1e-9).astype("int64")
    more = 1 + asked // MATCH_PART
    found = [np.zeros((2, 0), "int64")]
    ends = np.cumsum(np.bincount(ra, times, len(a)).astype("int64"))
    starts = np.append(np.searchsorted(ra, np.arange(len(a))), len(ra))  # each row's first item
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MEETINGS, "right")))  # whole rows
        part = slice(starts[at], starts[to])
        n = times[part]
        i = np.repeat(np.arange(part.start, part.stop), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[part], n)
        x, y = ra[i], rb[j]
        both = sa[x] + sb[y]
        o, k = asked[both], more[both]
        placed = (o <= np.minimum(sa[x], sb[y])) & (pa_[i] < sa[x] - o + k) & (pb[j] < sb[y] - o + k)
        if same:
            placed &= x < y
        cell, n = np.unique(x[placed] * len(b) + y[placed], return_counts=True)
        x, y = cell // max(len(b), 1), cell % max(len(b), 1)
        enough = n >= more[sa[x] + sb[y]]
        found.append(np.stack([x[enough], y[enough]]))
        at = to
    x, y = np.concatenate(found, axis=1)
    return x, y


def similar_sets(items: DataFrame, scope: str, key: str, least: float) -> DataFrame:
    """``(scope, a, b, similarity)`` of all keys a < b whose ``items`` have a Jaccard similarity of at least ``least``; empty sets have none.

    Equal sets take part once. Items are put in one order, rare ones first. Sets of n and m items that are similar enough share at least
    o = ceil(least / (1 + least) * (n + m)) items, and the first k of these stand among the first n - o + k of the one and m - o + k of the other. Sets
    with k items in such places are compared. k grows with o: pairs that meet by chance share one rare item or two, not k.

    The sets of a scope, in order of size, go to blocks, and every two blocks whose sizes allow it are a task that counts where its sets meet; only pairs
    with k items leave it, so what is sent grows with blocks, not with pairs that share an item. Items are told by hashes until sets are compared; a clash costs a comparison.
    """
    once = F.transform(F.array(F.array_distinct("items")), lambda w: F.struct(w.alias("w"), F.md5(F.to_json(F.sort_array(w))).alias("_d")))
    known = written(items.select(scope, key, F.inline(once)).where(F.size("w") > 0), "sets")
    member = written(known.select(scope, key, "_d").join(known.groupBy(scope, "_d").agg(F.min(key).alias("_c")), [scope, "_d"]).select(scope, key, "_c"), "members")
    lone = member.where(F.col(key) == F.col("_c")).select(scope, key)
    rare = written(known.select(scope, key, F.size("w").alias("s"), _rare_first(known, key, least).alias("x")).join(lone, [scope, key], "left_semi"), "rare")

    sizes = rare.groupBy(scope, "s").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(scope).orderBy("s")) - F.col("_n")
    sizes = written(sizes.select(scope, "s", "_n", before.alias("_before")), "sizes")
    placed = rare.join(sizes, [scope, "s"]).withColumn("_own", F.floor((F.col("_before") + F.pmod(F.xxhash64(key), "_n")) / SETS).cast("int")).drop("_n", "_before")
    ranges = written(placed.groupBy(scope, "_own").agg(F.min("s").alias("low"), F.max("s").alias("high")), "ranges")
    x, y = (ranges.select(scope, F.col("_own").alias(f"_{side}"), F.col("low").alias(f"low_{side}"), F.col("high").alias(f"high_{side}")) for side in "xy")
    tiles = x.join(y, scope).where((F.col("_x") <= F.col("_y")) & (_least_size(F.col("low_y"), least) <= F.col("high_x")))
    ends = tiles.select(scope, "_x", "_y", F.col("_x").alias("_own"), F.col("low_y").alias("_low"), F.col("high_y").alias("_high"))
    ends = written(ends.unionByName(tiles.where("_x < _y").select(scope, "_x", "_y", F.col("_y").alias("_own"), F.col("low_x").alias("_low"), F.col("high_x").alias("_high"))), "tiles")
    # of a set goes what may meet the smallest set that is allowed to be similar to it in the other block
    other = F.greatest("_low", _least_size(F.col("s"), least).cast("int"))
    both = F.ceil((F.col("s") + other) * (least / (1 + least)) - 1e-9)
    sent = placed.join(ends, [scope, "_own"]).where((both <= F.col("s")) & (other <= F.col("_high")))
    sent = sent.withColumn("x", F.slice("x", F.lit(1), (F.col("s") - both + 1 + F.floor(both / MATCH_PART)).cast("int"))).drop("_low", "_high")
    kinds = [items.schema[c].dataType.simpleString() for c in (scope, key)]

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        low, high = group["_x"].iloc[0], group["_y"].iloc[0]
        a, b = (group[group["_own"] == side].reset_index(drop=True) for side in (low, high))
        i, j = _meeting(a, b, low == high, least / (1 + least))
        ka, kb = a[key].to_numpy()[i], b[key].to_numpy()[j]
        return pd.DataFrame({scope: group[scope].iloc[0], "a": np.minimum(ka, kb), "b": np.maximum(ka, kb)})

    pairs = written(sent.groupBy(scope, "_x", "_y").applyInPandas(meet, f"{scope} {kinds[0]}, a {kinds[1]}, b {kinds[1]}"), "candidates")
    words = taking_part(known, pairs, scope, key)
    for side in "ab":
        pairs = pairs.join(words.select(scope, F.col(key).alias(side), F.col("w").alias(f"w_{side}")), [scope, side])
    scored = pairs.withColumn("similarity", T.jaccard(F.col("w_a"), F.col("w_b"))).where(F.col("similarity") >= least).select(scope, "a", "b", "similarity")
    itself = member.where(F.col(key) != F.col("_c")).select(scope, F.col("_c").alias("a"), F.col("_c").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    out = written(scored.unionByName(itself), "similar").select(scope, F.col("a").alias("_a"), F.col("b").alias("_b"), "similarity")
    for side in "ab":
        out = out.join(member.select(scope, F.col("_c").alias(f"_{side}"), F.col(key).alias(side)), [scope, f"_{side}"])
    # classes in either order; within a class each pair comes both ways
    once = out.where("_a <> _b OR a < b")
    return once.select(scope, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def edges(skills: DataFrame, scope: str, order: str) -> DataFrame:
    """Relations within a scope of bounded size, such as a capped book, of which all pairs are compared (:mod:`relations` has those of any scope): related_to, extends and prerequisite, each at most once a pair and direction.

    ``skills`` has a ``vector``. A pair is related by its vectors, else tags, else names, else shared units, else category;
    names are compared only where vectors and tags don't decide.
    """
    named = skills.withColumn("_p", T.plain_name(F.col("name")))
    hit = F.lit(False)
    for k in V.PREREQUISITE_KEYWORDS:
        hit = hit | F.col("_p").contains(k)
    pairs = scoped_pairs(named.select(scope, order, "name", "tags", "category", "knowledge_ids", "vector", T.norm(F.col("vector")).alias("_norm"), "_p", hit.alias("_pre")), scope, order)
    pairs = pairs.withColumns({"_cos": T.cosine(F.col("vector_a"), F.col("vector_b"), F.col("_norm_a") * F.col("_norm_b")), "_tags": T.jaccard(F.col("tags_a"), F.col("tags_b"))}).drop("vector_a", "vector_b")
    open_ = (F.col("_cos") < V.RELATED[0]) & (F.col("_tags") < V.RELATED[1])
    pairs = pairs.withColumn("_ratio", name_ratio(F.when(open_, F.lower("name_a")), F.when(open_, F.lower("name_b"))))
    ids = T.jaccard(F.col("knowledge_ids_a"), F.col("knowledge_ids_b"))
    same = (F.col("category_a") == F.col("category_b")) & (F.col("category_a") != "")
    related = (
        F.when(F.col("_cos") >= V.RELATED[0], F.round("_cos", 3)).when(F.col("_tags") >= V.RELATED[1], F.round("_tags", 3))
        .when(F.col("_ratio") >= V.RELATED[2], F.round("_ratio", 3)).when(ids > V.RELATED[3], F.lit(0.5)).when(same, F.lit(0.4))
    )
    la, lb = F.length("_p_a"), F.length("_p_b")
    b_has_a, a_has_b = F.col("_p_b").contains(F.col("_p_a")) & (la >= 4), F.col("_p_a").contains(F.col("_p_b")) & (lb >= 4)
    edge = lambda kind, forward, weight: F.struct(F.when(forward, F.col(f"{order}_a")).otherwise(F.col(f"{order}_b")).alias("source"), F.when(forward, F.col(f"{order}_b")).otherwise(F.col(f"{order}_a")).alias("target"), F.lit(kind).alias("type"), weight.alias("weight"))
    found = F.array_compact(
        F.array(
            F.when(related.isNotNull(), edge("related_to", F.lit(True), related)),
            F.when(b_has_a | a_has_b, edge("extends", ~b_has_a, F.round(F.least(la, lb) / F.greatest(la, lb), 3))),
            F.when(F.col("_pre_a") != F.col("_pre_b"), edge("prerequisite", F.col("_pre_a"), F.lit(1.0))),
        )
    )
    return pairs.select(F.col(f"{scope}_a").alias(scope), F.explode(found).alias("e")).select(scope, "e.*").dropDuplicates([scope, "source", "target", "type"])


def merged(skills: DataFrame, found: DataFrame, scope: str, order: str, lists: tuple[str, ...] = ("knowledge_ids", "source_chapters", "tags", "related_skills")) -> DataFrame:
    """The survivors, those of ``lists`` that they have joined by those of the records that went into them: own values first, then in order."""
    lists = tuple(c for c in lists if c in skills.columns)
    keyed = skills.join(found.select(scope, order, "survivor"), [scope, order])
    first = (F.col(order) != F.col("survivor")).cast("int")
    gathered = keyed.groupBy(scope, "survivor").agg(*[F.array_sort(F.collect_list(F.struct(first.alias("a"), F.col(order).alias("o"), F.col(c).alias("v")))).alias(f"_{c}") for c in lists])
    kept = keyed.where(F.col(order) == F.col("survivor")).join(gathered, [scope, "survivor"])
    return kept.withColumns({c: F.array_distinct(F.flatten(F.transform(f"_{c}", lambda s: s["v"]))) for c in lists}).drop("survivor", *[f"_{c}" for c in lists])
