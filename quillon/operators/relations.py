"""Relations between the records of a scope however large, as rows of classes instead of rows of pairs.

Records that agree in what a relation looks at form a class: equal vectors, sets of tags, names, categories. A row ties two classes (or one to
itself) and stands for all pairs of their members; :func:`members` tells each record's classes, and :func:`expanded` gives the pairs back.
So two thirds of a scope in one category are one row. Layers of related_to go before each other: vector, tags, name, units, category; the weight of
a pair is that of its first layer.

Cosines and name ratios have no index that loses no pair and saves more than it costs at these thresholds, so they are taken in tiles: every two
blocks of distinct vectors or names of a scope are a task of bounded size, which hands on only the pairs above the threshold. Sets are
joined on their rarest elements, and contained names on hashes of the substrings of the lengths that occur.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vocabulary as V
from quillon.operators import embed
from quillon.operators.lineage import written
from quillon.operators.similar import name_ratio, similar_sets, taking_part

#: Distinct names of one side of a tile, and how many times as many vectors: a row is sent once for each block of its scope, and vectors are wide.
BLOCK = 2_048
VECTOR_BLOCKS = 10
#: Vectors of either side that are multiplied at once, and pairs of them that are then looked at whole.
STRIP, WIDE, CHECKED = 512, 8_192, 10_000
#: Steps from 0 to 1 of the whole numbers that tiles are sent for their components.
STEPS = 32_767
#: Vectors of a side that a tile's rotation is learned from, and the share of pairs that its first components may leave open.
SEEN, FEW = 1_024, 0.001
#: Places to which cosines are rounded before they are compared with a threshold, so that the order of a sum decides nothing.
PLACES = 9
LAYERS = ("vector", "tags", "name", "units", "category")
#: Shortest name that a relation of containment counts.
LEAST_NAME = 4
COLUMNS = ("type", "layer", "a", "b", "n_a", "n_b", "weight")


def tiled(items: DataFrame, scope: str, key: str, run: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], made: str, block: int) -> DataFrame:
    """``scope`` and the columns ``made`` of what ``run(a, b, same)`` finds in every two blocks of a scope; a block also meets itself (``same``)."""
    kind = items.schema[scope].dataType.simpleString()
    blocks = items.groupBy(scope).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    placed = items.join(blocks, scope).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    each = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumns({"_low": F.least("_own", "_other"), "_high": F.greatest("_own", "_other")})

    def one(group: pd.DataFrame) -> pd.DataFrame:
        low, high = group["_low"].iloc[0], group["_high"].iloc[0]
        found = run(group[group["_own"] == low].reset_index(drop=True), group[group["_own"] == high].reset_index(drop=True), low == high)
        found.insert(0, scope, group[scope].iloc[0])
        return found

    # tiles are small to send and long to work on, so they are not put together by their bytes
    dealt = each.drop("_blocks", "_other").repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), scope, "_low", "_high")
    return dealt.groupBy(scope, "_low", "_high").applyInPandas(one, f"{scope} {kind}, {made}")


def _turned(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray | None, int]:
    """A rotation that puts most of the vectors' length into their first components, and how many of these tell most pairs below ``least``; None if that saves nothing."""
    some = np.concatenate([side[:: max(1, len(side) // SEEN)] for side in (x, y) if len(side)])
    turn = np.linalg.eigh(some.T @ some)[1][:, ::-1].copy()
    for head in (x.shape[1] * part // 8 for part in (2, 3, 4)):
        part = _heads(some @ turn, head)
        if head and (part @ part.T >= least).mean() < FEW + 1 / len(some):  # each meets itself
            return turn, head
    return None, 0


def _heads(x: np.ndarray, head: int) -> np.ndarray:
    """First components and the length of the rest: the product of two is no less than that of the vectors."""
    return np.hstack([x[:, :head], np.linalg.norm(x[:, head:], axis=1, keepdims=True)])


def _near(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and of ``y`` whose product is at least ``least``."""
    turn, head = _turned(x, y, least) if len(x) * len(y) > SEEN * SEEN else (None, 0)
    if turn is not None:
        x, y = x @ turn, y @ turn
    heads = [_heads(side, head) if head else side for side in (x, y)]
    found = [np.empty((2, 0), int)]
    for at in range(0, len(x), STRIP):
        for to in range(0, len(y), WIDE):
            near = heads[0][at : at + STRIP] @ heads[1][to : to + WIDE].T >= least
            i, j = np.divmod(np.flatnonzero(near), near.shape[1])
            for low in range(0, len(i), CHECKED):
                u, v = i[low : low + CHECKED] + at, j[low : low + CHECKED] + to
                if head:
                    right = np.einsum("ij,ij->i", x[u], y[v]) >= least
                    u, v = u[right], v[right]
                found.append(np.stack([u, v]))
    i, j = np.concatenate(found, axis=1)
    return i, j


def cosine_pairs(items: DataFrame, scope: str, key: str, least: float, stored: bool = False, itself: bool = True) -> DataFrame:
    """``(scope, a, b, cosine)`` of all keys a <= b whose unit vectors have a cosine of at least ``least``; zero vectors have none.

    Candidates are written first if ``stored``, and then only vectors that take part are sent to be decided on. Without ``itself`` no key is paired with itself.
    """
    kind = items.schema[key].dataType.simpleString()

    def run(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        width = len((a if len(a) else b)["_v"].iloc[0])  # a block may have no row
        x, y = (np.array(s["_v"].tolist(), dtype="float32").reshape(len(s), width) / np.float32(STEPS) for s in (a, b))
        # half a step a component costs a cosine of unit vectors sqrt(n) / STEPS at most, single precision far less than 1e-4
        i, j = _near(x, y, least - np.sqrt(width) / STEPS * 1.01 - 1e-4)
        ka, kb = a[key].to_numpy()[i], b[key].to_numpy()[j]
        keep = ka <= kb if same else np.ones(len(i), bool)
        return pd.DataFrame({"a": np.minimum(ka, kb)[keep], "b": np.maximum(ka, kb)[keep]})

    # tiles find candidates by components of two bytes, as each row is sent once for each block of its scope; these few are decided in double
    narrow = items.select(scope, key, F.transform("vector", lambda v: F.floor(v * STEPS + 0.5).cast("short")).alias("_v"))
    near = tiled(narrow, scope, key, run, f"a {kind}, b {kind}", BLOCK * VECTOR_BLOCKS)
    near = near if itself else near.where("a < b")
    if stored:
        near = written(near, "near")
        items = taking_part(items.select(scope, key, "vector"), near, scope, key)
    for side in "ab":
        near = near.join(items.select(scope, F.col(key).alias(side), F.col("vector").alias(f"_{side}")), [scope, side])
    exact = near.select(scope, "a", "b", F.round(T.dot(F.col("_a"), F.col("_b")), PLACES).alias("cosine")).where(F.col("cosine") >= least)
    return exact.withColumn("cosine", F.least("cosine", F.lit(1.0)))


def name_pairs(items: DataFrame, scope: str, key: str, least: float) -> DataFrame:
    """``(scope, a, b, ratio)``: names whose ratio of matching blocks, a's first, is at least ``least``; each name with itself, too, if it isn't empty.

    A ratio is at most twice the common characters by the characters of both, whatever their order; only pairs that this bound lets through are matched.
    """
    kind = items.schema[key].dataType.simpleString()

    def counts(names: list[str], alphabet: list[str]) -> np.ndarray:
        return np.array([[n.count(c) for c in alphabet] for n in names], dtype="int32").reshape(len(names), len(alphabet))

    def run(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        na, nb = a["name"].tolist(), b["name"].tolist()
        alphabet = sorted(set("".join(na)) & set("".join(nb)))
        ca, cb = counts(na, alphabet), counts(nb, alphabet)
        common = np.zeros((len(na), len(nb)), dtype="int32")
        for k in range(len(alphabet)):
            common += np.minimum.outer(ca[:, k], cb[:, k])
        both = np.add.outer([len(n) for n in na], [len(n) for n in nb])
        found = []
        matcher = difflib.SequenceMatcher(None)
        for j in range(len(nb)):
            rows = np.flatnonzero(2 * common[:, j] >= least * both[:, j] - 1e-9)
            for first, second in (("a", "b"),) if same else (("a", "b"), ("b", "a")):
                if first == "a":
                    matcher.set_seq2(nb[j])
                for i in rows:
                    if not both[i, j]:
                        continue
                    if first == "a":
                        matcher.set_seq1(na[i])
                        ratio = matcher.ratio()
                    else:
                        ratio = difflib.SequenceMatcher(None, nb[j], na[i]).ratio()
                    if ratio >= least:
                        found.append((a[key][i], b[key][j], ratio) if first == "a" else (b[key][j], a[key][i], ratio))
        return pd.DataFrame(found, columns=["a", "b", "ratio"])

    return tiled(items.select(scope, key, "name"), scope, key, run, f"a {kind}, b {kind}, ratio double", BLOCK)


def contained_names(items: DataFrame, scope: str, key: str) -> DataFrame:
    """``(scope, a, b, weight)``: names a that have name b in them, of ``LEAST_NAME`` characters or more, by the ratio of lengths; equal names are one key."""
    names = items.select(scope, key, "name").where(F.length("name") >= LEAST_NAME)
    lengths = names.groupBy(scope).agg(F.array_sort(F.collect_set(F.length("name"))).alias("_lengths"))
    longer = names.join(lengths, scope).select(scope, F.col(key).alias("a"), F.length("name").alias("_n"), "name", F.explode(F.filter("_lengths", lambda n: n < F.length("name"))).alias("_l"))
    cut = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_n") - F.col("_l") + 1), lambda i: F.xxhash64(F.substring(F.col("name"), i, F.col("_l")))))
    pieces = longer.select(scope, "a", "_n", "_l", F.col("name").alias("_whole"), F.explode(cut).alias("_h"))
    found = pieces.join(names.select(scope, F.col(key).alias("b"), F.col("name").alias("_part"), F.length("name").alias("_l"), F.xxhash64("name").alias("_h")), [scope, "_l", "_h"])
    return found.where(F.contains(F.col("_whole"), F.col("_part"))).select(scope, "a", "b", F.round(F.col("_l") / F.col("_n"), 3).alias("weight"))


def _classes(records: DataFrame, scope: str, order: str, value: Column, name: str) -> DataFrame:
    """Records with the class of equal values that they are in, named by its first member."""
    low = records.groupBy(scope, value.alias("_v")).agg(F.min(order).alias(name))
    return records.withColumn("_v", value).join(low, [scope, "_v"]).drop("_v")


def members(records: DataFrame, scope: str, order: str) -> DataFrame:
    """``(scope, order, vector_class, tags_class, name_class, plain_class, category_class, keyword)``: each class by its first member; no category has none.

    Vectors are told by the texts that they are of (:func:`embed.skill_text`).
    """
    plain = T.plain_name(F.col("name"))
    hit = F.lit(False)
    for k in V.PREREQUISITE_KEYWORDS:
        hit = hit | F.coalesce(plain, F.lit("")).contains(k)
    blank = lambda c: F.coalesce(c, F.lit(""))
    df = records.select(
        scope, order, F.md5(embed.skill_text()).alias("_vector"), F.md5(F.to_json(F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))))).alias("_tags"),
        blank(F.lower("name")).alias("_name"), blank(plain).alias("_plain"), blank(F.col("category")).alias("_category"), hit.alias("keyword"),
    )
    for name in ("vector", "tags", "name", "plain", "category"):
        df = _classes(df, scope, order, F.col(f"_{name}"), f"{name}_class")
    df = df.withColumn("category_class", F.when(F.col("_category") != "", F.col("category_class")))
    return df.select(scope, order, *[f"{name}_class" for name in ("vector", "tags", "name", "plain", "category")], "keyword")


def relations(records: DataFrame, scope: str, order: str, known: DataFrame | None = None) -> DataFrame:
    """``(scope, type, layer, a, b, n_a, n_b, weight)``: classes that are related, with their sizes; a class by itself stands for the pairs within it.

    Layers of ``related_to``: vector, tags and category (classes in either order), name (a's records come before b's), units (single records).
    ``extends``: each record of a has the name of each of b in its own; within a class the later extends the earlier. ``prerequisite``: each of a,
    which have a keyword, before each of b, which have none. Records without name, tags, units, category or tokens have no rows of that layer.
    """
    records = written(records.select(scope, order, "name", "description", "best_practices", "pitfalls", "checklist", "references", "tags", "category", "knowledge_ids", "vector"), "records")
    known = known if known is not None else written(members(records, scope, order), "members")
    first = lambda layer: records.join(known.where(F.col(order) == F.col(f"{layer}_class")).select(scope, order), [scope, order], "left_semi")
    sizes = {layer: known.where(F.col(f"{layer}_class").isNotNull()).groupBy(scope, F.col(f"{layer}_class").alias("_c")).agg(F.count(F.lit(1)).alias("_n")) for layer in ("vector", "tags", "name", "plain", "category")}

    def sized(pairs: DataFrame, layer: str) -> DataFrame:
        out = pairs
        for side in "ab":
            out = out.join(sizes[layer].select(scope, F.col("_c").alias(side), F.col("_n").alias(f"n_{side}")), [scope, side])
        return out.where("a <> b OR n_a > 1")

    def row(pairs: DataFrame, kind: str, layer: str, weight: Column) -> DataFrame:
        return pairs.select(scope, F.lit(kind).alias("type"), F.lit(layer).alias("layer"), "a", "b", F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"), weight.cast("double").alias("weight"))

    vectors = sized(cosine_pairs(first("vector"), scope, order, V.RELATED[0], stored=True), "vector")
    tagged = first("tags").where(F.size("tags") > 0).select(scope, order, F.col("tags").alias("items"))
    alike = tagged.select(scope, F.col(order).alias("a"), F.col(order).alias("b"), F.lit(1.0).alias("similarity")).unionByName(similar_sets(tagged, scope, order, V.RELATED[1]))
    named = first("name").select(scope, order, F.lower("name").alias("name")).where("name <> ''")
    names = sized(name_pairs(named, scope, order, V.RELATED[2]), "name")
    units = similar_sets(records.select(scope, order, F.col("knowledge_ids").alias("items")), scope, order, V.RELATED[3]).where(F.col("similarity") > V.RELATED[3])
    itself = lambda layer: sizes[layer].where("_n > 1").select(scope, F.col("_c").alias("a"), F.col("_c").alias("b"), F.col("_n").alias("n_a"), F.col("_n").alias("n_b"))
    plain = first("plain").select(scope, order, T.plain_name(F.col("name")).alias("name"))
    inside = sized(contained_names(plain, scope, order), "plain")
    equal = itself("plain").join(plain.where(F.length("name") >= LEAST_NAME).select(scope, F.col(order).alias("a")), [scope, "a"], "left_semi")
    by = known.groupBy(scope).agg(*[f.alias(n) for n, f in {"a": F.min(F.when(F.col("keyword"), F.col(order))), "b": F.min(F.when(~F.col("keyword"), F.col(order))), "n_a": F.count_if("keyword"), "n_b": F.count_if(~F.col("keyword"))}.items()]).where("n_a > 0 AND n_b > 0")
    return (
        row(vectors, "related_to", "vector", F.round("cosine", 3)).unionByName(row(sized(alike, "tags"), "related_to", "tags", F.round("similarity", 3))).unionByName(row(names, "related_to", "name", F.round("ratio", 3)))
        .unionByName(row(units.withColumns({"n_a": F.lit(1), "n_b": F.lit(1)}), "related_to", "units", F.lit(0.5))).unionByName(row(itself("category"), "related_to", "category", F.lit(0.4)))
        .unionByName(row(inside, "extends", "name", F.col("weight"))).unionByName(row(equal, "extends", "name", F.lit(1.0))).unionByName(row(by, "prerequisite", "keyword", F.lit(1.0)))
    )


def expanded(found: DataFrame, known: DataFrame, scope: str, order: str) -> DataFrame:
    """The pairs of records that class rows stand for: ``(scope, source, target, type, weight)``, as many as there are, so for scopes of bounded size."""

    def sides(rows: DataFrame, column: str) -> DataFrame:
        out = rows
        for side in "ab":
            out = out.join(known.select(scope, F.col(column).alias(side), F.col(order).alias(f"r_{side}")), [scope, side])
        return out.where("r_a <> r_b")

    pairs = None
    for rank, layer in enumerate(LAYERS):
        rows = found.where((F.col("type") == "related_to") & (F.col("layer") == layer))
        made = sides(rows, order if layer == "units" else f"{layer}_class")
        made = made.where("r_a < r_b") if layer == "name" else made
        made = made.select(scope, F.least("r_a", "r_b").alias("source"), F.greatest("r_a", "r_b").alias("target"), F.struct(F.lit(rank).alias("rank"), "weight").alias("w"))
        pairs = made if pairs is None else pairs.unionByName(made)
    related = pairs.groupBy(scope, "source", "target").agg(F.min("w").alias("w")).select(scope, "source", "target", F.lit("related_to").alias("type"), F.col("w.weight").alias("weight"))
    extends = sides(found.where("type = 'extends'"), "plain_class").where("a <> b OR r_a > r_b").select(scope, F.col("r_a").alias("source"), F.col("r_b").alias("target"), "type", "weight")
    before = found.where("type = 'prerequisite'").select(scope, "type", "weight")
    needs = before.join(known.where("keyword").select(scope, F.col(order).alias("source")), scope).join(known.where("NOT keyword").select(scope, F.col(order).alias("target")), scope)
    return related.unionByName(extends).unionByName(needs.select(scope, "source", "target", "type", "weight"))


def duplicate_pairs(records: DataFrame, scope: str, order: str) -> DataFrame:
    """``(scope, a, b, cosine)`` of records a < b that are duplicates: by their vectors, or by names and contents at once."""
    close = written(cosine_pairs(records, scope, order, V.DUPLICATE[0], stored=True, itself=False), "close")
    body = F.concat_ws(" ", "description", F.array_join("best_practices", " "), F.array_join("pitfalls", " "), F.array_join("checklist", " "))
    alike = similar_sets(records.select(scope, order, T.content_tokens(body).alias("items")), scope, order, V.DUPLICATE[2])
    alike = written(alike.select(scope, "a", "b").join(close.select(scope, "a", "b"), [scope, "a", "b"], "left_anti"), "alike")
    told = taking_part(records.select(scope, order, "vector", F.lower(F.regexp_replace("name", r"[^a-zA-Z0-9\s]", "")).alias("p")), alike, scope, order)
    for side in "ab":
        alike = alike.join(told.select(scope, F.col(order).alias(side), F.col("p").alias(f"p_{side}"), F.col("vector").alias(f"v_{side}")), [scope, side])
    named = alike.where(name_ratio(F.col("p_a"), F.col("p_b")) >= V.DUPLICATE[1])
    return close.unionByName(named.select(scope, "a", "b", F.round(T.dot(F.col("v_a"), F.col("v_b")), PLACES).alias("cosine")))


def survivors(records: DataFrame, scope: str, order: str) -> DataFrame:
    """Order-dependent removal of duplicates in each scope: the better of two stays, the newer at the end.

    A record meets the first earlier duplicate that is still there; of the two the one of higher quality stays, the earlier if they are equal. Returns
    ``(scope, order, survivor, method, similarity)``: the record into which each one goes at last, and what it was
    removed for (null for survivors), semantic or lexical, with the cosine of the two. All scopes are decided in rounds over the table of duplicate
    pairs: a record as soon as it is known what becomes of those earlier duplicates that come before its own, so the least open one always. No task
    takes a scope; the rounds are as many as decisions wait for each other, and each is written.
    """
    records = written(records.select(scope, order, *[c for c in ("name", "description", "best_practices", "pitfalls", "checklist", "vector") if c in records.columns], "quality_score"), "records")
    pairs = duplicate_pairs(records, scope, order)
    scores = records.select(scope, order, F.col("quality_score").alias("q"))
    for side in "ab":
        pairs = pairs.join(scores.select(scope, F.col(order).alias(side), F.col("q").alias(f"q_{side}")), [scope, side])
    pairs = written(pairs, "duplicates")
    kind = records.schema[order].dataType.simpleString()
    # what is known of a record: whether it came in, which earlier record it met, and who removed it
    state = written(pairs.select(scope, F.col("a").alias("r")).unionByName(pairs.select(scope, F.col("b").alias("r"))).distinct().select(scope, "r", F.lit(None).cast("boolean").alias("came"), F.lit(None).cast(kind).alias("met"), F.lit(None).cast(kind).alias("gone")), "state")
    while state.where("came IS NULL").limit(1).count():
        named = lambda side: state.select(scope, F.col("r").alias(side), F.col("came").alias(f"came_{side}"), F.col("gone").alias(f"gone_{side}"))  # noqa: E731, B023
        open_ = pairs.join(named("b"), [scope, "b"])
        waits = open_.where("came_b IS NULL AND q_b > q_a").groupBy(scope, "a").agg(F.min("b").alias("threat"))  # the first that may yet remove a
        seen = open_.where("came_b IS NULL").join(named("a"), [scope, "a"]).join(waits, [scope, "a"], "left")
        dead = F.coalesce(~F.col("came_a"), F.lit(False)) | F.coalesce(F.col("gone_a") < F.col("b"), F.lit(False))
        unsure = F.col("came_a").isNull() | F.coalesce(F.col("threat") < F.col("b"), F.lit(False))
        first = seen.groupBy(scope, "b").agg(F.min(F.when(~dead, F.struct("a", unsure.alias("unsure"), (F.col("q_b") > F.col("q_a")).alias("better")))).alias("x"))
        alone = state.where("came IS NULL").join(pairs.select(scope, F.col("b").alias("r")).distinct(), [scope, "r"], "left_anti").select(scope, "r", F.lit(True).alias("now"), F.lit(None).cast(kind).alias("own"))
        now = first.where("x IS NULL OR NOT x.unsure").select(scope, F.col("b").alias("r"), F.coalesce("x.better", F.lit(True)).alias("now"), F.col("x.a").alias("own")).unionByName(alone)
        now = written(now, "decided")
        removed = now.where("now AND own IS NOT NULL").select(scope, F.col("own").alias("r"), F.col("r").alias("by"))
        after = state.join(now, [scope, "r"], "left").join(removed, [scope, "r"], "left")
        state = written(after.select(scope, "r", F.coalesce("came", "now").alias("came"), F.coalesce("met", "own").alias("met"), F.coalesce("gone", "by").alias("gone")), "state")
    into = written(state.select(scope, "r", F.coalesce(F.when(~F.col("came"), F.col("met")), F.col("gone"), F.col("r")).alias("to")), "into")
    why = into.where("r <> to").select(scope, "r", "to", F.least("r", "to").alias("a"), F.greatest("r", "to").alias("b")).join(pairs.select(scope, "a", "b", "cosine"), [scope, "a", "b"])
    causes = why.select(scope, F.col("r").alias(order), F.when(F.col("cosine") >= V.DUPLICATE[0], F.lit("semantic")).otherwise(F.lit("lexical")).alias("method"), F.round("cosine", 4).alias("similarity"))
    while True:  # each points twice as far as before
        further = written(into.join(into.select(scope, F.col("r").alias("to"), F.col("to").alias("next")), [scope, "to"]).select(scope, "r", F.col("next").alias("to")), "into")
        done = further.join(into.withColumnRenamed("to", "was"), [scope, "r"]).where("to <> was").limit(1).count() == 0
        into = further
        if done:
            break
    ends = into.select(scope, F.col("r").alias(order), F.col("to").alias("survivor"))
    return records.select(scope, order).join(ends, [scope, order], "left").join(causes, [scope, order], "left").select(scope, order, F.coalesce("survivor", order).alias("survivor"), "method", "similarity")
