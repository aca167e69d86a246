"""How far the sources of a language differ in their words: exact sums over all kept terms for every pair of sources.

Terms are split by the number of sources that have them. Terms of many sources (heavy) become rows of dense numpy tiles in which absent
sources have their count of 0. Rare terms (light) are never made dense: if neither of two sources has a term its part depends on the two sources
only, so that all light terms together give this part times their number; what a term adds where one source has it depends on its count there
and is taken from a histogram of counts; and where both have it, from its posting pairs. The partial sums are integers and are added exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm.common import bound_batches, materialise, small_side

#: Runs of ASCII letters and of characters beyond ASCII, in lower-cased UTF-8.
TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
RANKS = 200
#: A term is heavy if more than one in so many sources of its language have it, and more than ``LIGHT`` do.
HEAVY_SHARE, LIGHT = 4, 8
#: Sources of a side of a dense tile, and pairs that are computed at once.
TILE, CELLS = 256, 2_000_000
#: Distinct terms that a task counts before it hands them on, rows that it hands on at once, and bytes of text from which terms are counted one by one.
HELD, ROWS, LONG = 150_000, 20_000, 1_000_000
#: Groups of a language and source up to which the operator works; every two of a language are a row of its result.
MOST_GROUPS = 2_000_000
_COUNTS = pa.schema([("at", pa.int32()), ("g", pa.int32()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_SUMS = pa.schema([("at", pa.int32()), ("g", pa.int32()), ("h", pa.int32()), ("value", pa.int64())])
_SUMS_SQL = "at int, g int, h int, value long"


def counted(ids):
    """Occurrences and documents of each term by language and source, as numbered in ``ids``, summed over a task as long as it holds few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[Counter, Counter]] = {}

        def made() -> Iterator[pa.RecordBatch]:
            while held:
                (at, g), (terms, docs) = held.popitem()
                words = list(terms)
                for k in range(0, len(words), ROWS):
                    part = words[k : k + ROWS]
                    columns = [np.full(len(part), at, "int32"), np.full(len(part), g, "int32"), part, list(map(terms.__getitem__, part)), list(map(docs.__getitem__, part))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _COUNTS, strict=True)], schema=_COUNTS)

        for batch in batches:
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                terms, docs = held.setdefault(ids.value[lang, source], (Counter(), Counter()))
                low = text.lower()  # bytes: A-Z only
                if len(low) < LONG:
                    found = TERM.findall(low)
                    terms.update(found)
                    docs.update(set(found))
                else:
                    own = Counter(m.group() for m in TERM.finditer(low))
                    terms.update(own)
                    docs.update(own.keys())
            if sum(len(terms) for terms, _ in held.values()) > HELD:
                yield from made()
        yield from made()

    return run


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / whole), by long division in steps of 1000, so that no product leaves 64 bits."""
    out, rest = np.zeros(np.broadcast(counts, whole).shape, "int64"), counts + 1
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def parts(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    d = p - q
    return d * d // q


def _emit(at, g, h, value) -> pa.RecordBatch:
    n = len(value)
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(x), n).astype(f.type.to_pandas_dtype())) for x, f in zip((at, g, h, value), _SUMS, strict=True)], schema=_SUMS)


def _heavy(wholes):
    """Dense tiles: for each key (language, tile of p, tile of q), the sum over the terms that follow each other in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, None
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in ("at", "tg", "th")), strict=True))
            lists = batch["posting"]
            ends, gs, ns = np.array(lists.offsets), np.array(lists.values.field("g")), np.array(lists.values.field("n"))
            i = 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if keys[i] != key:
                    if sums is not None:
                        yield _tile(key[0], key[1] * TILE, key[2] * TILE, sums)
                    key, sums = keys[i], None
                whole = wholes.value[key[0]]
                sides = []
                for tile in key[1:]:
                    low, high = tile * TILE, min((tile + 1) * TILE, len(whole))
                    counts = np.zeros((j - i, high - low), "int64")
                    for k in range(i, j):
                        g, n = gs[ends[k] : ends[k + 1]], ns[ends[k] : ends[k + 1]]
                        own = (g >= low) & (g < high)
                        counts[k - i, g[own] - low] = n[own]
                    sides.append(shares(counts, whole[low:high]))
                if sums is None:
                    sums = np.zeros((sides[0].shape[1], sides[1].shape[1]), "int64")
                step = max(1, CELLS // sums.size)
                for k in range(0, j - i, step):
                    sums += parts(sides[0][k : k + step, :, None], sides[1][k : k + step, None, :]).sum(axis=0)
                i = j
        if sums is not None:
            yield _tile(key[0], key[1] * TILE, key[2] * TILE, sums)

    return run


def _tile(at: int, first_g: int, first_h: int, sums: np.ndarray) -> pa.RecordBatch:
    g, h = np.indices(sums.shape)
    return _emit(at, g.ravel() + first_g, h.ravel() + first_h, sums.ravel())


def _light(wholes):
    """Posting pairs: what two sources that both have a term add, beyond what each adds alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, lists = np.array(batch["at"]), batch["posting"]
            ends, gs, ns = np.array(lists.offsets, dtype="int64"), np.array(lists.values.field("g"), dtype="int64"), np.array(lists.values.field("n"))
            sizes = np.diff(ends)
            for at in np.unique(ats):
                whole, rows = wholes.value[at], np.flatnonzero((ats == at) & (sizes > 1))
                firsts = np.concatenate([[0], np.cumsum(sizes[rows] ** 2)])
                low = 0
                while low < len(rows):
                    high = max(low + 1, int(np.searchsorted(firsts, firsts[low] + CELLS, side="right")) - 1)
                    a, b = (np.concatenate(x) for x in zip(*((np.repeat(np.arange(ends[r], ends[r + 1]), sizes[r]), np.tile(np.arange(ends[r], ends[r + 1]), sizes[r])) for r in rows[low:high]), strict=True))
                    a, b = a[a != b], b[a != b]
                    pg, ph, p0, q0 = shares(ns[a], whole[gs[a]]), shares(ns[b], whole[gs[b]]), shares(np.int64(0), whole[gs[a]]), shares(np.int64(0), whole[gs[b]])
                    value = parts(pg, ph) - parts(pg, q0) - parts(p0, ph) + parts(p0, q0)
                    pairs, where = np.unique(gs[a] * len(whole) + gs[b], return_inverse=True)
                    sums = np.zeros(len(pairs), "int64")
                    np.add.at(sums, where, value)
                    yield _emit(at, pairs // len(whole), pairs % len(whole), sums)
                    low = high

    return run


def _alone(wholes):
    """The histogram's part: what the light terms of one source add, by count, against every source that lacks them, in both directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, g, counts, terms in zip(*(batch[c].to_pylist() for c in ("at", "g", "counts", "terms")), strict=True):
                whole = wholes.value[at]
                none, own, base = shares(np.int64(0), whole), shares(np.array(counts), whole[g]), shares(np.int64(0), whole[g])
                there, back = np.zeros(len(whole), "int64"), np.zeros(len(whole), "int64")
                step = max(1, CELLS // len(whole))
                for k in range(0, len(counts), step):
                    p, n = own[k : k + step, None], np.array(terms[k : k + step])[:, None]
                    there += ((parts(p, none) - parts(base, none)) * n).sum(axis=0)
                    back += ((parts(none, p) - parts(none, base)) * n).sum(axis=0)
                others = np.arange(len(whole))
                yield _emit(at, g, others, there)
                yield _emit(at, others, g, back)

    return run


def _absent(wholes, lights):
    """What all light terms would add if no source had any: a row for every two sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, g in zip(batch["at"].to_pylist(), batch["g"].to_pylist(), strict=True):
                none = shares(np.int64(0), wholes.value[at])
                yield _emit(at, g, np.arange(len(none)), parts(none[g], none) * lights[at])

    return run


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: for each source its divergence from every other of its language (``pair``), and its most telling terms (``term``).

    Null text, lang and source count as ''. A group without terms gives and gets pairs like others; a language without kept terms has value 0 for all its pairs; a
    source that is alone in its language has none. Terms are kept if 3 rows of their language have them (repeated rows count each). Ties in value
    go by the item's bytes. doc_id and other columns are left out; no rows give none. A driver and its tasks hold a number for each group;
    more than ``MOST_GROUPS`` of them are refused, as every two of a language are a row of the result.
    """
    spark = docs.sparkSession
    columns = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")) for c in ("lang", "source", "text")]
    bound_batches(spark)
    whole = docs.select(columns[0].alias("lang"), columns[1].alias("source"), columns[2].cast("binary").alias("text"))
    groups = [tuple(r) for r in whole.select("lang", "source").distinct().limit(MOST_GROUPS + 1).collect()]
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups of a language and source")
    groups.sort(key=lambda x: (x[0].encode(), x[1].encode()))
    langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in groups))}
    names: list[list[str]] = [[] for _ in langs]
    ids = {}
    for lang, source in groups:
        ids[lang, source] = (langs[lang], len(names[langs[lang]]))
        names[langs[lang]].append(source)
    kinds = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("g", T.IntegerType())])
    numbered = small_side(spark.createDataFrame([(lang, source, at, g) for lang, at in langs.items() for g, source in enumerate(names[at])], kinds), len(groups))
    extent = small_side(spark.createDataFrame([(at, len(x)) for at, x in enumerate(names)], "at int, m int"), len(names))

    counts = whole.mapInArrow(counted(spark.sparkContext.broadcast(ids)), "at int, g int, term binary, n long, docs long").groupBy("at", "g", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    posted = counts.groupBy("at", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("g", "n")).alias("posting")).where(F.col("docs") >= LEAST_DOCUMENTS)
    posted = posted.join(extent, "at").select("at", F.col("term").cast("string").alias("term"), "n", F.array_sort("posting").alias("posting"), "m")
    few = F.size("posting")
    posted = materialise(posted.select("at", "term", "n", "posting", "m", ((few > LIGHT) & (few * HEAVY_SHARE > F.col("m"))).alias("heavy")), "postings")
    kept = {r["at"]: r for r in posted.groupBy("at").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n"), F.count_if(~F.col("heavy")).alias("light")).collect()}
    sizes = [np.full(len(x), kept[at]["v"] if at in kept else 0, "int64") for at, x in enumerate(names)]
    for r in posted.select("at", F.explode("posting").alias("x")).groupBy("at", "x.g").agg(F.sum("x.n").alias("n")).toLocalIterator():
        sizes[r["at"]][r["g"]] += r["n"]
    wholes = spark.sparkContext.broadcast([np.maximum(x, 1) for x in sizes])  # a number for each group; 1 where a language keeps no terms
    lights = [int(kept[at]["light"]) if at in kept else 0 for at in range(len(names))]

    tiles = lambda c: F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / TILE).cast("int"))).alias(c)
    heavy = posted.where("heavy").select("at", "m", "posting", tiles("tg")).select("at", "m", "posting", "tg", tiles("th"))
    in_tile = lambda x: F.floor(x["g"] / TILE).isin(F.col("tg"), F.col("th"))
    heavy = heavy.select("at", "tg", "th", F.filter("posting", in_tile).alias("posting")).sortWithinPartitions("at", "tg", "th")
    light = posted.where(~F.col("heavy"))
    alone = light.select("at", F.explode("posting").alias("x")).groupBy("at", "x.g", "x.n").agg(F.count(F.lit(1)).alias("terms")).groupBy("at", "g").agg(F.collect_list(F.struct("n", "terms")).alias("x"))
    alone = alone.select("at", "g", F.col("x.n").alias("counts"), F.col("x.terms").alias("terms"))
    ids = numbered.select("at", "g").repartition("at", "g")
    sums = (
        heavy.mapInArrow(_heavy(wholes), _SUMS_SQL).unionByName(light.select("at", "posting").mapInArrow(_light(wholes), _SUMS_SQL))
        .unionByName(alone.mapInArrow(_alone(wholes), _SUMS_SQL)).unionByName(ids.mapInArrow(_absent(wholes, lights), _SUMS_SQL))
    )
    sums = sums.where("g <> h").groupBy("at", "g", "h").agg(F.sum("value").alias("value"))
    own = numbered.select("lang", "source", "at", "g")
    pairs = sums.join(own, ["at", "g"]).join(numbered.select("at", F.col("g").alias("h"), F.col("source").alias("item")), ["at", "h"]).select("lang", "source", "item", "value")

    facts = spark.createDataFrame([(at, g, int(n), int(kept[at]["v"] + kept[at]["n"])) for at, x in enumerate(sizes) if at in kept for g, n in enumerate(x)], "at int, g int, own long, all long")
    share = lambda n, whole: F.expr(f"1 + (cast({n} + 1 AS decimal(20,0)) * {SCALE}BD) div cast({whole} AS decimal(20,0))")
    told = posted.select("at", "term", F.col("n").alias("total"), F.explode("posting").alias("x")).select("at", "term", "total", "x.g", "x.n").join(small_side(facts, len(groups)), ["at", "g"])
    told = told.select("at", "g", "term", share("n", "own").alias("p"), share("total", "all").alias("q")).where("p > q").select("at", "g", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    told = told.join(own, ["at", "g"]).select("lang", "source", "item", "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(by)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionByName(ranked(told, "term").where(F.col("rank") <= RANKS))
