"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Every document's shingles are put in one order, rare ones first. A prefix of ``size - ceil(t * size) + k`` shingles shares at
least ``k`` with the equally built prefix of every document that is similar to degree ``t``. Each document picks its
own ``k``: a longer prefix means more postings to read, but candidates must share more of them before they are verified, so ``k`` is
where the estimated cost of both is least. Of a pair, the smaller ``k`` holds. Documents of one shingle set take part once.

The index of all documents orders shingles by frequencies estimated from a sample; documents that cannot meet the least
requirement of any partner are peeled off by counts alone. Those left are indexed whole, so that frequencies are exact, peeled again, and
get their final prefixes. Candidates are counted first between the documents of a shingle and one of them, its hub, which joins
large groups of near copies by a number of pairs in proportion to the postings; then between documents that share
prefix shingles and are still in different components. These are dealt in blocks of bounded size, a pair of blocks to a task, which counts
shared prefix shingles by inverted lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import bound_batches, components, materialise, small_side, with_text

WORDS = 5
#: Similarity 0.8 as a ratio of whole numbers.
SHARED, OF = 80, 100
#: Shingles with a place of their own in the order: the most frequent of the sample. Others count as rare.
FREQUENT = 65_536
#: Share of documents, by hash of doc_id, from which frequencies are estimated; the counts stay on the executors.
SAMPLE = 0.05
#: Estimated documents of a shingle from which its postings are counted by classes of size, not listed in one task.
HOT = 20_000
#: A document requires at least one match for so many of its shingles in the first index.
MATCH_PART = 25
#: Cost of verifying a candidate for each of a document's shingles, and of indexing a shingle, in postings read.
VERIFY, INDEX = 0.25, 4.0
#: Estimated postings of a prefix up to which it is left as short as can be.
FEW = 256
#: Rounds of candidates by hubs; shingles of the documents of a block, roughly; shared shingles that are counted at once.
ROUNDS, BLOCK, SHARED_AT_ONCE = 2, 120_000, 2_000_000
#: Digests of sets that a task remembers, to send the prefix of a copy once.
MEMO_SETS = 200_000
_FACTOR = np.uint64(0xD1342543DE82EF95)


class Shingler:
    """64-bit hashes of a text's distinct word shingles."""

    def __init__(self, words: int = WORDS):
        self.words = words

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; one for the whole sequence if it is short, none without words."""
        tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not tokens:
            return np.empty(0, np.uint64)
        h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, tokens)), "<u8")
        width = min(self.words, len(h))
        n = len(h) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = out * _FACTOR + h[k : k + n]
        return np.unique(_mixed(out))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_match(size: np.ndarray | int):
    """The matches that every document of a size requires at least; grows with the size."""
    return np.maximum(1, np.asarray(size) // MATCH_PART)


def needed(size):
    """ceil(t * size): the least overlap of a document with any similar one."""
    return (np.asarray(size) * SHARED + OF - 1) // OF


class Prefixes:
    """Orders shingles by estimated frequency and cuts adaptive prefixes."""

    def __init__(self, frequent: np.ndarray, estimates: np.ndarray):
        self.frequent, self.estimates = frequent, estimates

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(self.frequent, shingles), len(self.frequent) - 1)
        return np.where(self.frequent[at] == shingles, self.estimates[at], 0)

    def cut(self, shingles: np.ndarray) -> tuple[np.ndarray, int]:
        """The prefix and the number of matches it stands for."""
        n = len(shingles)
        if not n:
            return shingles, 0
        weight = self.weights(shingles)
        order = np.argsort(weight, kind="stable")  # shingles are in order of hash
        overlap = int(needed(n))
        least = int(least_match(n))
        first = n - overlap + least
        read = np.cumsum(weight[order])[first - 1 :]  # postings of the prefixes for least, least + 1, ... overlap matches
        match = least
        if read[0] > FEW:
            matches = np.arange(least, overlap + 1)
            match = int(matches[np.argmin(INDEX * matches + read + VERIFY * n * read / matches)])
        return shingles[order[: n - overlap + match]], match


def _mark(shingles: np.ndarray) -> int:
    """The digest of a set, by which copies are told."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles)) - (1 << 63)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _lists(parts: list[np.ndarray], empty: list[bool]) -> pa.Array:
    """Arrow lists of signed 64-bit numbers."""
    sizes = np.array([0 if e else len(p) for p, e in zip(parts, empty, strict=True)], np.int64)
    flat = np.concatenate([p for p, e in zip(parts, empty, strict=True) if not e] or [np.empty(0, np.uint64)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), _signed(flat))


def frequent_shingles(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in three or more documents of a sample by hash of doc_id, the most frequent ``FREQUENT`` of them,
    and their estimated document frequencies. Only the order of shingles, and so the cost, depends on it."""
    hashed = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    chosen = docs.where(hashed < int(SAMPLE * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            seen: set[int] = set()
            for text in batch.column(1):
                s = shingler(text.as_py())
                mark = _mark(s)
                if len(s) and mark not in seen:
                    seen.add(mark)
                    yield pa.RecordBatch.from_arrays([_signed(s)], ["s"])

    counted = chosen.mapInArrow(run, "s long").groupBy("s").count().where("count >= 3")
    top = counted.orderBy(F.desc("count"), "s").limit(FREQUENT).toLocalIterator()
    rows = [(r["s"], r["count"]) for r in top]  # FREQUENT at most
    s = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    n = (np.array([r[1] for r in rows], np.int64) / SAMPLE).astype(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def prefix_table(docs: DataFrame, frequent: Broadcast, words: int = WORDS) -> DataFrame:
    """Per document: doc_id, n_shingles, 64-bit digest of the set, required matches and prefix; copies met again in a task have no prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, prefixes, seen = Shingler(words), Prefixes(*frequent.value), set()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sizes, marks, matches, parts, again = [], [], [], [], []
                for text in part.column(1):
                    s = shingler(text.as_py())
                    mark = _mark(s)
                    prefix, match = prefixes.cut(s)
                    if len(seen) > MEMO_SETS:
                        seen.clear()
                    again.append(mark in seen)
                    seen.add(mark)
                    sizes.append(len(s))
                    marks.append(mark)
                    matches.append(match)
                    parts.append(prefix)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.int64()), pa.array(matches, pa.int32()), _lists(parts, again)],
                    ["doc_id", "n_shingles", "mark", "match", "prefix"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, mark long, match int, prefix array<long>")


def _compatible(a: Column, b: Column) -> Column:
    return (a * OF >= b * SHARED) & (b * OF >= a * SHARED)


def live_postings(index: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Postings whose shingle occurs in another document of a size that allows a link; ``n`` has the shingle's documents.

    One shuffle of the postings: in order of size, the nearest neighbour tells. Shingles in ``hot(s)``, a table of at most ``FREQUENT``
    rows, are counted by classes of size instead, in which sizes that allow a link are at most one apart; that may keep a
    few postings more, and no task lists such a shingle's documents.
    """
    columns = index.columns
    if hot is not None:
        size_class = F.floor(F.log("size") / math.log(OF / SHARED)).cast("int")
        held = index.join(F.broadcast(hot), "s", "left_semi").withColumn("c", size_class)
        counts = held.groupBy("s", "c").agg(F.count(F.lit(1)).alias("m"))  # combined before the shuffle
        every = counts.groupBy("s").agg(F.sum("m").alias("n"), F.map_from_entries(F.collect_list(F.struct("c", "m"))).alias("by"))
        beside = lambda d: F.coalesce(F.try_element_at("by", F.col("c") + d), F.lit(0))
        kept = held.join(F.broadcast(every), "s").where(beside(-1) + beside(0) + beside(1) > 1).select(*columns, "n")
        index = index.join(F.broadcast(hot), "s", "left_anti")
    across = Window.partitionBy("s")
    along = across.orderBy("size", "d")
    near = index.withColumns({"_p": F.lag("size").over(along), "_q": F.lead("size").over(along), "n": F.count(F.lit(1)).over(across)})
    near = near.where((F.col("_p") * OF >= F.col("size") * SHARED) | (F.col("size") * OF >= F.col("_q") * SHARED)).drop("_p", "_q")
    return near if hot is None else near.select(*columns, "n").unionByName(kept)


def peel(live: DataFrame, least: Column, tag: str, passes: int = 3, hot: DataFrame | None = None) -> DataFrame:
    """Postings of documents with at least ``least`` live shingles, a bound that any document with a partner meets; each pass may free more."""
    rows, before = materialise(live, tag), -1
    for _ in range(passes):
        count = rows.count()
        if count == 0 or before > 0 and count > 0.97 * before:
            break
        before = count
        alive = rows.groupBy("d", "size").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= least).select("d")
        rows = materialise(live_postings(rows.drop("n").join(alive, "d"), hot), tag)
    return rows


def whole_postings(docs: DataFrame, alive: DataFrame, words: int) -> DataFrame:
    """The longest prefixes, whole sets, of the sets in ``alive(d, id)``, where ``id`` is the key of a document that has the set."""
    rows = alive.count()
    held = docs.join(small_side(alive.select("id").distinct(), rows), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                sets = [shingler(text.as_py()) for text in batch.slice(start, 256).column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([_mark(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets, [False] * len(sets))], ["d", "size", "s"])

    sets = held.select("text").mapInArrow(run, "d long, size long, s array<long>")
    return sets.join(small_side(alive.select("d"), rows), "d", "left_semi").dropDuplicates(["d"]).select("d", "size", F.explode("s").alias("s"))


def _needed(size: str) -> Column:
    return F.floor((F.col(size) * SHARED + OF - 1) / OF)


def adaptive(rows: DataFrame) -> DataFrame:
    """The final prefixes, ``(s, d, size, live, at, match, weight)``, of documents with postings ``(s, d, size, n)``.

    ``weight`` is how many other documents a shingle of the document has on average: most for those in the middle of a group of near copies.

    Shingles that no other document has come first in the order and need no rows: with ``live`` others, the prefix for ``k`` matches ends at
    their number ``live - needed + k``. Of all ``k``, that of the least cost is taken, where a prefix with ``p`` postings of other documents
    has at most ``p / k`` candidates; up to ``FEW`` postings it is 1.
    """
    own = Window.partitionBy("d")
    order = own.orderBy("n", "s")
    placed = rows.withColumns({"live": F.count(F.lit(1)).over(own), "weight": F.sum(F.col("n") - 1).over(own) / F.col("size"), "at": F.row_number().over(order), "_p": F.sum(F.col("n") - 1).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    k = F.col("at") - F.col("live") + _needed("size")
    first = F.max(F.when(k == 1, F.col("_p"))).over(own)
    cost = F.when(k >= 1, F.col("_p") * (1 + VERIFY * F.col("size") / k))
    placed = placed.withColumns({"_k": k, "_first": first, "_cost": cost}).withColumn("_least", F.min("_cost").over(own))
    best = F.min(F.when(F.col("_cost") == F.col("_least"), F.col("_k"))).over(own)
    placed = placed.withColumn("match", F.when(F.col("_first") <= FEW, F.lit(1)).otherwise(best).cast("int"))
    return placed.where("_k <= match").select("s", "d", "size", "live", "at", "match", "weight")


def grouped(prefixes: DataFrame, member: DataFrame | None) -> DataFrame:
    """Prefixes with ``comp``, the component of their document so far, itself if it has none."""
    if member is None:
        return prefixes.withColumn("comp", F.col("d"))
    return prefixes.join(member.select(F.col("node").alias("d"), "component"), "d", "left").withColumn("comp", F.coalesce("component", "d")).drop("component")


def hub_pairs(postings: DataFrame, turn: int) -> DataFrame:
    """Candidates ``(a, b)`` between the documents of each shingle and one of them: at first that of the most weight, then one by a hash that differs from turn to turn."""
    rank = F.struct(-F.col("weight") if turn == 0 else F.lit(0.0), F.xxhash64("d", F.lit(turn)))
    hub = F.min(F.struct(rank.alias("h"), *[F.col(c).alias(f"{c}_a") for c in ("d", "size", "match", "comp")]))
    hubs = postings.groupBy("s").agg(hub.alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("s", "hub.*").drop("h")
    beside = postings.select("s", *[F.col(c).alias(f"{c}_b") for c in ("d", "size", "match", "comp")]).join(hubs, "s")
    return matched(beside.where((F.col("comp_a") != F.col("comp_b")) & _compatible(F.col("size_a"), F.col("size_b"))))


def matched(shared: DataFrame) -> DataFrame:
    """Pairs that share as many prefix shingles as the lesser requirement of the two; a row of ``shared`` is a shared one."""
    counted = shared.groupBy(F.least("d_a", "d_b").alias("a"), F.greatest("d_a", "d_b").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min(F.least("match_a", "match_b")).alias("k"))
    return counted.where("c >= k").select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are similar: their sets compared whole."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("d").alias(side), F.col("size").alias(f"size_{side}"), F.col("shingles").alias(f"set_{side}")), side)
    common = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.withColumn("c", common).where(F.col("c") * OF >= (F.col("size_a") + F.col("size_b") - F.col("c")) * SHARED).select("a", "b")


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For runs of ``left`` sets, the number of the first and how many elements each shares with every ``right`` set, by inverted lists."""
    owner = np.repeat(np.arange(len(right)), [len(x) for x in right])
    flat = np.concatenate(right)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    low, high = (np.searchsorted(flat, np.concatenate(left), side) for side in ("left", "right"))
    ends = np.cumsum([len(x) for x in left])
    reads = np.concatenate(([0], np.cumsum(high - low)))[np.concatenate(([0], ends))]
    first = 0
    while first < len(left):
        last = max(first + 1, int(np.searchsorted(reads, reads[first] + SHARED_AT_ONCE, "right")) - 1)
        begin = ends[first] - len(left[first])
        n = (high - low)[begin : ends[last - 1]]
        at = np.repeat(low[begin : ends[last - 1]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        row = np.repeat(np.repeat(np.arange(last - first), [len(x) for x in left[first:last]]), n)
        yield first, np.bincount(row * len(right) + owner[at], minlength=(last - first) * len(right)).reshape(last - first, len(right))
        first = last


def linked(group: pd.DataFrame, x: int, y: int) -> list[tuple[int, int]]:
    """Links between documents of different components in blocks x and y (or within one), as many as span what they connect."""
    group = group.sort_values("d", ignore_index=True)
    sides = [np.flatnonzero(group["block"].to_numpy() == b) for b in (x, y)]
    if not len(sides[0]) or not len(sides[1]):
        return []
    ids, size, match = (group[c].to_numpy() for c in ("d", "size", "match"))
    comp = np.unique(group["comp"], return_inverse=True)[1]
    prefix, sets = group["prefix"].tolist(), [np.sort(v) for v in group["shingles"]]
    forest, out = _Forest(int(comp.max()) + 1), []
    right = sides[1]
    for first, counts in shared_counts([prefix[i] for i in sides[0]], [prefix[j] for j in right]):
        left = sides[0][first : first + len(counts)]
        a, b = size[left][:, None], size[right][None, :]
        candidate = (counts >= np.minimum(match[left][:, None], match[right][None, :])) & (a * OF >= b * SHARED) & (b * OF >= a * SHARED) & (comp[left][:, None] != comp[right][None, :])
        for r, c in zip(*np.nonzero(candidate), strict=True):
            i, j = int(left[r]), int(right[c])
            if (x == y and i >= j) or forest.find(comp[i]) == forest.find(comp[j]):
                continue
            common = int((np.searchsorted(sets[j], sets[i], "right") > np.searchsorted(sets[j], sets[i], "left")).sum())
            if common * OF >= (size[i] + size[j] - common) * SHARED:
                forest.union(comp[i], comp[j])
                out.append((int(ids[i]), int(ids[j])))
    return out


def seats(postings: DataFrame) -> DataFrame:
    """``(d, cluster, block, only)`` for documents of ``postings(s, d, size, comp)``: documents that share shingles are in one cluster.

    A component too large for a block has blocks of its own, which ``only`` names; small ones share blocks.
    """
    lowest = postings.groupBy("s").agg(F.min("d").alias("b"))
    member = components(postings.join(lowest, "s").select(F.col("d").alias("a"), "b").distinct())
    known = postings.select("d", "size", "comp").distinct().join(member.select(F.col("node").alias("d"), F.col("component").alias("cluster")), "d")
    weights = known.groupBy("cluster", "comp").agg(F.sum("size").alias("w"))
    few = weights.where(F.col("w") <= BLOCK).groupBy("cluster").agg(F.sum("w").alias("few"))
    part = lambda key, total: F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.ceil(total / BLOCK)))
    own, shared = F.xxhash64("comp", F.lit("own"), part("d", F.col("w"))), F.xxhash64("cluster", F.lit("shared"), part("comp", F.coalesce("few", F.lit(0))))
    dealt = known.join(weights, ["cluster", "comp"]).join(few, "cluster", "left")
    large = F.col("w") > BLOCK
    return dealt.select("d", "cluster", "comp", F.when(large, own).otherwise(shared).alias("block"), F.when(large, F.col("comp")).alias("only"))


def open_links(prefixes: DataFrame, sets: DataFrame, member: DataFrame) -> DataFrame:
    """Verified links between documents of different components that share as many prefix shingles as they must."""
    postings = grouped(prefixes, member)
    lists = postings.groupBy("s").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("s")
    mine = materialise(postings.join(lists, "s").select("s", "d", "size", "comp", "match"), "open")
    places = materialise(seats(mine), "places")
    cells = mine.select("s", "d").join(places, "d").select("cluster", "s", "block", "only").distinct()
    x, y = (cells.select("cluster", "s", F.col("block").alias(n), F.col("only").alias(f"only_{n}")) for n in "xy")
    pairs = x.join(y, ["cluster", "s"]).where((F.col("x") <= F.col("y")) & ~F.coalesce(F.col("only_x") == F.col("only_y"), F.lit(False))).select("x", "y").distinct()
    sides = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    docs = mine.groupBy("d").agg(F.collect_list("s").alias("prefix"), F.first("match").alias("match")).join(sets, "d")
    placed = docs.join(places.select("d", "comp", "block"), "d").join(sides, "block")

    def run(key: tuple[int, int], group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(linked(group, *key), columns=["a", "b"], dtype="int64")

    return placed.groupBy("x", "y").applyInPandas(run, "a long, b long")


def links(docs: DataFrame, prefix: DataFrame, frequent: Broadcast, words: int = WORDS) -> DataFrame:
    """Verified links ``(a, b)`` between the marks of different shingle sets, enough to span every component.

    ``docs`` has ``id``, a key without nulls; ``prefix`` is the written :func:`prefix_table` of its ids.
    """
    spark = docs.sparkSession
    often = [(s,) for s, n in zip(frequent.value[0].view(np.int64).tolist(), frequent.value[1].tolist(), strict=True) if n >= HOT]
    hot = spark.createDataFrame(often, "s long") if often else None
    holders = prefix.where("size(prefix) > 0").select("mark", "doc_id", F.col("n_shingles").alias("size"), "prefix")
    index = holders.groupBy("mark").agg(F.min_by(F.struct("doc_id", "size", "prefix"), "doc_id").alias("r")).select(F.col("mark").alias("d"), "r.*")
    postings = index.select("d", "size", F.explode("prefix").alias("s"))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("size") * SHARED / OF) / MATCH_PART))
    first = peel(live_postings(postings, hot), least, "live", 2, hot)
    alive = first.groupBy("d", "size").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).select("d")
    alive = materialise(alive.join(holders.groupBy(F.col("mark").alias("d")).agg(F.min("doc_id").alias("id")), "d"), "alive")
    rows = peel(live_postings(whole_postings(docs, alive, words), hot), _needed("size"), "whole", 3, hot)
    sets = materialise(rows.groupBy("d", "size").agg(F.collect_list("s").alias("shingles")), "sets")
    prefixes = materialise(adaptive(rows), "final")
    found = materialise(verified(hub_pairs(grouped(prefixes, None), 0), sets), "links")
    member = components(found)
    for turn in range(1, ROUNDS):
        found = found.unionByName(materialise(verified(hub_pairs(grouped(prefixes, member), turn), sets), "links"))
        member = components(found)
    return found.unionByName(materialise(open_links(prefixes, sets, member), "links"))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    Words are runs without white space of the text with A-Z lower-cased; documents link when their sets of
    distinct shingles have a Jaccard similarity of at least 0.8. Nulls, empty texts and texts without words have no
    shingles and are linked with nothing. Repeated rows give a row each, and so do different texts under one
    doc_id, each with the links of its own text. Rows of null doc_id are linked too; their component_id is null if none of
    their component has a doc_id. Ties don't matter; other columns are left out; no rows give none.
    """
    docs = with_text(docs).withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    bound_batches(docs.sparkSession)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs.select("id", "text"), words))
    prefix = materialise(prefix_table(docs.select("id", "text"), frequent, words), "prefixes")
    labels = materialise(components(links(docs, prefix, frequent, words)), "labels")
    own = F.nullif(F.col("doc_id"), F.lit(-(1 << 63)))
    reps = materialise(prefix.where("n_shingles > 0").groupBy("mark").agg(F.min(own).alias("d")), "reps")
    held = reps.join(labels, F.col("mark") == F.col("node")).groupBy("component").agg(F.min("d").alias("low"))
    low = labels.join(held, "component").select(F.col("node").alias("mark"), "low")
    classes = reps.join(low, "mark", "left").select("mark", F.least("low", "d").alias("component_id"))
    return (
        prefix.select(own.alias("doc_id"), "n_shingles", "mark")
        .join(classes, "mark", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents that are the smallest of their component, with their own columns.

    Texts without words stay, as do repeated rows of a document that stays; rows of one doc_id go together, if any of
    them is not the smallest of its component. Rows of null doc_id stay. No rows give none.
    """
    found = materialise(near_duplicates(docs, words).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(small_side(found, found.count()), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
