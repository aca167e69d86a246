"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's documents stand in seeded order and are cut into blocks of equally many words. The blocks of the mix are apportioned to the
sources by highest quotients, target / (2 s + 1) for the block after s, which gives every shard of the mix an integer quota of each source's
blocks. A source's quota takes its blocks in order from a seeded one on, around and around. Documents never meet in one task: their places
in a source are prefix sums over runs of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm.common import materialise, small_side

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Sizes of blocks, in words; the largest is taken of which the smallest target still has ``LEAST_BLOCKS``.
BLOCKS = (4096, 2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1)
LEAST_BLOCKS = 256
SHARDS = 24
#: Documents of a source that are put in order in one task.
ROWS_PER_RUN = 20_000
#: Rows that one row stands for at most when repeated rows are told apart again.
COPIES = 10_000


def targets(sizes: Sequence[int], weights: Sequence[int], share: Fraction = Fraction(3, 2), most: int = 2) -> list[Fraction]:
    """Shares of ``share`` times all sizes by weight; what is above ``most`` times its size stops there, and the rest is shared again."""
    out, left = [Fraction(0)] * len(sizes), share * sum(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if level * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = level * weights[i]
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def apportion(votes: Sequence[int], most: Sequence[int], seats: int) -> list[int]:
    """Sainte-Laguë: the ``seats`` highest quotients votes / (2 s + 1), at most ``most`` of each; ties go to the first.

    Starts from the rounded shares, which are off by half a seat a party, and mends those: no list of all seats is made.
    """
    everything = sum(votes)
    if not everything:
        return [0] * len(votes)
    held = [min(m, (2 * seats * v + everything) // (2 * everything)) for v, m in zip(votes, most, strict=True)]
    # entries hold the number of seats at which they are right; others are passed over
    next_ = [(-Fraction(v, 2 * h + 1), i, h) for i, (v, h, m) in enumerate(zip(votes, held, most, strict=True)) if h < m and v]
    last = [(Fraction(v, 2 * h - 1), -i, h) for i, (v, h) in enumerate(zip(votes, held, strict=True)) if h]
    heapq.heapify(next_)
    heapq.heapify(last)

    def top(heap: list) -> tuple | None:
        while heap and held[abs(heap[0][1])] != heap[0][2]:
            heapq.heappop(heap)
        return heap[0] if heap else None

    def change(i: int, by: int) -> None:
        held[i] += by
        if held[i] < most[i]:
            heapq.heappush(next_, (-Fraction(votes[i], 2 * held[i] + 1), i, held[i]))
        if held[i]:
            heapq.heappush(last, (Fraction(votes[i], 2 * held[i] - 1), -i, held[i]))

    n = sum(held)
    while n > seats:
        change(-top(last)[1], -1)
        n -= 1
    while n < seats and top(next_):
        change(top(next_)[1], 1)
        n += 1
    while (more := top(next_)) and (less := top(last)) and (-more[0], -more[1]) > less[:2]:  # a rounded share may hold a seat that another has more right to
        change(-less[1], -1)
        change(more[1], 1)
    return held


def _blocks(size: int, block: int) -> int:
    return -(-size // block)


def quotas(sizes: Sequence[int], goals: Sequence[Fraction], shards: int = SHARDS, most: int = 2) -> tuple[int, list[list[int]]]:
    """The block size, and for each source its blocks in the shards before each shard and in all (``shards + 1`` numbers)."""
    votes = [math.floor(g + Fraction(1, 2)) for g in goals]
    least = min((v for v in votes if v), default=0)
    block = next((b for b in BLOCKS if b * LEAST_BLOCKS <= least), 1)
    seats = (2 * sum(votes) + block) // (2 * block)
    limits = [most * _blocks(s, block) for s in sizes]
    seats = min(seats, sum(m for m, v in zip(limits, votes, strict=True) if v))
    upto = [apportion(votes, limits, seats * s // shards) for s in range(shards + 1)]
    return block, [[row[i] for row in upto] for i in range(len(sizes))]


def begin(name: str | None, blocks: int, seed: int) -> int:
    """The block of a source that is taken first."""
    return int(hashlib.md5(f"{seed}:{name or ''}".encode()).hexdigest()[:8], 16) % blocks if blocks else 0


def spans(name: str | None, size: int, block: int, held: Sequence[int], seed: int) -> list[tuple[int, int, int]]:
    """The words of a source that each shard takes, as ``(shard, from, to)``; a shard's quota may go around the end, and around again."""
    n, out = _blocks(size, block), []
    start = begin(name, n, seed)
    for shard, (low, high) in enumerate(zip(held, held[1:], strict=False)):
        while low < high:
            at = (start + low) % n
            to = min(at + high - low, n)
            out.append((shard, at * block, min(to * block, size)))
            low += to - at
    return out


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and ``pieces``: of each shard, the words (from, n) that it takes.

    A null text has size 0. Sources stand by code point, null last, and weigh ``weights`` in turn; they may be some million, as the driver holds
    a row of each. Repeated rows count each and, like rows of one doc_id and size, may be taken from differently; rows of null doc_id
    count like others. Empty texts, and sources without words, are taken 0 words. Other columns are left out; no rows give none.
    """
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), words.cast("long").alias("size")).groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("key", key),
        "sizes",
    )
    known = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count(F.lit(1)).alias("n")).collect()
    known.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in known]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(known))])
    block, held = quotas(sizes, goals, shards)
    table = [(r["source"], s, float(g), spans(r["source"], s, block, h, seed)) for r, s, g, h in zip(known, sizes, goals, held, strict=True)]
    span = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    kinds = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    mixed = small_side(docs.sparkSession.createDataFrame(table, kinds).withColumnRenamed("source", "_source"), len(known) * (2 * shards + 4))

    runs = max(8, math.ceil(sum(r["n"] for r in known) / ROWS_PER_RUN))
    # runs follow the order of keys, so that the order of documents doesn't depend on their number
    numbered = rows.withColumn("run", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * runs / (1 << 32)).cast("long"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("source", "run").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).select(F.col("source").alias("_s"), F.col("run").alias("_r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "run").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.withColumn("_n", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("run") == F.col("_r"))).withColumn("place", F.col("start") + F.col("_n"))
    parts = placed.select("doc_id", "source", "size", "place", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("from"))
    each = parts.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + COPIES, "copies") - 1))).withColumn("place", F.col("place") + F.col("copy") * F.col("size"))
    each = each.join(mixed, F.col("source").eqNullSafe(F.col("_source")))
    start = lambda x: F.greatest(x["start"] - F.col("place"), F.lit(0))
    stop = lambda x: F.least(x["stop"] - F.col("place"), F.col("size"))
    pieces = F.transform(F.filter("spans", lambda x: start(x) < stop(x)), lambda x: F.struct(x["shard"].alias("shard"), start(x).alias("start"), (stop(x) - start(x)).alias("n")))
    each = each.withColumn("pieces", pieces)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["n"])
    return each.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "pieces")


def mix(docs: DataFrame) -> DataFrame:
    """:func:`plan` without the pieces."""
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")
