"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing, in a tree of partial partitions.

Documents of equal text form one group. Leaves of some ten thousand groups are differenced on the
executors; each leaves a partial partition: one sum per shard. Partial partitions are differenced
again, a thousand at a time on the executors and the few that remain on the driver, so neither a task
nor the driver holds more than a bounded number of groups or sums.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm.common import materialise, small_side

GROUPS_PER_LEAF = 20_000
LEAVES_PER_BRANCH = 1_024
#: Rows of one shard that are numbered in one task.
ROWS_PER_RUN = 20_000
#: Rows of one group beyond which its shard is broadcast to them, so that no task gathers them.
HOT_ROWS = 20_000


def difference(sums: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp over partial partitions.

    ``sums`` has a row per partial partition and a column per part. The two of largest spread are
    combined again and again, one in descending, one in ascending order. Returns, for each cell of
    ``sums``, the part of the final partition into which it goes; final part 0 is the largest.
    """
    m, k = sums.shape
    first = np.argsort(-sums, axis=1, kind="stable")
    nodes = list(np.take_along_axis(sums, first, axis=1))
    heap = [(int(v[-1] - v[0]), i) for i, v in enumerate(nodes)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        joined = nodes[a] + nodes[b][::-1]
        order = np.argsort(-joined, kind="stable")
        joined = joined[order]
        nodes[a] = nodes[b] = None
        made.append((a, b, order))
        nodes.append(joined)
        heapq.heappush(heap, (int(joined[-1] - joined[0]), len(nodes) - 1))
    places: list[np.ndarray | None] = [None] * len(nodes)
    if nodes:
        places[-1] = np.arange(k)
    for i in range(len(made) - 1, -1, -1):
        a, b, order = made[i]
        places[a], places[b] = np.empty(k, np.int64), np.empty(k, np.int64)
        places[a][order] = places[m + i]
        places[b][k - 1 - order] = places[m + i]
        places[m + i] = None
    out = np.empty((m, k), np.int64)
    for i in range(m):
        out[i, first[i]] = places[i]
    return out


def _leaf(shards: int):
    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["total", "key"], ascending=[False, True], ignore_index=True)
        sums = np.zeros((len(groups), shards), np.int64)
        sums[:, 0] = groups["total"]
        return pd.DataFrame({"key": groups["key"], "leaf": groups["leaf"], "part": difference(sums)[:, 0].astype("int32"), "total": groups["total"], "n": groups["n"]})

    return run


def _branch(shards: int, by: str):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(cells[by].unique())
        sums = np.zeros((len(ids), shards), np.int64)
        sums[np.searchsorted(ids, cells[by]), cells["part"]] = cells["total"]
        to = difference(sums)
        return pd.DataFrame({by: np.repeat(ids, shards), "part": np.tile(np.arange(shards, dtype="int32"), len(ids)), "to": to.ravel().astype("int32"), "total": sums.ravel()})

    return run


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Shards of nearly equal bytes; all documents of one text go to one shard.

    Returns, per row of ``docs``: doc_id, size (UTF-8 bytes plus 8), text_crc32, law (``bytes``), shard,
    slot (gapless from 0 within its shard) and grown_shard (null under this law). A null text has size 8
    and shares the group of empty texts. A group larger than an even share stays whole, and the other
    groups balance among the rest. Repeated rows get a slot each; no rows give none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key")),
        "sizes",
    )
    count = rows.count()
    leaves = max(1, math.ceil(count / GROUPS_PER_LEAF))
    groups = rows.groupBy("key").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")).withColumn("leaf", F.pmod(F.xxhash64("key"), F.lit(leaves)))
    groups = materialise(groups.groupBy("leaf").applyInPandas(_leaf(shards), "key binary, leaf long, part int, total long, n long"), "leaves")

    cells = groups.groupBy("leaf", "part").agg(F.sum("total").alias("total")).withColumn("branch", F.floor(F.col("leaf") / LEAVES_PER_BRANCH).cast("long"))
    mapped = materialise(cells.groupBy("branch").applyInPandas(_branch(shards, "leaf"), "leaf long, part int, to int, total long"), "branches")
    branches = mapped.groupBy(F.floor(F.col("leaf") / LEAVES_PER_BRANCH).cast("long").alias("branch"), "to").agg(F.sum("total").alias("total"))
    top = [r for r in branches.toLocalIterator()]  # shards x ceil(leaves / LEAVES_PER_BRANCH) sums
    sums = np.zeros((max([r["branch"] for r in top], default=-1) + 1, shards), np.int64)
    for r in top:
        sums[r["branch"], r["to"]] = r["total"]
    final = difference(sums) if len(sums) else sums
    kinds = T.StructType([T.StructField("branch", T.LongType()), T.StructField("to", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    finals = rows.sparkSession.createDataFrame([(b, j, int(final[b, j])) for b in range(len(final)) for j in range(shards)], kinds)
    places = mapped.withColumn("branch", F.floor(F.col("leaf") / LEAVES_PER_BRANCH).cast("long")).join(finals, ["branch", "to"]).select("leaf", "part", "shard")
    placed = groups.join(places, ["leaf", "part"]).select("key", "shard", "n")
    hot, often = placed.where(F.col("n") > HOT_ROWS).select("key", "shard"), groups.where(F.col("n") > HOT_ROWS).count()  # at most one of HOT_ROWS rows
    if often:
        sides = small_side(hot, often)
        joined = rows.join(sides, "key", "left_anti").join(placed.select("key", "shard"), "key").unionByName(rows.join(sides, "key"))
    else:
        joined = rows.join(placed.select("key", "shard"), "key")

    runs = max(8, math.ceil(count / shards / ROWS_PER_RUN))
    out = materialise(joined.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(runs)).alias("run")), "placed")
    return number(out, "shard", "run").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def number(rows: DataFrame, group: str, run: str) -> DataFrame:
    """Number each group's rows from 0 without holes: within runs of bounded size, after the sizes of the runs before."""
    sizes = rows.groupBy(group, run).count()
    before = Window.partitionBy(group).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, run, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(group, run).orderBy("doc_id", "text_crc32")
    return rows.withColumn("_n", F.row_number().over(within)).join(starts, [group, run]).withColumn("slot", (F.col("start") + F.col("_n") - 1).cast("long")).drop("_n", "start")
