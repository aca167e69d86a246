"""Centroid clustering of integer vectors with Elkan's bounds; every assignment, sum and distance is exact.

Each vector keeps an upper bound on the distance to its own centroid and a lower bound on that to every centroid.
After a move of the centroids the bounds widen by how far each went; a centroid is skipped for a vector if its lower bound,
or half its distance to the vector's centroid, is strictly above the upper bound. Bounds are floats, rounded away from the
truth, so that a skipped centroid is surely farther and ties are always compared. What is not skipped is compared by integer squares.

A round is a map over the vectors with their bounds: nothing is shuffled but the sums of the vectors that changed
cluster, one row for each cluster and component of a task. The kept vectors are written once to the shared folder; the state of a round is
cached and, where an executor is lost, made again from there by the few maps before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise

#: Components up to this size have squared distances of 64 of them below 2^63; larger ones are computed with Python's integers.
NARROW = 1 << 27
#: Vectors with a component of this size or more are left out like those that are not finite: their distances fit no long.
FAR = float(1 << 52)
#: Relative slack by which bounds are rounded away from the truth; errors of roots and sums are below a quarter of it.
SLACK = 2.0**-50
_STATE = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("before", pa.int32()), ("bounds", pa.binary()), ("distance", pa.int64())])
_STATE_SQL = "vec_id long, v binary, cluster int, before int, bounds binary, distance long"


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` from ``c``, one centroid or one of each row."""
    d = x - c
    return (d * d).sum(axis=1)


def above(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def below(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - SLACK), 0.0)


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype("float64"))


def halves(centroids: np.ndarray) -> np.ndarray:
    """Half the distance between any two centroids, rounded down."""
    return np.array([below(root(squares(centroids, c)) / 2) for c in centroids])


def reassign(x: np.ndarray, centroids: np.ndarray, half: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, int]:
    """Move each row of ``x`` to its nearest centroid, the smaller number of ties; ``cluster``, ``upper`` and ``lower`` change in place.

    Returns the squared distances that were computed, -1 where bounds alone decided, and how many were.
    """
    known = np.full(len(x), -1, dtype=x.dtype)
    computed = 0

    def near(rows: np.ndarray, c: int | np.ndarray) -> np.ndarray:
        nonlocal computed
        computed += len(rows)
        return squares(x[rows], centroids[c])

    for c in range(len(centroids)):
        open_ = lambda rows: rows[(cluster[rows] != c) & (lower[rows, c] <= upper[rows]) & (half[cluster[rows], c] <= upper[rows])]  # noqa: E731, B023
        rows = open_(np.arange(len(x)))
        stale = rows[known[rows] < 0]
        if len(stale):
            known[stale] = near(stale, cluster[stale])
            distance = root(known[stale])
            upper[stale], lower[stale, cluster[stale]] = above(distance), below(distance)
            rows = open_(rows)
        if len(rows):
            d = near(rows, c)
            lower[rows, c] = below(root(d))
            nearer = (d < known[rows]) | ((d == known[rows]) & (c < cluster[rows]))
            moved = rows[nearer]
            cluster[moved], known[moved] = c, d[nearer]
            upper[moved] = above(root(d[nearer]))
    return known, computed


def _packed(rows: np.ndarray) -> list[bytes]:
    width, data = rows.itemsize * rows.shape[1], np.ascontiguousarray(rows).tobytes()
    return [data[i : i + width] for i in range(0, len(data), width)]


def _pass(centroids: np.ndarray, moves: np.ndarray | None, wide: bool, last: bool):
    """One assignment of all vectors; ``moves``: how far each centroid went since the one before, none the first time."""
    kind, k, dim = ("<i8" if wide else "<i4"), len(centroids), centroids.shape[1]
    at = centroids.astype(object if wide else "int64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = halves(at)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if moves is None:
                stored = np.array(batch["v"].flatten(), dtype=kind).reshape(n, dim)
                packed, cluster = _packed(stored), np.zeros(n, dtype="int64")
                before, upper, lower = np.full(n, -1), np.full(n, np.inf), np.zeros((n, k))
            else:
                packed = batch["v"].to_pylist()
                stored = np.frombuffer(b"".join(packed), dtype=kind).reshape(n, dim)
                cluster = np.array(batch["cluster"], dtype="int64")
                before, bounds = cluster.copy(), np.frombuffer(b"".join(batch["bounds"].to_pylist()), dtype="<f8").reshape(n, k + 1)
                upper, lower = above(bounds[:, 0] + moves[cluster]), below(np.maximum(bounds[:, 1:] - moves, 0.0))
            x = stored.astype(object if wide else "int64")
            known, _ = reassign(x, at, half, cluster, upper, lower)
            distance: list | np.ndarray = [None] * n
            if last:
                rest = np.flatnonzero(known < 0)
                known[rest] = squares(x[rest], at[cluster[rest]])
                distance = [int(d) if d < 1 << 63 else None for d in known]
            out = [batch["vec_id"], packed, cluster.astype("int32"), before.astype("int32"), _packed(np.column_stack([upper, lower]).astype("<f8")), distance]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _STATE, strict=True)], schema=_STATE)

    return run


def _changes(k: int, dim: int, wide: bool):
    """What the vectors that changed cluster add to the sums and counts (component -1): one row for each cluster and component of a task."""
    kind = "<i8" if wide else "<i4"
    schema = pa.schema([("cluster", pa.int32()), ("component", pa.int32()), ("total", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dim + 1), dtype=object)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch["v"].to_pylist()), dtype=kind).reshape(batch.num_rows, dim).astype(object if wide else "int64")
                for side, sign in (("cluster", 1), ("before", -1)):
                    own = np.array(batch[side])
                    for c in np.unique(own[own >= 0]):
                        rows = x[own == c]
                        sums[c, :dim] += sign * rows.sum(axis=0)
                        sums[c, dim] += sign * len(rows)
        cells = [(c, i if i < dim else -1, Decimal(int(sums[c, i]))) for c in range(k) for i in range(dim + 1) if sums[c, i]]
        yield pa.RecordBatch.from_arrays([pa.array([cell[i] for cell in cells], type=f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def kept_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """``(vec_id, v)`` of the vectors that count, as integers; written to the shared folder."""
    x = F.col("embedding").cast("array<double>")
    fine = (F.size(x) == dim) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < FAR))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, x).alias("x")).where("x IS NOT NULL")
    return materialise(rows.select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v")), "vectors")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dim`` components, none of them null, not finite or of 2^52 and more; a component x becomes
    floor(scale * x). The first centroids are the kept vectors of the smallest sha256 of ``seed:vec_id``, in this order (a null vec_id counts as an
    empty one; repeated ids go by their components), fewer than ``k`` if no more are kept. Repeated rows count each; ties go to the smaller
    number; empty clusters keep their centroid. Sums beyond a long are null. Other columns are left out; no kept vector gives no rows.
    """
    base = kept_vectors(vectors, dim, scale)
    size = F.array_max(F.transform("v", lambda e: F.abs(e)))
    first = base.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "v").limit(k).collect()
    wide = (base.agg(F.max(size)).first()[0] or 0) > NARROW
    centroids = np.array([[int(e) for e in r["v"]] for r in first], dtype=object).reshape(len(first), dim)
    k = len(first)
    if not k:
        return base.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).limit(0)
    sums, counts, state, moves = np.zeros((k, dim), dtype=object), np.zeros(k, dtype=object), base, None
    for _ in range(rounds):
        after = state.mapInArrow(_pass(centroids, moves, wide, False), _STATE_SQL).persist(StorageLevel.MEMORY_AND_DISK)
        changed = after.where("cluster <> before").select("v", "cluster", "before").mapInArrow(_changes(k, dim, wide), "cluster int, component int, total decimal(38,0)")
        for r in changed.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect():  # k x (dim + 1) rows at most
            if r["component"] < 0:
                counts[r["cluster"]] += int(r["total"])
            else:
                sums[r["cluster"], r["component"]] += int(r["total"])
        if state is not base:
            state.unpersist()
        state = after
        new = np.array([[int(s) // int(n) for s in row] if n else list(c) for row, n, c in zip(sums, counts, centroids, strict=True)], dtype=object)
        moves = above(root(squares(new, centroids)))
        centroids = new
        if not moves.any():
            break  # nothing moves any more: the rounds left change nothing
    placed = materialise(state.mapInArrow(_pass(centroids, moves, wide, True), _STATE_SQL).select("vec_id", "cluster", "distance"), "clusters")
    state.unpersist()
    inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    fits = lambda s: None if s is None or s >= 1 << 63 else int(s)
    total = fits(sum(s for s in inertia.values() if s is not None))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = placed.sparkSession.createDataFrame([(c, fits(inertia.get(c)), total, digests[c]) for c in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
