"""Adaptive prefixes, hubs, blocks and hot shingles of the n-gram join."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import jaccard
from tests.llm.test_operators import linked_brute, prose


def near_copies(groups, size, words, changes, seed=5):
    """Groups of near copies: each changes a few words of one text, so that some pairs of a group link and others don't."""
    draw, rows = random.Random(seed), []
    for g in range(groups):
        base = prose(g, words).split()
        for k in range(size):
            text = list(base)
            for _ in range(draw.randrange(changes)):
                text[draw.randrange(words)] = f"w{draw.randrange(10**6)}"
            rows.append((g * 1000 + k, " ".join(text)))
    return rows


@pytest.mark.parametrize("settings", [{"FEW": 0}, {"BLOCK": 400, "SHARED_AT_ONCE": 50, "ROUNDS": 1, "HOT": 1, "SAMPLE": 1.0}])
def test_near_copies(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(3, 40, 120, 9) + [(9000 + k, prose(700 + k, 50)) for k in range(20)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = linked_brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    assert len({c for _, c in want.values()}) > 25


def test_different_texts_under_one_id(spark):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(7, a), (7, b), (3, a), (5, b + " end"), (None, a + " end"), (None, prose(9, 40))]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 3), (3, 3), (5, 5), (7, 3), (7, 5)]


def test_cost_lengthens_prefixes():
    """Frequent shingles lengthen a prefix and raise its matches; rare ones don't."""
    shingles = np.arange(1, 201, dtype=np.uint64)
    rare = jaccard.Prefixes(np.empty(0, np.uint64), np.empty(0, np.int64)).cut(shingles)
    costly = jaccard.Prefixes(shingles, np.full(200, 5_000)).cut(shingles)
    assert len(rare[0]) == 200 - 160 + rare[1] and rare[1] == jaccard.least_match(200)
    assert costly[1] > 3 * rare[1] and len(costly[0]) == 200 - 160 + costly[1]


def test_final_prefixes(spark):
    """The matches chosen are those of least cost, by a plain loop; some are more than one."""
    draw, rows = random.Random(3), []
    for d in range(30):
        size = draw.randrange(5, 60)
        live = draw.sample(range(1000), draw.randrange(int(jaccard.needed(size)), size + 1))
        rows += [(s, d, size, s % (900 if d % 2 else 9) + 2) for s in live]
    got = {}
    for r in jaccard.adaptive(spark.createDataFrame(rows, "s long, d long, size long, n long")).collect():
        got.setdefault(r["d"], []).append((r["s"], r["match"], r["live"]))
    chosen = set()
    for d in range(30):
        own = sorted((n, s) for s, e, _, n in rows if e == d)
        size = next(z for _, e, z, _ in rows if e == d)
        must = int(jaccard.needed(size))
        read = lambda k, own=own, must=must: sum(n - 1 for n, _ in own[: len(own) - must + k])
        k = 1 if read(1) <= jaccard.FEW else min(range(1, must + 1), key=lambda k: read(k) * (1 + jaccard.VERIFY * size / k))
        assert {s for s, _, _ in got[d]} == {s for _, s in own[: len(own) - must + k]}
        assert {(m, n) for _, m, n in got[d]} == {(k, len(own))}
        chosen.add(k)
    assert 1 in chosen and len(chosen) > 3


def test_hot_postings_are_a_superset(spark):
    rows = [(d, 10 + d % 40, d % 7) for d in range(200)] + [(900, 500, 3), (901, 5, 99)]
    index = spark.createDataFrame(rows, "d long, size long, s long")
    plain = {(r["d"], r["s"]) for r in jaccard.live_postings(index).collect()}
    hot = jaccard.live_postings(index, index.select("s").distinct().where(F.col("s") < 5)).collect()
    assert plain <= {(r["d"], r["s"]) for r in hot} and (901, 99) not in {(r["d"], r["s"]) for r in hot}
    assert all(r["n"] == sum(s == r["s"] for _, _, s in rows) for r in hot)


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(jaccard, "SHARED_AT_ONCE", 7)
    draw = random.Random(1)
    left, right = ([np.array(sorted(draw.sample(range(30), draw.randrange(1, 12)))) for _ in range(n)] for n in (9, 6))
    got = np.vstack([c for _, c in jaccard.shared_counts(left, right)])
    assert (got == [[len(set(a) & set(b)) for b in right] for a in left]).all()
