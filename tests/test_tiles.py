"""Cosines in tiles of two-byte components, sets in tiles of rare items."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quillon.operators import relations, similar
from quillon.plans.queries import _embedded_records

LEAST = 0.85


def close_vectors() -> np.ndarray:
    """Unit vectors, half of them at a cosine of the threshold or a hair beside it with the one before; one is zero."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(60):
        u = rng.normal(size=384)
        u /= np.linalg.norm(u)
        w = rng.normal(size=384)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        c = LEAST + (0, 2e-9, -2e-9, 1e-5, -1e-5, 3e-4)[i % 6]
        out += [u, c * u + np.sqrt(1 - c * c) * w]
    return np.array([*out, np.zeros(384)])


@pytest.mark.parametrize("block", [1, 4, 2_048])
def test_cosines_at_the_threshold_lose_no_pair(spark, monkeypatch, block):
    monkeypatch.setattr(relations, "BLOCK", block)
    x = close_vectors()
    rows = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "scope string, no long, vector array<double>")
    got = {(r["a"], r["b"]): r["cosine"] for r in relations.cosine_pairs(rows, "scope", "no", LEAST).collect()}
    cos = np.round(x @ x.T, relations.PLACES)
    want = {(int(a), int(b)) for a, b in np.argwhere(cos >= LEAST) if a <= b}
    assert len(want) > 120 and got.keys() == want
    assert all(abs(got[p] - min(cos[p], 1)) < 2e-9 for p in want)


def test_tiles_are_sent_two_bytes_a_component(spark):
    rows = spark.createDataFrame([("s", 1, [0.6, 0.8])], "scope string, no long, vector array<double>")
    plan = relations.cosine_pairs(rows, "scope", "no", LEAST)._jdf.queryExecution().analyzed().toString()
    assert "as smallint" in plan and "array<float>" not in plan


def test_sets_in_many_small_tiles_lose_no_pair(spark, monkeypatch):
    """Blocks of few sets, and few meetings looked through at once; items are sent with their set, not a row each."""
    monkeypatch.setattr(similar, "SETS", 7)
    monkeypatch.setattr(similar, "MEETINGS", 40)
    draw = random.Random(11)
    words = [f"w{i}" for i in range(50)] + ["", "é", "w1 w2"]
    sets = [draw.sample(words, draw.choice([1, 2, 3, 8, 20, 45])) for _ in range(70)]
    sets += [[w for w in draw.choice(sets) if draw.random() > 0.15] for _ in range(70)]
    sets += [None, [], [None, "w1"], ["w1", None, None], sets[0][::-1]]
    df = spark.createDataFrame([("st"[i % 3 == 0], i, x) for i, x in enumerate(sets)], "scope string, no long, items array<string>")
    kept, real = {}, similar.written
    monkeypatch.setattr(similar, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    got = {(r["a"], r["b"]): r["similarity"] for r in similar.similar_sets(df, "scope", "no", 0.6).collect()}
    want = {(i, j): s for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and (i % 3 == 0) == (j % 3 == 0) and a and b and (s := len(set(a) & set(b)) / len(set(a) | set(b))) >= 0.6}
    assert len(want) > 20 and got == want
    assert kept["rare"].count() <= len(sets) and kept["tiles"].count() > 40


def test_records_are_embedded_where_they_are(spark, tmp_path):
    text = "Close the quarter with a review of each open customer account."
    spark.createDataFrame([(d, f"{text} Entry {d}.", "src0") for d in range(12)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    made = _embedded_records(spark, str(tmp_path))
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString() and made.where("size(vector) = 384").count() == 3


@pytest.mark.parametrize("least", [0.3, 0.85])
def test_rotated_tiles_find_the_same_pairs(monkeypatch, least):
    """The first components of rotated vectors rule out most pairs, and none that a whole product lets through."""
    monkeypatch.setattr(relations, "SEEN", 64)
    rng = np.random.default_rng(8)
    spread = 1 / np.arange(1, 97) ** 0.5
    x, y = ((m := rng.normal(size=(n, 96)) * spread) / np.linalg.norm(m, axis=1, keepdims=True) for n in (500, 700))
    y[:60] = x[:60] + 0.03 * rng.normal(size=(60, 96))
    y[:60] /= np.linalg.norm(y[:60], axis=1, keepdims=True)
    x[70], y[80] = 0, 0
    x, y = x.astype("float32"), y.astype("float32")
    head = relations._turned(x, y, least)[1]
    assert (head in (24, 36, 48)) == (least > 0.5)  # no rotation helps where many pairs are near
    got = set(zip(*map(list, relations._near(x, y, least)), strict=True))
    whole = x @ y.T
    assert {p for p in got if abs(whole[p] - least) > 1e-5} == {(i, j) for i, j in np.argwhere(whole >= least) if abs(whole[i, j] - least) > 1e-5} and len(got) >= 60
    assert len(relations._near(x[:0], y, least)[0]) == len(relations._near(x, y[:0], least)[0]) == 0


def test_records_read_once_are_not_written_first(spark, tmp_path, monkeypatch):
    from quillon.plans import queries

    rows = [(d, f"Close the quarter with a review of each open account of place{d // 10}.", "src0") for d in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, real = [], queries.written
    monkeypatch.setattr(queries, "written", lambda df, name: (seen.append(name), real(df, name))[1])
    counts = queries.dedup_counts(spark, str(tmp_path)).first()
    assert counts["input"] == 8 and counts["final"] + counts["removed"] == 8 and seen == []
