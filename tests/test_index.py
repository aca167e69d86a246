"""Persisted indexes against scans and brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import index, search


def test_terms_as_by_scanning(spark, tmp_path):
    draw = random.Random(4)
    words = ["Sales", "sale", "wholesale", "Plan", "planet", "budget", "é", "a\u00a0b", "x,y", "the"]
    text = lambda: draw.choice([None, "", " ".join(draw.choice(words) for _ in range(draw.randrange(0, 9)))])
    row = lambda i: (i, text(), text(), [t for t in (text(), text()) if t is not None] if i % 4 else None)
    kinds = "id long, name string, body string, tags array<string>"
    first, second = [row(i) for i in range(80)], [row(i) for i in range(40, 120)]
    fields, lists = [F.col("name"), F.col("body")], (F.col("tags"),)
    made = index.TermIndex(spark, f"{tmp_path}/terms", "long")
    now = {}
    for batch in (first, second):
        df = spark.createDataFrame(batch, kinds)
        made.add(df, "id", fields, F.col("name"), lists)
        now |= {r[0]: r for r in batch}
        every = spark.createDataFrame(list(now.values()), kinds)
        for query in ("sale", "plan budget", "SALE the x", "a\u00a0b", "nothing", " ", "é sales"):
            want = [tuple(r) for r in search.keyword(every, query, fields, F.col("name"), "id", 15, lists).collect()]
            assert [tuple(r) for r in made.search(query, 15).collect()] == want, query
    read = made.postings(made.matching(["wholesale"])).inputFiles()
    assert 0 < len(read) < len(made._read("postings").inputFiles()) / 2


def test_lists_find_the_nearest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "CHUNK", 40)
    draw = np.random.default_rng(3)
    middles = draw.normal(size=(12, 16))
    x = middles[draw.integers(0, 12, 900)] + 0.4 * draw.normal(size=(900, 16))
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)] + [(900 + k, [float(e) for e in x[5]]) for k in range(300)] + [(2000, None), (2001, [0.0] * 16), (2002, [1.0]), (2003, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    made = index.VectorIndex(spark, f"{tmp_path}/lists").build(df, "id", "v")
    assert 1 <= made.probes < len(made.centroids)
    good = [(i, v) for i, v in rows if v is not None and len(v) == 16 and np.linalg.norm(v) > 0]
    unit = np.array([v for _, v in good]) / np.linalg.norm([v for _, v in good], axis=1, keepdims=True)
    asked = df.where("id % 20 = 0 AND id < 900")
    got = {}
    for r in made.nearest(asked, "id", "v", 10).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["key"], r["score"])
    hits = total = 0
    for i, (key, _) in enumerate(good):
        if key % 20 == 0 and key < 900:
            scores = np.round(unit @ unit[i], 9)
            best = sorted(scores, reverse=True)[:10]
            assert sorted(got[key]) == list(range(1, 11))
            hits, total = hits + sum(s >= round(best[-1], 6) for _, s in got[key].values()), total + 10
    assert hits / total >= 0.9
    every = made.nearest(asked, "id", "v", 10, probes=len(made.centroids)).where("query = 20").orderBy("rank").collect()
    i = [k for k, _ in good].index(20)
    want = sorted(((-round(float(s), 9), k) for s, (k, _) in zip(unit @ unit[i], good, strict=True)))[:10]
    assert [r["key"] for r in every] == [k for _, k in want]
    one = made.search(rows[20][1], 10, probes=len(made.centroids)).collect()
    assert {r["key"] for r in one} == {k for _, k in want}


def test_ranking_holds_few_scores_at_once():
    """The scores of a few queries against a list's chunk are held, not of a thousand; the neighbours are those of a plain sort."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(index.CHUNK, 16)), rng.normal(size=(1_500, 16))
    a, b = pd.DataFrame({"query": range(len(q)), "vector": list(q)}), pd.DataFrame({"key": range(len(x)), "vector": list(x)})
    tracemalloc.start()
    got = index._ranked(a, b, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got["key"].to_numpy().reshape(len(q), 10).tolist() == np.argsort(-np.round(unit(q) @ unit(x).T, 9), axis=1, kind="stable")[:, :10].tolist()


def test_queries_are_placed_in_slices_and_asked_in_parts(spark, tmp_path, monkeypatch):
    """A worker holds few products with centroids at once, and a list's queries are dealt to several tasks; the neighbours stay the same."""
    import pandas as pd

    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    made = index.VectorIndex(spark, f"{tmp_path}/lists").build(df, "id", "v", lists=5)
    told = lambda: {(r["query"], r["rank"]): (r["key"], r["score"]) for r in made.nearest(df, "id", "v", 3, probes=5).collect()}
    want = told()
    monkeypatch.setattr(index, "SCORES", 35)
    monkeypatch.setattr(index, "QUERIES", 30)
    monkeypatch.setattr(index, "CHUNK", 25)
    assert told() == want and len(want) == 1_200
    parts = list(index._slices(iter([pd.DataFrame({"vector": list(x)}), pd.DataFrame({"vector": []})]), made.centroids))
    assert {len(p) for p, _ in parts} == {7, 1} and sum(len(p) for p, _ in parts) == 400
