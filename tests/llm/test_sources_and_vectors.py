"""Clustering, mixing and divergence against plain loops, and on odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from quillon.llm import clusters, divergence, mixing
from quillon.llm.oracle import ORACLE_SQL
from quillon.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", ["op11_clusters", "op12_mixing", "op13_divergence"])
def test_same_as_sql(spark, name):
    con, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got, want = QUERIES[name](spark, folder), con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)


def clusters_brute(rows, k, rounds, dim, scale, seed):
    kept = [(i, [(int(x) * scale if abs(x) > 2**40 else int(np.floor(x * scale))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) and abs(x) < 2**52 for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(at))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(at)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if members:
                at[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    last = [nearest(v) for _, v in kept]
    sums = Counter()
    for d, c in last:
        sums[c] += d
    fits = lambda x: x if x < 2**63 else None
    return sorted(((i, c, fits(d), fits(sums[c]), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, last, strict=True)), key=str)


@pytest.mark.parametrize("big", [1.0, 3e5])
def test_clusters_as_by_plain_loops(spark, big):
    draw = random.Random(7)
    rows = [(i, [draw.choice([-1, 0, 1]) * draw.choice([0.25, 0.5, big]) + draw.choice([0, 0.001]) for _ in range(4)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 380)] + [(7, rows[7][1]), (7, rows[7][1]), (None, rows[9][1]), (None, rows[8][1])]
    rows += [(500, None), (501, []), (502, [1.0, 2.0, None, 3.0]), (503, [float("nan")] * 4), (504, [float("inf"), 0.0, 0.0, 0.0]), (505, [1.0] * 5), (506, [1e300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS cluster", "1 AS v", "2 AS distance").repartition(3)
    got = sorted((tuple(r) for r in clusters.cluster(df, 6, 5, 4, 1024, 3).collect()), key=str)
    assert got == clusters_brute(rows, 6, 5, 4, 1024, 3)
    few = clusters.cluster(df.where("vec_id < 3"), 6, 5, 4, 1024, 3)
    assert sorted((tuple(r) for r in few.collect()), key=str) == clusters_brute(rows[:3], 6, 5, 4, 1024, 3)
    assert clusters.cluster(df.where("vec_id IN (500, 503)"), 6, 5, 4).collect() == []
    assert few.columns == clusters.cluster(df.limit(0), 6, 5, 4).columns


def test_bounds_save_distances_and_keep_ties():
    draw = np.random.default_rng(2)
    middle = draw.integers(-4000, 4000, (8, 16))
    x = (middle[draw.integers(0, 8, 4000)] + draw.integers(-3, 4, (4000, 16))).astype("int64")
    x[:50] = (middle[0] + middle[1]) // 2
    at, own, upper, lower = x[draw.choice(4000, 8, replace=False)], np.zeros(4000, "int64"), np.full(4000, np.inf), np.zeros((4000, 8))
    computed, brute = 0, 0
    for _ in range(6):
        _, n = clusters.reassign(x, at, clusters.halves(at), own, upper, lower)
        computed, brute = computed + n, brute + 8 * len(x)
        d = ((x[:, None] - at[None]) ** 2).sum(axis=2)
        assert (own == d.argmin(axis=1)).all()  # the first of ties
        assert (upper**2 >= d[np.arange(4000), own] * (1 - 1e-12)).all() and (lower**2 <= d * (1 + 1e-12)).all()
        new = np.array([x[own == c].sum(axis=0) // max((own == c).sum(), 1) if (own == c).any() else at[c] for c in range(8)])
        moves = clusters.above(clusters.root(clusters.squares(new, at)))
        upper, lower, at = clusters.above(upper + moves[own]), clusters.below(np.maximum(lower - moves, 0)), new
    assert computed < 0.5 * brute


def test_targets_and_seats():
    draw = random.Random(3)
    for _ in range(300):
        n = draw.randrange(1, 9)
        sizes, weights = [draw.choice([0, 1, 5, draw.randrange(1, 4000)]) for _ in range(n)], [(3, 1, 2)[i % 3] for i in range(n)]
        goals = mixing.targets(sizes, weights)
        assert sum(goals) == Fraction(3, 2) * sum(sizes) and all(g <= 2 * s for g, s in zip(goals, sizes, strict=True))
        levels = {g / w for g, s, w in zip(goals, sizes, weights, strict=True) if g < 2 * s}
        assert len(levels) <= 1 and all(2 * s <= max(levels) * w for g, s, w in zip(goals, sizes, weights, strict=True) if g == 2 * s and levels)
        votes, most = [int(g) for g in goals], [draw.randrange(0, 60) for _ in range(n)]
        seats = draw.randrange(0, 40)
        ranked = sorted((-Fraction(v, 2 * j + 1), i) for i, (v, m) in enumerate(zip(votes, most, strict=True)) for j in range(m) if v)[:seats]
        if sum(votes) and len(ranked) == seats:
            assert mixing.apportion(votes, most, seats) == [sum(i == k for _, i in ranked) for k in range(n)]


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RUN", 20)
    monkeypatch.setattr(mixing, "COPIES", 7)
    draw = random.Random(1)
    text = lambda n: " ".join(["w"] * n)
    rows = [(i, text(draw.randrange(0, 90)), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    rows += [(1000, None, "en", "s1"), (1001, "", "en", None), (1002, " a\tb\x0bc é é ", "en", None), (1003, text(30000), "en", "tiny"), (None, text(8), "en", "hot"), (1004, text(4), None, "é"), (1005, "", None, "none")]
    rows += [(2000, text(33), "en", "hot")] * 50
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS size", "1 AS target", "2 AS key", "3 AS run")
    got = mixing.plan(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, size(t)) for i, t, _, s in rows)
    sizes, taken, per_shard = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t, _, s in rows:
        sizes[s] += size(t)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and r["taken"] == sum(p["n"] for p in r["pieces"])
        assert all(p["n"] > 0 and 0 <= p["start"] and p["start"] + p["n"] <= r["size"] and 0 <= p["shard"] < mixing.SHARDS for p in r["pieces"])
        taken[r["source"]] += r["taken"]
        for p in r["pieces"]:
            per_shard[p["shard"], r["source"]] += p["n"]
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    goals = dict(zip(names, mixing.targets([sizes[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))]), strict=True))
    for r in got:
        assert r["target"] == float(goals[r["source"]])
    for s in names:
        assert abs(taken[s] - goals[s]) <= max(2, goals[s] / 100)
    for shard in range(mixing.SHARDS):
        assert abs(per_shard[shard, "tiny"] - goals["tiny"] / mixing.SHARDS) <= 0.05 * goals["tiny"] / mixing.SHARDS + 2
    once, again = (Counter(tuple(map(str, r)) for r in mixing.plan(df.repartition(n)).collect()) for n in (2, 5))
    assert once == again == Counter(tuple(map(str, r)) for r in got)
    assert mixing.plan(df.limit(0)).count() == 0


def audit_brute(rows):
    words, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, low = lang or "", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        words[lang, source or ""].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        groups = {s: c for (x, s), c in words.items() if x == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s in groups:
            pairs = [(h, sum((p[s][t] - p[h][t]) ** 2 // p[h][t] for t in kept)) for h in groups if h != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, 10**9), ("term", terms, 200)):
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


@pytest.mark.parametrize("heavy", [True, False])
def test_divergence_as_by_plain_loops(spark, monkeypatch, heavy):
    monkeypatch.setattr(divergence, "TILE", 3 if heavy else 256)
    monkeypatch.setattr(divergence, "LIGHT", 1 if heavy else 8)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "CELLS", 40)
    monkeypatch.setattr(divergence, "LONG", 500)
    draw = random.Random(2)
    words = ["The", "the", "Öl", "öl", "naïve", "x1y", "a_b", "don't", "日本", *[f"w{chr(97 + i)}" for i in range(26)], *[f"v{chr(97 + i)}" for i in range(26)]]
    rows = [(i, " ".join(draw.choice(words[: 8 + (i % 5) * 12]) for _ in range(draw.randrange(0, 60))), draw.choice(["en", "en", "de", None]), draw.choice([f"s{k}" for k in range(10)] + [None, "é"])) for i in range(260)]
    rows += [(900, None, "en", "silent"), (901, "", "en", "s1"), (902, "1 2 3", "xx", "a"), (903, "only once", "yy", "a"), (904, "no kept", "yy", "b"), (None, "the the", "en", "s2"), (905, "alone alone", "zz", "a"), (905, "alone", "zz", "a"), (905, "alone", "zz", "a")]
    rows += [(906, "the öl wa " * 400, "en", "s3")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS term", "1 AS n", "2 AS g", "3 AS value").repartition(4)
    assert sorted(map(tuple, divergence.audit(df).collect())) == audit_brute(rows)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_of_large_counts():
    draw = random.Random(5)
    for _ in range(2000):
        whole = draw.randrange(1, 9 * 10**15)
        n = draw.randrange(0, whole)
        assert int(divergence.shares(np.array([n]), np.array([whole]))[0]) == 1 + 10**9 * (n + 1) // whole
