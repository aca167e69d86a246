"""Duplicates, relations and vectors against plain loops over a small collection."""

import difflib
import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.functions import vocabulary as V
from quillon.operators import embed, relations, similar
from quillon.operators.lineage import written

SCHEMA = (
    "book string, no long, name string, description string, best_practices array<string>, pitfalls array<string>, checklist array<string>, "
    "references array<string>, tags array<string>, category string, knowledge_ids array<long>, quality_score double"
)
WORDS = "market price audience funnel sales email research budget team product launch customer brand survey offer growth".split()


def made(n=40):
    r = random.Random(5)
    rows = []
    for i in range(n):
        if i % 4 == 3:  # a near copy of an earlier record
            base = list(rows[r.randrange(len(rows))])
            base[1], base[3], base[11] = i, f"{base[3]} {r.choice(WORDS)}", r.choice([0.3, 0.6, 0.9])
            rows.append(tuple(base))
            continue
        words = r.sample(WORDS, 5)
        name = "-".join(r.sample(WORDS, r.choice([1, 2, 3])) + (["basics"] if i % 7 == 0 else []))
        rows.append((f"b{i % 2}", i, name, " ".join(words), [" ".join(r.sample(WORDS, 4))], [], [], [], r.sample(WORDS[:5], 2), r.choice(["sales", "product", ""]), [i, i // 2], r.choice([0.3, 0.6, 0.9])))
    return [*rows, ("b0", n, "empty", "", [], [], [], [], [], "", [], 0.1), ("b1", n, "", "", [], [], [], [], [], "", [], 0.1)]


def vector(text):
    out = [0.0] * 384
    for t, k in Counter(t for t in re.findall("[a-z]+(?:'[a-z]+)?", text.lower()) if len(t) > 1 and t not in V.STOPWORDS).items():
        h = hashlib.md5(t.encode()).digest()
        out[int.from_bytes(h[:4], "little") % 384] += math.sqrt(k) * (1 if h[4] % 2 == 0 else -1)
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


def text(r):
    return " ".join([r["name"], r["description"], *[" ".join(r[c]) for c in ("best_practices", "pitfalls", "checklist", "references")]])


def cosine(a, b):
    return sum(x * y for x, y in zip(vector(text(a)), vector(text(b)), strict=True))


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0


def plain(name):
    return " ".join(re.sub(r"[^a-zA-Z0-9\s]", "", name).lower().split())


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(made(), SCHEMA).withColumn("key", F.concat_ws("-", "book", "no"))
    return written(df.join(embed.dense(df, "key", embed.skill_text()), "key"), "records")


def test_dense(rows):
    for r in rows.collect():
        assert r["vector"] == pytest.approx(vector(text(r)))


def test_edges(rows, monkeypatch):
    want = set()
    data = sorted(rows.collect(), key=lambda r: r["no"])
    for i, a in enumerate(data):
        for b in data[i + 1 :]:
            if a["book"] != b["book"]:
                continue
            c, t, n = cosine(a, b), jaccard(a["tags"], b["tags"]), difflib.SequenceMatcher(None, a["name"], b["name"]).ratio()
            weight = c if c >= 0.7 else t if t >= 0.4 else n if n >= 0.6 else 0.5 if jaccard(a["knowledge_ids"], b["knowledge_ids"]) > 0.3 else 0.4 if a["category"] and a["category"] == b["category"] else None
            if weight is not None:
                want.add((a["no"], b["no"], "related_to", round(weight, 3)))
            pa, pb = plain(a["name"]), plain(b["name"])
            for base, whole, s, e in ((pa, pb, b, a), (pb, pa, a, b)):
                if len(base) >= 4 and base in whole:
                    want.add((s["no"], e["no"], "extends", round(len(base) / len(whole), 3)))
                    break
            ka, kb = (any(k in p for k in V.PREREQUISITE_KEYWORDS) for p in (pa, pb))
            if ka != kb:
                want.add((a["no"], b["no"], "prerequisite", 1.0) if ka else (b["no"], a["no"], "prerequisite", 1.0))
    got = {(r["source"], r["target"], r["type"], r["weight"]) for r in similar.edges(rows, "book", "no").collect()}
    assert {g[2] for g in got} == {"related_to", "extends", "prerequisite"}
    assert got == want
    monkeypatch.setattr(relations, "BLOCK", 5)  # several tiles a scope
    known = written(relations.members(rows, "book", "no"), "members")
    found = written(relations.relations(rows, "book", "no", known), "relations")
    assert {(r["source"], r["target"], r["type"], r["weight"]) for r in relations.expanded(found, known, "book", "no").collect()} == want
    assert {r["layer"] for r in found.collect()} == {"vector", "tags", "name", "units", "category", "keyword"}


def test_classes_are_linear_in_the_records(spark):
    row = lambda i: ("b", i, "market-basics" if i % 3 else "market", "sales funnel budget", [], [], [], [], ["sales", "budget"][: 1 + i % 2], "sales", [i], 0.5)
    sizes = {}
    for n in (60, 600):
        df = spark.createDataFrame([row(i) for i in range(n)], SCHEMA).withColumn("key", F.concat_ws("-", "book", "no"))
        found = relations.relations(df.join(embed.dense(df, "key", embed.skill_text()), "key"), "book", "no").collect()
        sizes[n] = len(found)
        vectors = [r for r in found if r["layer"] == "vector"]
        assert sum(r["n_a"] * (r["n_a"] - 1) // 2 if r["a"] == r["b"] else r["n_a"] * r["n_b"] for r in vectors) == n * (n - 1) // 2
        assert [(r["n_a"], r["n_b"], r["weight"]) for r in found if r["type"] == "extends" and r["a"] != r["b"]] == [(n - n // 3, n // 3, 0.5)]
    assert sizes[60] == sizes[600] < 20


def test_name_ratios_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(relations, "BLOCK", 16)
    draw = random.Random(9)
    names = sorted({"".join(draw.choice("abcde-é") for _ in range(draw.randrange(0, 14))) for _ in range(90)} - {""})
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate(names)] + [("t", 0, "alone")], "scope string, no long, name string")
    got = {(r["a"], r["b"]): r["ratio"] for r in relations.name_pairs(df, "scope", "no", 0.6).where("scope = 's'").collect()}
    want = {(i, j): x for i, a in enumerate(names) for j, b in enumerate(names) if (x := difflib.SequenceMatcher(None, a, b).ratio()) >= 0.6}
    assert got == want
    parts = {(r["a"], r["b"]): r["weight"] for r in relations.contained_names(df, "scope", "no").where("scope = 's'").collect()}
    assert parts == {(i, j): round(len(b) / len(a), 3) for i, a in enumerate(names) for j, b in enumerate(names) if i != j and len(b) >= 4 and b in a}


def greedy(data, duplicates):
    """Into which record each goes, by the order-dependent scan; ``duplicates(old, new)`` gives a method or None."""
    gone, why, left = {}, {}, []
    for new in data:
        for old in left:
            method = duplicates(old, new)
            if method:
                kept, lost = (new, old) if new["quality_score"] > old["quality_score"] else (old, new)
                gone[lost["no"]], why[lost["no"]] = kept["no"], method
                if lost is old:
                    left.remove(old)
                    left.append(new)
                break
        else:
            left.append(new)
    return gone, why


def test_survivors_of_chains_and_better_ones(spark, monkeypatch):
    """Random graphs of duplicates: chains, cliques, and newer ones of higher quality that free what the removed one held."""
    draw = random.Random(12)
    rows, links = [], set()
    for g in range(12):
        n = draw.randrange(2, 22)
        for i in range(n):
            rows.append((f"s{g}", i, draw.choice([0.1, 0.2, 0.3, 0.4, 0.5]) if g % 3 else 0.1))
            for j in range(i):
                if (g % 4 == 0 and j == i - 1) or (g % 4 == 1) or (g % 4 > 1 and draw.random() < 0.3):
                    links.add((f"s{g}", j, i))
    df = spark.createDataFrame(rows, "scope string, no long, quality_score double")
    pairs = spark.createDataFrame([(s, a, b, 0.9 if (a + b) % 2 else 0.5) for s, a, b in sorted(links)], "scope string, a long, b long, cosine double")
    monkeypatch.setattr(relations, "duplicate_pairs", lambda *_: pairs)
    got = {(r["scope"], r["no"]): (r["survivor"], r["method"], r["similarity"]) for r in relations.survivors(df, "scope", "no").collect()}
    assert len(got) == len(rows)
    for g in range(12):
        data = [{"no": no, "quality_score": q} for s, no, q in rows if s == f"s{g}"]
        gone, why = greedy(data, lambda old, new: ("semantic" if (old["no"] + new["no"]) % 2 else "lexical") if (f"s{g}", min(old["no"], new["no"]), max(old["no"], new["no"])) in links else None)  # noqa: B023
        for r in data:
            end = r["no"]
            while end in gone:
                end = gone[end]
            method = why.get(r["no"])
            assert got[f"s{g}", r["no"]] == (end, method, {None: None, "semantic": 0.9, "lexical": 0.5}[method])


def test_survivors_and_merging(rows):
    data = sorted(rows.collect(), key=lambda r: r["no"])
    gone, why = {}, {}
    tokens = lambda r: {w for w in re.findall("[a-z0-9]+", " ".join([r["description"], *r["best_practices"], *r["pitfalls"], *r["checklist"]]).lower()) if len(w) > 2 and w not in V.CONTENT_STOPWORDS}
    for book in ("b0", "b1"):
        left = []
        for new in (r for r in data if r["book"] == book):
            for old in left:
                c = cosine(old, new)
                names = difflib.SequenceMatcher(None, plain(old["name"]), plain(new["name"])).ratio()
                if c < 0.85 and (names < 0.75 or jaccard(tokens(old), tokens(new)) < 0.6):
                    continue
                kept, lost = (new, old) if new["quality_score"] > old["quality_score"] else (old, new)
                gone[book, lost["no"]], why[book, lost["no"]] = kept["no"], "semantic" if c >= 0.85 else "lexical"
                if lost is old:
                    left.remove(old)
                    left.append(new)
                break
            else:
                left.append(new)
    found = relations.survivors(rows, "book", "no")
    got = {(r["book"], r["no"]): r for r in found.collect()}
    assert gone and len(got) == len(data)
    for key, r in got.items():
        end = key[1]
        while (key[0], end) in gone:
            end = gone[key[0], end]
        assert (r["survivor"], r["method"]) == (end, why.get(key))
    kept = similar.merged(rows, found, "book", "no").collect()
    assert {(r["book"], r["no"]) for r in kept} == set(got) - set(gone)
    for r in kept:
        parts = [d for d in data if d["book"] == r["book"] and got[d["book"], d["no"]]["survivor"] == r["no"]]
        assert set(r["tags"]) == {t for p in parts for t in p["tags"]} and set(r["knowledge_ids"]) == {k for p in parts for k in p["knowledge_ids"]}


def test_embedding_once_a_text(spark):
    cache = spark.createDataFrame([], embed.CACHE_SCHEMA)
    docs = spark.createDataFrame([(1, "sales funnel"), (2, "sales funnel"), (3, None), (4, "  "), (5, "the of")], "id long, text string")
    out, fresh = embed.embedded(docs, cache)
    got = {r["id"]: r["vector"] for r in out.collect()}
    assert fresh.count() == 2 and got[1] == got[2] and got[3] is None and got[4] is None and set(got[5]) == {0.0}
    assert embed.missing(docs.where("id < 3"), spark.createDataFrame(fresh.collect(), embed.CACHE_SCHEMA), "hash", 384).count() == 0
    model, _ = embed.embedded(docs, cache, "lengths", 2, lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert {r["id"]: r["vector"] for r in model.collect()}[1] == [12.0, 1.0]
