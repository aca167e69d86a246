"""Steps that must stay cheap, and give the same as before, on large tables."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vocabulary as V
from quillon.operators import embed, knowledge, similar, skills
from quillon.plans.queries import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_units_take_each_pattern_once_and_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "Avoid: trying to sell to everyone\nplain\nRule 2: keep the email list clean"), (2, None)], "id long, text string")
    found = knowledge.units(rows, ["id"])
    plan = plan_of(found)
    assert "Window" not in plan and plan.count("Watch") == 1
    assert [(r["line_no"], r["unit_type"], r["tags"]) for r in found.orderBy("line_no").collect()] == [(0, "anti_pattern", []), (2, "rule", ["email-marketing"])]
    assert knowledge.units(rows, ["id"], most=1).count() == 1


def test_tags_of_null_and_of_many_keywords(spark):
    rows = spark.createDataFrame([(1, None), (2, "A JavaScript API for SALES teams and Productivity")], "id long, text string")
    got = {r["id"]: r["t"] for r in rows.select("id", T.inferred_tags(rows["text"]).alias("t")).collect()}
    low = "a javascript api for sales teams and productivity"
    assert got == {1: [], 2: [t for k, t in V.TAG_KEYWORDS if k in low][:5]}


def test_similar_sets_lose_no_pair(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    sets = [draw.sample(words, draw.randrange(1, 50)) for _ in range(60)]
    for _ in range(60):  # near and exact copies
        base = list(draw.choice(sets))
        sets.append([w for w in base if draw.random() > draw.choice([0, 0.1, 0.4])] or base)
    sets += [[], sets[0], sets[0][::-1]]
    df = spark.createDataFrame([("s" if i % 5 else "t", i, x) for i, x in enumerate(sets)], "scope string, no long, items array<string>")
    for least in (0.4, 0.6, 0.8):
        got = {(r["a"], r["b"]): r["similarity"] for r in similar.similar_sets(df, "scope", "no", least).collect()}
        want = {(i, j): s for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and (i % 5 == 0) == (j % 5 == 0) and a and b and (s := len(set(a) & set(b)) / len(set(a) | set(b))) >= least}
        assert got == want


def test_sets_that_share_an_item_by_chance_are_not_compared(spark, monkeypatch):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(2_000)]
    df = spark.createDataFrame([("s", i, draw.sample(words, 60)) for i in range(300)], "scope string, no long, items array<string>")
    kept = {}
    real = similar.written
    monkeypatch.setattr(similar, "written", lambda df, name: kept.setdefault(name, real(df, name)) if name == "candidates" else real(df, name))
    assert similar.similar_sets(df, "scope", "no", 0.6).count() == 0
    assert kept["candidates"].count() < 1_000  # some 10,000 pairs share one of the rarest 25 items


def test_unique_names_of_lone_names_take_no_task_of_their_own(spark):
    draw = random.Random(8)
    pool = ["plan", "rule-2", "step-3", "list", "list-2", "list-2-2", "list-02", "list-4", "a-1-2", "a"]
    rows = [(part, i, draw.choice(pool[:3] if part == "x" else pool)) for part in "xy" for i in range(300)]
    df = spark.createDataFrame(rows, "part string, no long, name string")
    seen = []
    real = skills.numbered
    skills.numbered = lambda d, by, *rest: (seen.append((by, d.where("_in = 'x'").count())), real(d, by, *rest))[1]
    try:
        got = {(r["part"], r["no"]): r["name"] for r in skills.unique_names(df.withColumn("o", F.struct("part", "no")), "o", "part").collect()}
    finally:
        skills.numbered = real
    want, taken = {}, {"x": set(), "y": set()}
    for part, i, name in rows:
        own = name if name not in taken[part] else next(f"{name}-{n}" for n in range(2, 1000) if f"{name}-{n}" not in taken[part])
        taken[part].add(own)
        want[part, i] = own
    assert got == want
    assert seen == [(["_in", "_before"], 300), (["_in", "_root"], 0)]


def cancelling():
    """Two words of one bucket and different signs, and one of negative sign elsewhere."""
    at = {w: (int.from_bytes((h := hashlib.md5(w.encode()).digest())[:4], "little") % 384, h[4] % 2) for w in map("".join, itertools.product("bcdfgk", repeat=4))}
    first, second = next((a, b) for a, b in itertools.combinations(at, 2) if at[a][0] == at[b][0] and at[a][1] != at[b][1])
    return first, second, next(w for w in at if at[w][0] != at[first][0] and at[w][1])


def test_buckets_that_cancel_out_count_as_zero(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(cancelling())), (2, " ".join(cancelling()[:2])), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["hash_embedding"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [(1, 1, 0.0, -1.0)]


def test_vectors_are_made_in_place(spark):
    first, second, other = cancelling()
    df = spark.createDataFrame([(1, f"{first} {second} {other}"), (2, f"{first} {second}"), (3, None), (4, "sales sales funnel don't")], "id long, text string")
    found = embed.dense(df, "id", F.col("text"))
    plan = plan_of(found)
    assert "Join" not in plan and "Aggregate" not in plan
    got = {r["id"]: r["vector"] for r in found.collect()}
    cells = {(r["id"], r["bucket"]): r["value"] for r in similar.hashed_vector(df, "id", F.col("text")).collect()}
    assert set(got) == {1, 2, 3, 4} and {len(v) for v in got.values()} == {384}
    assert all(abs(x - cells.get((i, k), 0.0)) < 1e-12 for i, v in got.items() for k, x in enumerate(v))
