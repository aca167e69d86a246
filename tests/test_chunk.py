"""Chunking strategies against plain loops over words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import chunk


def size(t):
    return len(t.split())


def pack(parts, most, overlap, heads, between):
    """Chunks as lists of words, and texts; the overlap is read off the words of the chunk before."""
    texts, inside = [], []
    for p in parts:
        head = bool(heads and re.match(r"(?i)(#{1,4}\s+|(chapter|section|part|appendix)\s+\d+)", p.strip()))
        held = sum(map(size, inside))
        if inside and ((head and held) or held + size(p) > most):
            texts.append(between.join(inside))
            ws = " ".join(inside).split()
            inside = [" ".join(ws[-overlap:])] if not (head and held) and overlap and len(ws) > overlap else []
        inside.append(p)
    return texts + ([between.join(inside)] if inside else [])


def by_paragraph(parts, most):
    out, short = [], []
    for p in parts:
        if size(p) > most:
            out += pack(re.split(r"(?<=[.!?])\s+", p), most, 0, False, " ")
        elif size(p) < most // 4:
            short.append(p)
        else:
            out.append("\n\n".join([*short, p]))
            short = []
    return out + (["\n\n".join(short)] if short else [])


def brute(text, strategy, most, least, overlap):
    parts = re.split(r"\n\s*\n", text.strip())
    head = re.match(r"(?i)(#{1,4}\s+|(chapter|section|part|appendix)\s+\d+[.:]?\s*)", text)
    if strategy == "semantic":
        out = pack(parts, most, overlap, True, "\n\n")
    elif strategy == "recursive" and head and text[head.end() :].strip():
        mark, rest = head[0].strip(), text[head.end() :].strip()
        if size(mark) + size(rest) <= most:
            out = [f"{mark}\n\n{rest}"]
        else:
            out = [mark, *(pack(re.split(r"(?<=[.!?])\s+", rest), most, 0, False, " ") if size(rest) > most else [rest])]
        if overlap and len(out) > 1:
            laid = [p if k == 0 or size(out[k - 1]) <= overlap else " ".join(out[k - 1].split()[-overlap:]) + "\n" + p for k, p in enumerate(out)]
            out = []
            for p in laid:
                if out and size(p) < least:
                    out[-1] += "\n" + p
                else:
                    out.append(p)
    else:
        out = by_paragraph(parts, most)
    rows = []
    for k, p in enumerate(out):
        if rows and size(p) < least:
            rows[-1][1] += "\n\n" + p
        else:
            rows.append([k, p])
    return [(k, p, size(p)) for k, p in rows]


def made(seed):
    draw, out = random.Random(seed), []
    for _ in range(draw.randrange(1, 14)):
        n = draw.choice([1, 3, 4, 8, 15, 30, 70])
        words = [f"w{draw.randrange(99)}" + draw.choice(["", "", "", ".", "!", "?"]) for _ in range(n)]
        out.append(draw.choice(["", "", "", "# ", "Chapter 3: ", "##### ", "part 2 "]) + " ".join(words))
    return draw.choice(["", "", " "]) + draw.choice(["\n\n", "\n \n"]).join(out)


@pytest.mark.parametrize("strategy", ["semantic", "paragraph", "recursive"])
@pytest.mark.parametrize(("most", "least", "overlap"), [(20, 5, 4), (20, 0, 0), (40, 12, 10), (9, 30, 3)])
def test_strategies(spark, strategy, most, least, overlap):
    texts = {k: made(k) for k in range(120)} | {900: "", 901: None, 902: " \n\n ", 903: "# ", 904: "chapter 1", 905: "# Head\n\n" + "word. " * 50}
    got = {}
    for r in chunk.folded(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", strategy, most, least, overlap).collect():
        got.setdefault(r["id"], []).append((r["index"], r["text"], r["word_count"]))
    for k, text in texts.items():
        assert sorted(got.get(k, [])) == (brute(text, strategy, most, least, overlap) if text and text.strip() else []), (k, text)


def test_merging(spark):
    parts = F.array(*[F.lit((c + " ") * n) for c, n in (("a", 5), ("b", 100), ("c", 3))])
    kept = spark.range(1).select(chunk.joined_to(parts, lambda p: chunk.word_count(p) >= 10, "\n\n").alias("x")).first()["x"]
    assert [(c["index"], size(c["text"])) for c in kept] == [(0, 5), (1, 103)]


def test_plan_is_native(spark):
    df = chunk.folded(spark.createDataFrame([(1, "a b\n\nc")], "id long, text string"), "id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_parts_are_judged_once(spark):
    """Joining small parts judges each part once, not all parts again for each chunk, which grew with the square of a text's parts."""
    rows = spark.createDataFrame([(["a b", "c", "d e", "f"],)], "parts array<string>")
    made = rows.select(chunk.joined_to(F.col("parts"), lambda p: chunk.word_count(p) >= 2, "-").alias("x"))
    assert [tuple(c) for c in made.first()["x"]] == [(0, "a b-c"), (2, "d e-f")]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("filter(") == 1
