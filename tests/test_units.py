"""Units of made-up lines against a plain loop over the patterns."""

from __future__ import annotations

import itertools
import re

import pytest

from quillon.functions import vocabulary as V
from quillon.operators import knowledge

HEADS = (
    "Skill", "technique", "Best Practice", "best\t practice", "Pro tip", "RULE OF THUMB", "Rule of  Thumb", "Anti-pattern", "Anti - Pattern", "Watch Out", "Avoid", "Step 3", "Step", "Stage", "Rule 12", "Rule", "Law", "Lawn", "Always",
    "Never", "Example", "For example", "e.g.", "egg", "Processing", "Process", "Principle", "",
)
TAILS = (
    "", " ", ":", ": ", "-", ":: ", " : ", ": short", ": exactly ten", ": café — über alles: x", "\r: more words than ten", ": first words here\rsecond words", ": \r words behind a return", ": one two three four five",
    ":   nothing before this", ":\x85 nothing before", " plain words without a mark", "ing plain words without a mark", " 12345678901234", ": 😀😀😀😀😀😀😀😀😀😀", " Stage: the second of two heads",
)


def plain(line: str, allowed: tuple[str, ...], least: float) -> tuple[str, str] | None:
    line = line.strip(" ")
    for name, pattern in V.UNIT_PATTERNS:
        m = re.match("(?i)" + pattern.replace("(.+)", "([^\\n\\r\\x85\\u2028\\u2029]+)"), line, re.ASCII)
        if m and len(content := m[2].strip(" ")) >= 10:
            base = round(1000 * V.BASE_CONFIDENCE.get(name, 0.4))
            return (name, content) if name in allowed and (min(base + min(len(content), 300), 950) + 5) // 10 / 100 >= least else None
    return None


@pytest.mark.parametrize(("allowed", "least"), [(V.UNIT_TYPES, 0.3), (("rule", "workflow"), 0.3), (V.UNIT_TYPES, 0.45), ((), 0.3)])
def test_units_of_made_up_lines(spark, allowed, least):
    lines = [h + t for h, t in itertools.product(HEADS, TAILS)] + ["  " + h + t for h, t in itertools.product(HEADS, TAILS)]
    rows = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    got = {r["id"]: (r["unit_type"], r["content"]) for r in knowledge.units(rows, ["id"], least=least, allowed=allowed).collect()}
    assert got == {i: found for i, line in enumerate(lines) if (found := plain(line, allowed, least))}


def test_tags_are_those_of_all_keywords(spark):
    words = [k for k, _ in V.TAG_KEYWORDS]
    texts = [f"Always {a} and {b.upper()} as ever" for a, b in zip(words, words[7:] + words[:7], strict=True)] + ["Always no word of these at all", "Always produKt or PRİCING or ſales", "Always K productivity and Brandİng"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: list(r["tags"]) for r in knowledge.units(rows, ["id"]).collect()}
    want = [list(dict.fromkeys(t for k, t in V.TAG_KEYWORDS if k in x[7:].lower()))[:5] for x in texts]
    assert got == dict(enumerate(want))


def test_a_line_is_matched_by_its_head_alone(spark):
    """The whole line is not gone through by a regular expression: that took most of the time of all queries on units."""
    plan = knowledge.units(spark.createDataFrame([(1, "Always a long line")], "id long, text string"), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "(.+)" not in plan and plan.count("regexp_extract") == 1


def test_titles_and_types_are_made_in_steps(spark):
    """What a title or a type is made of is computed once, and a content is cut only where one of its four ends occurs."""
    plan = knowledge.units(spark.createDataFrame([(1, "Always a long line")], "id long, text string"), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring_index(") == 4 + 2 and plan.count("[^A-Za-z]") == 1


def test_tags_within_one_batch_and_over_pieces():
    """Keywords at the ends of contents, over two contents, in parts of an Arrow array, and cut by a piece's end are told apart."""
    import pyarrow as pa

    from quillon.functions import text as T

    words = [k for k, _ in V.TAG_KEYWORDS]
    texts = [None, "", "se", "o", "social", " media", "social media", "SOCIAL MEDIA", "apİ", "marKeting", "é" * 9 + "brandé", *words, *(w[:-1] for w in words), *(w[1:] for w in words), " ".join(words)] * 3
    want = [[] if x is None else list(dict.fromkeys(t for k, t in V.TAG_KEYWORDS if k in x.lower())) for x in texts]
    array = pa.array(texts, pa.string())
    assert T._tags_of.func(array).to_pylist() == want and T._tags_of.func(array[7:100]).to_pylist() == want[7:100]
    kept, T._PIECE = T._PIECE, 40
    try:
        plain = [(x, w) for x, w in zip(texts, want, strict=True) if x is not None and x.isascii()]
        assert T._tags_of.func(pa.array([x for x, _ in plain])).to_pylist() == [w for _, w in plain]
    finally:
        T._PIECE = kept


def test_records_take_one_list_of_contents(spark):
    """Records of units without references sort once and gather contents in one list; with references they are the same."""
    from quillon.operators import skills

    lines = [(i // 40, i, kind, f"Title {i}", f"content number {i % 23} that is long enough", 0.5 + i % 5 / 10, ["sales", f"tag-{i % 3}"]) for i, kind in enumerate(V.UNIT_TYPES * 30)]
    units = spark.createDataFrame([x for x in lines if x[2] != "reference"], "grp long, ord long, unit_type string, title string, content string, confidence double, tags array<string>")
    lean = skills.records(units, "grp", references=False)
    plan = lean._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Expand" not in plan
    assert sorted(map(str, lean.collect())) == sorted(map(str, skills.records(units, "grp").collect()))


def test_lines_are_chosen_without_making_their_contents(spark):
    """Lines become one array, and contents are made of the chosen ones only, outside of lambdas; ends and spaces near ten characters count as in a plain loop."""
    tails = [f": {'x' * a}{gap}{end}{'y' * b}" for a in (1, 8, 9, 10, 11) for gap in ("", "   ", " " * 12) for end in ("", "\r", "\x85", "\u2028", "\u2029") for b in (0, 1, 9)]
    tails += [": " + x for x in ("é" * 9, "é" * 10, "😀" * 9 + " ", "😀" * 9 + " .", "a" + " " * 40 + "b", "a" + " " * 40 + "\r b", "é" * 9 + "\x85" + "é" * 9)]
    lines = [head + tail for head in ("Avoid", "  Rule 2", "best \t practice", "Always") for tail in tails]
    rows = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    for least in (0.3, 0.45):
        found = knowledge.units(rows, ["id"], least=least)
        assert {r["id"]: (r["unit_type"], r["content"]) for r in found.collect()} == {i: x for i, line in enumerate(lines) if (x := plain(line, V.UNIT_TYPES, least))}
    plan = knowledge.units(rows, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") == 2  # of lines, and of a title's words


def test_long_contents_are_told_by_bytes(spark):
    """Of a content of more than 120 bytes no characters are counted; those of few bytes are told apart at 31 characters."""
    from quillon.operators import skills

    texts = ["é" * 30, "é" * 31, "😀" * 30, "😀" * 31, "x" * 30, "x" * 121]
    rows = [(i, i, "workflow", f"Title {i}", x, 0.5, ["sales"]) for i, x in enumerate(texts)]
    made = skills.records(spark.createDataFrame(rows, "grp long, ord long, unit_type string, title string, content string, confidence double, tags array<string>"), "grp", references=False)
    got = {r["grp"]: r["description"] for r in made.collect()}
    assert got == {i: x if len(x) > 30 else "Skill derived from 1 knowledge units." for i, x in enumerate(texts)}
    assert "octet_length(content" in made._jdf.queryExecution().optimizedPlan().toString()
