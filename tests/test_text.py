"""Golden cases of the scalar functions, chunkers, sources and searches."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.functions import clean
from quillon.functions import text as T
from quillon.operators import chunk, knowledge, search, similar, skills
from quillon.sources import files
from quillon.streaming import ingest


def value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], list(cells)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "name"), [("SingleClickAction", "single-click-action"), ("single_click_action", "single-click-action"), ("Command Attention Technique", "command-attention"), ("How to RecordedWebinars", "how-to-recorded-webinars"), ("Sales Funnel!!!", "sales-funnel"), ("", "")])
def test_skill_name(spark, raw, name):
    assert value(spark, T.skill_name(F.col("x")), x=raw) == name


@pytest.mark.parametrize(("raw", "title"), [("BufferFoundingStory", "Buffer Founding Story"), ("external_trigger_examples", "External Trigger Examples"), ("the art of war", "The Art of War"), ("iPhone and the web", "I Phone and the Web")])
def test_title(spark, raw, title):
    assert value(spark, T.title(F.col("x")), x=raw) == title


def test_slug(spark):
    assert value(spark, T.slug(F.col("x")), x="C++ & Python!") == "c-python"


def test_clean(spark):
    row = clean.cleaned(spark.createDataFrame([("  Hello   World!\n\n\nThis is a test.\n\n\n\n",)], ["text"])).first()
    assert row["text"] == "Hello World!\n\nThis is a test."
    assert row["transformations"] == ["blank_line_collapse", "trailing_whitespace_removed", "space_normalisation"]
    assert row["quality_score"] == 1.0


@pytest.mark.parametrize(("line", "dropped"), [("Page 12", True), ("page 3", True), ("3 / 42", True), ("Copyright © 2020 X", True), ("All rights reserved.", True), ("_" * 10, True), ("-=" * 10, True), ("Page 12 of 30", False), ("Copyright (c) 2020", False), ("_" * 9, False), ("-" * 19, False)])
def test_page_marks(spark, line, dropped):
    assert (value(spark, clean.without_page_marks(F.col("x")), x=f"a\n{line}\nb") == "a\nb") is dropped


def test_fixed_chunks(spark):
    text = " ".join(f"w{i}" for i in range(1, 12))
    rows = chunk.fixed(spark.createDataFrame([(1, text)], "id long, text string"), "id", 5, 2).orderBy("index").collect()
    assert [r["text"].split()[0] + "-" + r["text"].split()[-1] for r in rows] == ["w1-w5", "w4-w8", "w7-w11"]


@pytest.mark.parametrize(("line", "kind", "content", "confidence"), [
    ("Best Practice: Research demographics before every sales campaign", "best_practice", "Research demographics before every sales campaign", 0.65),
    ("Avoid: Trying to sell to everyone at once", "anti_pattern", "Trying to sell to everyone at once", 0.63),
    ("Step 3: Write the email sequence", "workflow", "Write the email sequence", 0.42),
    ("Always be closing deals today", "rule", "be closing deals today", 0.42),
    ("Lawyer advice is expensive", "rule", "yer advice is expensive", 0.42),
])
def test_unit(spark, line, kind, content, confidence):
    row = knowledge.units(spark.createDataFrame([(1, line)], "id long, text string"), ["id"]).first()
    assert (row["unit_type"], row["content"], row["confidence"]) == (kind, content, confidence)


@pytest.mark.parametrize("line", ["Strategy: short", "Process - gather inputs first", "Best Practice — Know the niche"])
def test_no_unit(spark, line):
    assert knowledge.units(spark.createDataFrame([(1, line)], "id long, text string"), ["id"]).count() == 0


def test_hash_vector(spark):
    rows = similar.hashed_vector(spark.createDataFrame([(1, "marketing"), (2, "audience"), (3, "research"), (4, "the of")], "id long, text string"), "id", F.col("text")).collect()
    assert {(r["id"], r["bucket"], r["value"]) for r in rows} == {(1, 327, -1.0), (2, 227, -1.0), (3, 244, -1.0)}


def test_name_ratio(spark):
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], ["a", "b"])
    assert [r["r"] for r in rows.select(similar.name_ratio("a", "b").alias("r")).collect()] == [0.25, 0.5]


def test_review_and_text(spark):
    schema = "name string, description string, best_practices array<string>, pitfalls array<string>, workflow array<struct<title:string,description:string>>, examples array<struct<title:string,code:string>>, checklist array<string>, references array<string>, tags array<string>, category string"
    rows = spark.createDataFrame([("a", "d" * 60, ["x"], ["y"], [], [], [], [], ["t"], "sales"), ("b", "d" * 60, [], [], [], [], [], [], [], "sales")], schema)
    first, second = skills.reviewed(rows).orderBy("name").collect()
    assert (first["score"], first["status"], first["review_notes"]) == (6, "reviewed", ["no workflow", "no examples"])
    assert first["review_feedback"] == "Skill is acceptable but needs improvements before approval."
    assert (second["score"], second["status"]) == (3, "rejected")
    full = spark.createDataFrame([("a", "d", ["x", "z"], ["y"], [("S", "do"), ("T", "")], [("E", "code")], [], ["r"], ["t", "u"], "sales")], schema).withColumn("version", F.lit("1.0.0"))
    text = full.select(skills.markdown(full).alias("m")).first()["m"]
    assert text == (
        '---\nname: a\ndescription: "d"\nversion: 1.0.0\ntags: [t, u]\ncategory: sales\n---\n\n# a\n\nd\n\n## Best Practices\n\n- x\n- z\n\n'
        "## Workflow\n\n### 1. S\n\ndo\n\n### 2. T\n## Examples\n\n### E\n```\ncode\n```\n\n## Pitfalls\n\n- ⚠️ y\n\n## References\n\n- r\n"
    )


def test_keyword_search(spark):
    rows = spark.createDataFrame([(1, "audience-research", "Research your target audience"), (2, "pricing", "How to price")], "id long, name string, body string")
    found = search.keyword(rows, "audience research", [F.col("name"), F.col("body")], F.col("name"), "id").collect()
    assert [(r["id"], r["score"]) for r in found] == [(1, 6)]
    assert search.keyword(rows, " ", [F.col("name")], F.col("name"), "id").count() == 0


def test_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>' + "".join(f"<w:p><w:r><w:t>{c * 1500}</w:t></w:r></w:p>" for c in "abc") + "</w:body></w:document>")
    (tmp_path / "b.txt").write_text("one\n\ntwo")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    found = files.books(spark, str(tmp_path))
    assert found.count() == 3
    pages = files.extracted(found).collect()
    assert sorted(len(r["text"]) for r in pages if r["text"]) == [7, 1500, 3001]
    assert [r["page_no"] for r in pages if r["error"]] == [0]
    assert io.BytesIO is not None


def test_stream(spark, tmp_path):
    rows = [(1, "Avoid: Trying to sell to everyone at once"), (2, "Avoid: Trying to sell to everyone at once"), (3, "Step 3: Write the email sequence")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    query = ingest.start(ingest.documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
