"""Stores, model interfaces, whole runs and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.__main__ import main
from quillon.operators import models
from quillon.plans.engine import Engine, Settings
from quillon.sources import store

BOOK = """# Part 1

Best Practice: Research the demographics of the target audience before every sales campaign
Avoid: Trying to sell to everyone at once without a clear audience
Step 3: Write the email marketing sequence for the sales funnel

# Part 2

Best Practice: Keep a budget of the finance team for every month of the year
Example: The budget of a small finance team in its first year
"""


def test_keyed_table(spark, tmp_path):
    table = store.KeyedTable(spark, f"{tmp_path}/t", "id string, n int", ("id",))
    assert table.count() == 0 and table.get("a") is None
    table.save(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"))
    table.save(spark.createDataFrame([("a", 3), ("c", 4)], "id string, n long"))
    assert sorted((r["id"], r["n"]) for r in table.current().collect()) == [("a", 3), ("b", 2), ("c", 4)]
    assert table.delete(F.col("n") > 2) == 2 and not table.exists("a") and table.exists("b")
    table.save(spark.createDataFrame([("a",)], "id string"))
    table.compact()
    assert len(table._batches()) == 1 and sorted((r["id"], r["n"]) for r in table.current().collect()) == [("a", None), ("b", 2)]
    assert table.stats().first()["rows"] == 2
    table.clear()
    assert table.count() == 0


def test_unfinished_batch_is_not_read(spark, tmp_path):
    table = store.KeyedTable(spark, f"{tmp_path}/t", "id string", ("id",))
    table.save(spark.createDataFrame([("a",)], "id string"))
    (tmp_path / "t" / "batch=99999999999999999999").mkdir()
    assert table.count() == 1


def test_values_expire(spark, tmp_path):
    cache = store.Values(spark, f"{tmp_path}/v")
    cache.put(spark.createDataFrame([("a", "x"), ("b", None)], "key string, value string"))
    cache.put(spark.createDataFrame([("c", "y")], "key string, value string"), hours=-1)
    assert [r["key"] for r in cache.valid().collect()] == ["a"]


def test_json_and_file_names(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "1", "name": "Sales Funnel", "tags": ["x"]}))
    (tmp_path / "b.json").write_text(json.dumps({"id": "2", "name": "sales funnel", "category": "sales"}))
    (tmp_path / "c.json").write_text("{broken")
    rows = store.read_json(spark, str(tmp_path))
    got = {r["id"]: r for r in store.file_names(rows).collect()}
    assert sorted(got) == ["1", "2"] and got["1"]["pitfalls"] == [] and got["1"]["status"] == "draft"
    assert (got["1"]["file_name"], got["2"]["file_name"]) == ("sales-funnel", "sales-funnel-2")


def answering(text):
    return lambda: lambda prompt: text


def failing():
    def make():
        def ask(prompt):
            raise OSError("no model")

        return ask

    return make


def test_extraction_by_model_and_by_rule(spark):
    chunks = spark.createDataFrame([("c1", BOOK), ("c2", "plain text")], "chunk_id string, text string")
    unit = '{"type": "rule", "title": "one_rule", "content": "Ask before you sell anything", "tags": ["Sales"]}'
    by_model = models.extracted(chunks, "chunk_id", answering(f"```json\n[{unit}, {unit}]\n```"), wait=0.0).collect()
    assert [(r["chunk_id"], r["unit_type"], r["title"]) for r in sorted(by_model)] == [("c1", "rule", "One Rule"), ("c2", "rule", "One Rule")]
    by_rule = models.extracted(chunks, "chunk_id", failing(), wait=0.0).collect()
    assert {r["unit_type"] for r in by_rule} == {"best_practice", "anti_pattern", "workflow", "example"}


def test_review_and_building_by_model(spark):
    schema = "name string, description string, best_practices array<string>, pitfalls array<string>, workflow array<struct<title:string,description:string>>, examples array<struct<title:string,code:string>>, checklist array<string>, tags array<string>, category string, quality_score double"
    rows = spark.createDataFrame([("a", "d" * 60, ["x"], [], [], [], [], ["t"], "sales", 0.95)], schema)
    r = models.reviewed(rows, answering('{"score": 12.3, "notes": ["good"]}'), wait=0.0).first()
    assert (r["score"], r["status"], r["review_notes"], r["reviewed_by"]) == (10, "approved", ["good"], "model")
    assert models.reviewed(rows, answering("none"), wait=0.0).first()["score"] == 5
    b = models.built(rows, answering('{"name": "Better Name", "description": "short", "category": "cooking", "tags": ["New Tag"]}'), wait=0.0).first()
    assert (b["name"], b["description"], b["category"], b["quality_score"]) == ("better-name", "d" * 60, "sales", 1.0)
    assert models.built(rows, failing(), tries=2, wait=0.0).first()["name"] == "a"


def test_providers():
    models.register("fixed", answering("x"))
    assert models.provider("fixed")()("p") == "x"
    with pytest.raises(ValueError, match="unknown provider"):
        models.provider("none")


def test_settings():
    with pytest.raises(ValueError, match="smaller"):
        Settings(chunk_words=10, chunk_overlap=10)
    with pytest.raises(ValueError, match="strategy"):
        Settings(strategy="none")


def test_run(spark, tmp_path, capsys):
    folder = tmp_path / "books"
    folder.mkdir()
    (folder / "one.md").write_text(BOOK)
    (folder / "copy.md").write_text(BOOK)
    (folder / "bad.docx").write_bytes(b"no zip")
    engine = Engine(spark, f"{tmp_path}/store")
    made = engine.run(str(folder)).collect()
    assert len({r["book_id"] for r in made}) == 1 and all(r["source_book"] for r in made)
    assert {"finance", "sales", "marketing"} & {r["category"] for r in made}
    assert engine.report().where("NOT success").count() == 0
    assert engine.nodes.count() == len(made) and engine.vectors.current().where("source_type = 'chunk'").count() >= 1
    assert engine.run(str(folder)).count() == 0 and engine.skills.count() == len(made)
    assert engine.run(str(folder), incremental=False).count() == len(made) == engine.skills.count()
    assert engine.search("budget").count() >= 1 and engine.search("unicorn").count() == 0
    assert engine.similar_to("finance budget", source_type="skill").first()["score"] > 0
    assert engine.stats().first()["total"] == len(made)
    assert engine.list_books(str(folder)).count() == 3
    assert all(r["source_chapters"] and all(c.startswith("chunk_") for c in r["source_chapters"]) for r in made)
    assert {p.stem for p in (tmp_path / "store" / "markdown").glob("*.md")} >= {r["name"] for r in made}
    listed = engine.graphs.list().collect()
    assert [(r["graph_id"], r["nodes"], r["edges"]) for r in listed] == [(made[0]["book_id"], engine.nodes.count(), engine.edges.count())] and listed[0]["created_at"]
    assert engine.graphs.load("none") is None and engine.graphs.load(made[0]["book_id"])[0].count() == len(made)
    assert engine.export_markdown(str(tmp_path / "out")) == len(made) == len(list((tmp_path / "out").glob("*.md")))
    main(["--store", f"{tmp_path}/store", "delete", made[0]["id"]], spark)
    main(["--store", f"{tmp_path}/store", "stats"], spark)
    main(["--store", f"{tmp_path}/store", "settings"], spark)
    out = capsys.readouterr().out
    assert engine.graphs.delete(made[0]["book_id"]) and not engine.graphs.delete(made[0]["book_id"]) and engine.graphs.list().count() == 0 and engine.edges.count() == 0
    assert "1 deleted" in out and "chunk_words" in out and engine.skills.count() == len(made) - 1


def test_short_file_names(spark, tmp_path):
    long = "a" * 58 + "-" * 4 + "b"
    rows = [("1", long), ("2", "a" * 58 + "--c"), ("3", "plain"), ("4", "")]
    named = store.file_names(spark.createDataFrame(rows, "id string, name string"), 60)
    assert sorted((r["file_name"], r["id"]) for r in named.collect()) == [("a" * 58, "2"), ("plain", "3")]
