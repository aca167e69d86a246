"""What surrounds the engine: resumed and partial runs, services, reports, small files, the prompt, timeouts."""

import io
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quillon.__main__ import main
from quillon.functions import vocabulary as V
from quillon.operators import knowledge, models, providers, search, skills
from quillon.plans import report
from quillon.plans.engine import Engine, Settings
from quillon.plans.jobs import Jobs
from quillon.plans.shell import Shell
from quillon.sources import files, store, texts
from tests.test_engine import BOOK
from tests.test_pdf import pdf


def test_runs_go_on_where_they_stopped(spark, tmp_path, monkeypatch):
    folder = tmp_path / "books"
    folder.mkdir()
    (folder / "one.MD").write_text(BOOK)
    (folder / "two.pdf").write_bytes(pdf([b"BT (Rule 1: Always ask the customer before you sell) Tj 0 -12 Td (Avoid: Selling to everyone at once, always) Tj ET"]))
    (folder / "bad.pdf").write_bytes(b"no")
    engine = Engine(spark, f"{tmp_path}/store")
    parts = engine.run_stage(str(folder), "chunk")
    assert {"chunk_id", "text"} <= set(parts.columns) and parts.count() >= 2
    with pytest.raises(ValueError, match="unknown stage"):
        engine.run_stage(str(folder), "none")
    monkeypatch.setattr(Engine, "_graph", lambda self, kept: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        engine.run(str(folder))
    told = {r["stage"]: r for r in engine.report().collect()}
    assert told["extract"]["restored"] and not told["knowledge"]["restored"] and told["graph"]["error"] == "OSError: lost" and told["chunk"]["tokens"] > 0
    monkeypatch.undo()
    engine.metrics.reset()
    made = engine.run(str(folder)).collect()
    told = {r["stage"]: r for r in engine.report().collect()}
    assert all(told[s]["restored"] for s in ("extract", "embed", "dedup")) and not told["graph"]["restored"] and told["store"]["items"] == len(made)
    assert {r["source_book"] for r in made} == {"one.MD", "two.pdf"} and len({r["name"] for r in made}) == len(made)
    assert [(r["file_name"], r["error"]) for r in engine.errors.current().collect()] == [("bad.pdf", "ValueError: not a PDF file")]
    assert engine.pending(str(folder), incremental=False, by_skills=True).count() == 1
    assert engine.run_file(str(folder / "two.pdf")).count() >= 1
    out = io.StringIO()
    shell = Shell(engine, str(folder), stdin=io.StringIO("books\nskills\nsearch customer\nstats\nshow " + made[0]["id"] + "\nshow x\n\nquit\n"), stdout=out)
    shell.cmdloop()
    assert "two.pdf" in out.getvalue() and f"total: {len(made)}" in out.getvalue() and "# " + made[0]["name"] in out.getvalue() and "no such skill" in out.getvalue()


def test_steps_that_fail_or_are_added(spark, tmp_path, monkeypatch):
    folder = tmp_path / "books"
    folder.mkdir()
    (folder / "one.md").write_text(BOOK)
    engine = Engine(spark, f"{tmp_path}/store", Settings(types=("best_practice", "example")))
    engine.after["knowledge"] = [lambda df: df.withColumn("title", F.upper("title"))]
    found = engine.run_stage(str(folder), "knowledge").collect()
    assert {r["unit_type"] for r in found} == {"best_practice", "example"} and all(r["title"] == r["title"].upper() for r in found)
    monkeypatch.setattr("quillon.plans.engine.cleaned", lambda docs: (_ for _ in ()).throw(ValueError("dirty")))
    other = Engine(spark, f"{tmp_path}/other")
    with pytest.raises(ValueError, match="dirty"):
        other.run(str(folder))
    assert other.run(str(folder), skip_on_error=True).count() >= 1
    for wrong in ({"types": ("none",)}, {"extractor": "none"}):
        with pytest.raises(ValueError, match="unknown"):
            Settings(**wrong)


def test_reading_modes(spark, tmp_path):
    (tmp_path / "scan.pdf").write_bytes(pdf([b""]))
    (tmp_path / "poor.pdf").write_bytes(pdf([b"BT (co-) Tj 0 -12 Td (operate) Tj ET"]))
    (tmp_path / "a.txt").write_text("plain words")
    rows = files.books(spark, str(tmp_path))
    names = {r["file_hash"]: r["file_name"] for r in rows.select("file_hash", "file_name").collect()}
    got = lambda **k: sorted((names[r["file_hash"]], r["method"], r["text"]) for r in files.read(rows, **k).collect())
    seen = lambda content: ["seen", " "]
    assert got() == [("a.txt", "direct", "plain words"), ("poor.pdf", "direct", "cooperate"), ("scan.pdf", "direct", "")]
    assert got(mode="ocr", scanned=seen) == [("a.txt", "direct", "plain words"), ("poor.pdf", "ocr", "seen"), ("scan.pdf", "ocr", "seen")]
    assert got(mode="hybrid", scanned=seen)[1:] == [("poor.pdf", "hybrid", "seen"), ("scan.pdf", "hybrid", "seen")]
    with pytest.raises(ValueError, match="reader of scans"):
        files.read(rows, "ocr")


@pytest.fixture
def service():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, dict(self.headers), body))
            status, reply = (503, {}) if len(asked) == 1 and self.path == "/busy" else (400, {}) if self.path == "/bad" else (200, self.replies[self.path])
            data = json.dumps(reply).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        chat = {"choices": [{"message": {"content": "one"}}]}
        replies = {"/chat": chat, "/busy": chat, "/messages": {"content": [{"type": "text", "text": "two"}]}, "/m:generate": {"candidates": [{"content": {"parts": [{"text": "three"}]}}]}, "/local": {"message": {"content": "four"}}}

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_services(service):
    url, asked = service
    ask = lambda name, path, **k: providers.asked(providers.SERVICES[name], "hello", "key", url=url + path, wait=0.01, **k)
    assert ask("openai", "/busy") == "one" and len(asked) == 2 and asked[1][1]["Authorization"] == "Bearer key"
    assert [ask("deepseek", "/chat", system="be brief"), ask("openrouter", "/chat"), ask("anthropic", "/messages"), ask("gemini", "/{model}:generate", model="m"), ask("ollama", "/local")] == ["one", "one", "two", "three", "four"]
    assert asked[2][2]["messages"][0] == {"role": "system", "content": "be brief"} and asked[4][1]["X-Api-Key"] == "key"
    with pytest.raises(OSError):
        ask("openai", "/bad")
    assert len(asked) == 8
    providers.connect("ollama", url=url + "/local")
    assert models.provider("ollama")()("hello") == "four" and "ollama-small" in models.PROVIDERS


def test_answers(spark):
    unit = {"unit_type": "Best-Practices", "title": "ask_first", "content": "Ask before you sell anything", "confidence": "0.9", "tags": ["Social Media", "x" * 31, "a"]}
    answers = [json.dumps({"units": [unit]}), f"Here:\n```json\n{json.dumps([unit])}\n```\nDone", str({"units": [unit]}), json.dumps(unit | {"type": "rule"}), json.dumps([{"type": "rule", "content": "Ask before you sell anything", "tags": "Sales, b c"}]), "none", "", None, "[1, 2]"]
    rows = spark.createDataFrame(list(enumerate(answers)), "chunk_id int, response string")
    got = {r["chunk_id"]: r for r in knowledge.coerced(rows).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert all((got[i]["unit_type"], got[i]["title"], got[i]["confidence"], got[i]["tags"]) == ("best_practice", "Ask First", 0.9, ["social-media", "a"]) for i in range(4))
    assert (got[4]["unit_type"], got[4]["tags"], got[4]["confidence"]) == ("rule", ["sales", "b", "c"], 0.8)
    assert knowledge.coerced(rows, ("rule",)).count() == 1


def test_small_model_is_asked_where_the_other_fails(spark):
    def failing():
        def ask(prompt):
            raise OSError

        return ask

    chunks = spark.createDataFrame([("c1", "text")], "chunk_id string, text string")
    unit = '{"units": [{"unit_type": "rule", "title": "t", "content": "Ask before you sell anything"}]}'
    assert models.extracted(chunks, "chunk_id", failing, small=lambda: lambda prompt: unit, tries=1, wait=0.0).first()["unit_type"] == "rule"


def test_first_rows(spark):
    rows = spark.createDataFrame([(f"k{k:03d}", o) for k in range(60) for o in range(k % 5 + 1)], "k string, o int")
    want = sorted((r["k"], r["o"]) for r in rows.collect())
    for most in (0, 1, 37, 100, 10_000):
        assert sorted((r["k"], r["o"]) for r in models.first_rows(rows, "k", "o", most).collect()) == want[:most]


def test_names_and_reviews(spark):
    names = ["a", "a", "a-2", "a-2-2", "a", "b", "a-2", "b-7", "b-7"]
    rows = spark.createDataFrame([(i, n, "p") for i, n in enumerate(names)] + [(100, "a", "q")], "no int, name string, part string")
    got = {r["no"]: r["name"] for r in skills.unique_names(rows, "no", "part").collect()}
    assert [got[i] for i in range(9)] == ["a", "a-2", "a-2-2", "a-2-2-2", "a-3", "b", "a-2-3", "b-7", "b-7-2"] and got[100] == "a"
    blank = spark.createDataFrame([(" ", "d" * 60, ["x"], [], [], [], ["t"], "sales")], "name string, description string, best_practices array<string>, pitfalls array<string>, workflow array<string>, examples array<string>, tags array<string>, category string")
    r = skills.reviewed(blank).first()
    assert (r["score"], r["status"], r["review_feedback"], r["review_notes"]) == (0, "rejected", "Skill name is empty; cannot be approved.", ["name is empty"])


def test_fixed_words():
    assert len(V.CONTENT_STOPWORDS) == 86 == len(set(V.CONTENT_STOPWORDS)) and "nothing" not in V.CONTENT_STOPWORDS
    assert {"about", "must", "these"}.isdisjoint(V.CONTENT_STOPWORDS) and {"about", "must", "these"} <= set(V.STOPWORDS)


def test_search_counts_every_item(spark):
    schema = "id string, name string, description string, category string, source_book string, review_feedback string, tags array<string>, best_practices array<string>, pitfalls array<string>, checklist array<string>, references array<string>, workflow array<struct<title:string,description:string>>, examples array<struct<title:string,code:string>>"
    rows = spark.createDataFrame([("1", "audience-research", "how to research", "", None, None, ["research"], ["research", "other"], [], [], [], [("x", "research")], [("x", "y")]), ("2", "x", "research", None, "", "", None, None, None, None, None, None, None)], schema)
    fields, lists = skills.searched()
    got = {r["id"]: r["score"] for r in search.keyword(rows, "Research", fields, F.col("name"), "id", 10, lists).collect()}
    assert got == {"1": 5 + 2, "2": 1}


def test_vectors_are_ordered_before_rounding(spark):
    rows = spark.createDataFrame([("a", [1.0, 1e-4]), ("b", [1.0, 1e-5]), ("c", [1.0, 0.0, 0.0])], "id string, v array<double>")
    assert [r["id"] for r in search.vectors(rows, [1.0, 0.0], "id", "v").collect()] == ["b", "a"]


def test_reports(spark, tmp_path, capsys):
    metrics = report.Metrics()
    with metrics.stage("one") as record:
        record.items = 3
    with pytest.raises(KeyError), metrics.stage("one"):
        raise KeyError("x")
    total = report.summary(metrics.table(spark)).first()
    assert (total["items"], total["errors"], total["success"]) == (3, 1, False)
    flow = report.workflow("s t", "f", incremental=False)
    assert [n["name"] for n in flow["nodes"]] == ["Start", "Run", "Ended well", "Succeeded", "Failed", "End"] and "'s t' run f --full" in flow["nodes"][1]["parameters"]["command"]
    assert all(t["node"] in {n["name"] for n in flow["nodes"]} for c in flow["connections"].values() for links in c["main"] for t in links)
    assert report.bar(1, 4, 8) == "[##......] 1/4"
    line = report.log("quillon.test", "t1", book="b")
    line.info("made %s", 3)
    assert json.loads(capsys.readouterr().err.splitlines()[-1]) | {"time": 0} == {"time": 0, "level": "INFO", "logger": "quillon.test", "message": "made 3", "trace_id": "t1", "book": "b"}
    main(["--store", f"{tmp_path}/s", "workflow", "books", f"{tmp_path}/w/flow.json"], spark)
    assert texts.read_json(f"{tmp_path}/w/flow.json")["name"] == "Run quillon"
    texts.write_yaml(f"{tmp_path}/y.yaml", {"a": [1, {"b": "x: y"}], "c": {}, "d": "ü"})
    assert texts.read_text(f"{tmp_path}/y.yaml") == '"a":\n  - 1\n  -\n    "b": "x: y"\n"c": {}\n"d": "ü"\n'


def test_cached_values_and_timeouts(spark, tmp_path):
    cache = store.Values(spark, f"{tmp_path}/v")
    assert [cache.get_or_compute("k", lambda: "x"), cache.get_or_compute("k", lambda: "y")] == ["x", "x"] and (cache.hits, cache.misses) == (1, 1)
    assert cache.invalidate("k") and not cache.invalidate("k")
    jobs = Jobs(spark, 1)
    key = jobs.submit(lambda: time.sleep(3), seconds=0.2)
    assert jobs.finish(20) and jobs.job(key).status == "failed" and "stopped after" in jobs.job(key).error
    with pytest.raises(ValueError):
        files.digest(F.lit("x"), "none")
