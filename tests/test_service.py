"""Jobs, the HTTP interface and files read twice."""

import json
import threading
import urllib.error
import urllib.request

from quillon.plans.engine import Engine
from quillon.plans.jobs import Jobs
from quillon.plans.service import Api, server
from quillon.sources import files


def test_jobs(spark):
    jobs, order, gate = Jobs(spark, 1), [], threading.Event()
    jobs.submit(gate.wait)
    late = jobs.submit(lambda: order.append("late"), 9)
    soon = jobs.submit(lambda: order.append("soon") or spark.range(5).count(), 1)
    bad = jobs.submit(lambda: 1 / 0)
    gone = jobs.submit(lambda: order.append("gone"))
    assert jobs.cancel(gone)
    gate.set()
    assert jobs.finish(60) and order == ["soon", "late"]
    assert (jobs.job(soon).result, jobs.job(late).status, jobs.job(gone).status) == (5, "completed", "cancelled")
    assert jobs.job(bad).status == "failed" and "ZeroDivisionError" in jobs.job(bad).error and not jobs.cancel(bad)
    assert jobs.counts() == {"completed": 3, "failed": 1, "cancelled": 1}


def test_service(spark, tmp_path):
    folder = tmp_path / "books"
    folder.mkdir()
    api = Api(Engine(spark, f"{tmp_path}/store"), str(folder))
    web = server(api, 0)
    threading.Thread(target=web.serve_forever, daemon=True).start()

    def call(method, path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{web.server_port}{path}", body, method=method)
        try:
            with urllib.request.urlopen(request, timeout=120) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as problem:
            return problem.code, json.load(problem)

    try:
        assert call("GET", "/health") == (200, {"status": "ok"})
        text = "Best Practice: Research the demographics of the sales audience before every campaign"
        assert call("POST", "/books/a.txt", text.encode())[0] == 200
        assert call("POST", "/books/a.exe", b"x")[0] == 400 and call("POST", "/books/..%2Fa.txt", b"x")[0] == 400
        run = call("POST", "/runs", b"")[1]["id"]
        assert api.jobs.finish(240)
        assert call("GET", f"/runs/{run}")[1] == {"id": run, "status": "completed", "skills": 1, "error": None}
        (skill,) = call("GET", "/skills?limit=5")[1]
        assert call("GET", f"/skills/{skill['id']}")[1]["name"] == skill["name"]
        assert call("GET", "/search?q=demographics")[1][0]["id"] == skill["id"]
        assert call("GET", "/stats")[1]["by_category"] == {skill["category"]: 1}
        assert call("GET", "/books")[1][0]["file_name"] == "a.txt"
        assert call("GET", "/skills?limit=x")[0] == 400 and call("GET", "/nothing")[0] == 404 and call("GET", "/runs/0")[0] == 404
        assert call("DELETE", f"/skills/{skill['id']}")[0] == 200 and call("DELETE", f"/skills/{skill['id']}")[0] == 404
    finally:
        web.shutdown()
        web.server_close()


def test_hybrid(spark, tmp_path):
    (tmp_path / "full.txt").write_text("word " * 200)
    (tmp_path / "poor.txt").write_text("x")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = files.hybrid(files.books(spark, str(tmp_path)), lambda content: ["seen", " ", content.decode()]).collect()
    assert sorted((r["method"], r["page_no"], r["text"][:4]) for r in got) == [("direct", 1, "word"), ("hybrid", 1, "seen"), ("hybrid", 1, "seen"), ("hybrid", 3, "no z"), ("hybrid", 3, "x")]
