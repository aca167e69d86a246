"""The engine over HTTP, with the standard library's server: JSON in and out.

GET /health, /skills[?category&status&tag&limit&offset], /skills/<id>, /search?q, /similar?q, /stats, /books, /runs/<id>;
POST /runs starts a run over the served folder, POST /books/<name> stores a file there; DELETE /skills/<id>.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import skills
from quillon.plans.engine import Engine
from quillon.plans.jobs import Jobs
from quillon.sources import files

#: Bytes of an uploaded file at most.
UPLOAD = 200_000_000


def rows(df: DataFrame) -> list[dict]:
    return [json.loads(x[0]) for x in df.select(F.to_json(F.struct("*"))).collect()]


class Refused(Exception):
    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status = status


class Api:
    """Answers by method and path, apart from any server."""

    def __init__(self, engine: Engine, folder: str):
        self.engine, self.folder, self.jobs = engine, folder, Jobs(engine.spark, 1)

    def answer(self, method: str, url: str, body: bytes = b"") -> object:
        parts = urlsplit(url)
        path = [unquote(p) for p in parts.path.strip("/").split("/")]
        q = {k: v[0] for k, v in parse_qs(parts.query).items()}
        action: Callable | None = getattr(self, f"{method.lower()}_{path[0]}{'_one' if len(path) == 2 else ''}", None)
        if action is None or len(path) > 2:
            raise Refused(404, "no such path")
        return action(path[1], q, body) if len(path) == 2 else action(q)

    @staticmethod
    def _number(q: dict, name: str, default: int) -> int:
        if not q.get(name, str(default)).isdigit():
            raise Refused(400, f"{name} is not a number")
        return int(q.get(name, default))

    def get_health(self, q: dict) -> dict:
        return {"status": "ok"}

    def get_skills(self, q: dict) -> list[dict]:
        tags = [q["tag"]] if "tag" in q else None
        return rows(self.engine.list_skills(q.get("category", ""), q.get("status", ""), tags, self._number(q, "limit", 50), self._number(q, "offset", 0)))

    def get_skills_one(self, key: str, q: dict, body: bytes) -> dict:
        found = rows(self.engine.skills.current().where(F.col("id") == key))
        if not found:
            raise Refused(404, "no such skill")
        return found[0]

    def delete_skills_one(self, key: str, q: dict, body: bytes) -> dict:
        if not self.engine.skills.delete(F.col("id") == key):
            raise Refused(404, "no such skill")
        return {"deleted": key}

    def get_search(self, q: dict) -> list[dict]:
        return rows(self.engine.search(q.get("q", ""), self._number(q, "limit", 10)))

    def get_similar(self, q: dict) -> list[dict]:
        return rows(self.engine.similar_to(q.get("q", ""), self._number(q, "limit", 5), q.get("type", "")))

    def get_stats(self, q: dict) -> dict:
        current = self.engine.skills.current()
        by = {c: {r["value"]: r["n"] for r in skills.histogram(current, c).collect()} for c in ("category", "status")}
        return rows(self.engine.stats())[0] | {f"by_{k}": v for k, v in by.items()}

    def get_books(self, q: dict) -> list[dict]:
        return rows(self.engine.list_books(self.folder))

    def post_books_one(self, name: str, q: dict, body: bytes) -> dict:
        if Path(name).name != name or name.rpartition(".")[2].lower() not in files.FORMATS:
            raise Refused(400, "unsupported file name")
        (Path(self.folder) / name).write_bytes(body)
        return {"file_name": name, "file_hash": hashlib.sha256(body).hexdigest()}

    def post_runs(self, q: dict) -> dict:
        return {"id": self.jobs.submit(lambda: self.engine.run(self.folder, q.get("full") != "1").count())}

    def get_runs_one(self, key: str, q: dict, body: bytes) -> dict:
        try:
            job = self.jobs.job(key)
        except KeyError:
            raise Refused(404, "no such run") from None
        return {"id": key, "status": job.status, "skills": job.result, "error": job.error}


def server(api: Api, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _any(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                if size > UPLOAD:
                    raise Refused(413, "too large")
                status, out = 200, api.answer(self.command, self.path, self.rfile.read(size))
            except Refused as problem:
                status, out = problem.status, {"error": str(problem)}
            except Exception as problem:  # noqa: BLE001  the server goes on
                status, out = 500, {"error": type(problem).__name__}
            data = json.dumps(out, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _any

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
