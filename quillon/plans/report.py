"""What a run tells: records of its stages, log lines with a trace id, and the flow that starts it from outside."""

from __future__ import annotations

import json
import logging
import shlex
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class StageRecord:
    stage: str
    seconds: float = 0.0
    success: bool = True
    error: str | None = None
    items: int = 0
    tokens: int = 0
    restored: bool = False


_SCHEMA = "stage string, seconds double, success boolean, error string, items long, tokens long, restored boolean"


@dataclass
class Metrics:
    """Records of stages, and counters by name."""

    records: list[StageRecord] = field(default_factory=list)
    counters: dict[str, int] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str) -> Iterator[StageRecord]:
        record, begun = StageRecord(name), time.monotonic()
        self.records.append(record)
        try:
            yield record
        except Exception as problem:
            record.success, record.error = False, f"{type(problem).__name__}: {problem}"
            raise
        finally:
            record.seconds = time.monotonic() - begun

    def count(self, name: str, n: int = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + n

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(r).values()) for r in self.records], _SCHEMA)

    def reset(self) -> None:
        self.records.clear()
        self.counters.clear()


def summary(stages: DataFrame, by: str = "stage") -> DataFrame:
    """Totals of stage records ``(stage, seconds, success, error, items, tokens)``: by stage, or by any other column."""
    return stages.groupBy(by).agg(
        F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.round(F.sum("seconds"), 4).alias("seconds"), F.count_if(~F.col("success")).alias("errors"), F.bool_and("success").alias("success")
    )


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        told = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        return json.dumps(told | getattr(record, "bound", {}), ensure_ascii=False, default=str)


def log(name: str = "quillon", trace: str | None = None, **bound: object) -> logging.LoggerAdapter:
    """A logger whose lines are JSON and carry a trace id and whatever else is bound to it."""
    logger = logging.getLogger(name)
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(_Json())
        logger.addHandler(handler)
        logger.setLevel(logging.INFO)
        logger.propagate = False
    return logging.LoggerAdapter(logger, {"bound": {"trace_id": trace or uuid.uuid4().hex, **bound}})


def bar(done: int, total: int, width: int = 30) -> str:
    """A line of progress."""
    share = done / total if total else 1.0
    full = round(width * share)
    return f"[{'#' * full}{'.' * (width - full)}] {done}/{total}"


def command(store: str, folder: str, incremental: bool = True, provider: str = "") -> str:
    """The shell command of a run."""
    parts = ["python", "-m", "quillon", "--store", store, "run", folder, *([] if incremental else ["--full"]), *(["--provider", provider] if provider else [])]
    return shlex.join(parts)


def workflow(store: str, folder: str, path: str = "run-quillon", **run: object) -> dict:
    """An n8n workflow: a webhook runs the command, and the exit code decides between two replies."""
    def node(name: str, kind: str, column: int, row: int, **parameters: object) -> dict:
        return {"id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{path}/{name}")), "name": name, "type": f"n8n-nodes-base.{kind}", "typeVersion": 1, "position": [240 * column, 200 * row], "parameters": parameters}

    told = lambda status: {"values": {"string": [{"name": "status", "value": status}, {"name": "output", "value": "={{ $json.stdout }}{{ $json.stderr }}"}]}}
    nodes = [
        node("Start", "webhook", 0, 1, httpMethod="POST", path=path, responseMode="lastNode"),
        node("Run", "executeCommand", 1, 1, command=command(store, folder, **run), executeOnce=True) | {"continueOnFail": True},
        node("Ended well", "if", 2, 1, conditions={"number": [{"value1": "={{ $json.exitCode }}", "operation": "equal", "value2": 0}]}),
        node("Succeeded", "set", 3, 0, **told("success")), node("Failed", "set", 3, 2, **told("error")), node("End", "noOp", 4, 1),
    ]
    to = lambda *names: [{"node": n, "type": "main", "index": 0} for n in names]
    links = {"Start": [to("Run")], "Run": [to("Ended well")], "Ended well": [to("Succeeded"), to("Failed")], "Succeeded": [to("End")], "Failed": [to("End")]}
    return {"name": "Run quillon", "nodes": nodes, "connections": {k: {"main": v} for k, v in links.items()}, "active": False, "settings": {"executionTimeout": 600}}
