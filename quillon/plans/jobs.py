"""Jobs on one session by priority: each runs in a thread of its own pool of Spark's fair scheduler."""

from __future__ import annotations

import heapq
import itertools
import threading
import uuid
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession


@dataclass
class Job:
    work: Callable[[], Any]
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "pending"
    result: Any = None
    error: str | None = None
    seconds: float | None = None


class Jobs:
    """At most ``at_once`` jobs run; of those pending, the lowest priority number first, then the oldest.

    A running job's Spark work has the job's id as its tag, so cancelling it stops its stages.
    """

    def __init__(self, spark: SparkSession, at_once: int = 4):
        self.spark, self.at_once = spark, at_once
        self._lock, self._order, self._heap = threading.Lock(), itertools.count(), []
        self._jobs: dict[str, Job] = {}
        self._pool = ThreadPoolExecutor(at_once)
        self._running: set = set()

    def submit(self, work: Callable[[], Any], priority: int = 5, seconds: float | None = None) -> str:
        """Queue a job; one that runs longer than ``seconds`` is stopped and counts as failed."""
        job = Job(work, seconds=seconds)
        with self._lock:
            self._jobs[job.id] = job
            heapq.heappush(self._heap, (priority, next(self._order), job.id))
            self._running = {f for f in self._running if not f.done()} | {self._pool.submit(self._next)}
        return job.id

    def _next(self) -> None:
        with self._lock:
            while self._heap:
                job = self._jobs[heapq.heappop(self._heap)[2]]
                if job.status == "pending":
                    job.status = "running"
                    break
            else:
                return
        context = self.spark.sparkContext
        context.setLocalProperty("spark.scheduler.pool", job.id)
        self.spark.addTag(job.id)
        timer = threading.Timer(job.seconds, self._expire, (job,)) if job.seconds is not None else None
        if timer:
            timer.daemon = True
            timer.start()
        try:
            job.result = job.work()
            done = "completed"
        except Exception as problem:  # noqa: BLE001  a job's failure is its result
            job.error, done = job.error or f"{type(problem).__name__}: {problem}", "failed"
        finally:
            if timer:
                timer.cancel()
            self.spark.removeTag(job.id)
            context.setLocalProperty("spark.scheduler.pool", None)
        with self._lock:
            job.status = job.status if job.status in ("cancelled", "failed") else done

    def _expire(self, job: Job) -> None:
        with self._lock:
            if job.status != "running":
                return
            job.status, job.error = "failed", f"stopped after {job.seconds} s"
        self.spark.interruptTag(job.id)

    def job(self, key: str) -> Job:
        return self._jobs[key]

    def cancel(self, key: str) -> bool:
        """Whether the job was pending or running."""
        with self._lock:
            job = self._jobs[key]
            was = job.status
            if was in ("pending", "running"):
                job.status = "cancelled"
        if was == "running":
            self.spark.interruptTag(key)
        return was in ("pending", "running")

    def counts(self) -> dict[str, int]:
        with self._lock:
            return dict(Counter(j.status for j in self._jobs.values()))

    def finish(self, seconds: float | None = None) -> bool:
        """Wait for all jobs submitted so far; whether they ended in time."""
        with self._lock:
            open_ = set(self._running)
        return not wait(open_, seconds).not_done
