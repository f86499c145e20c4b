"""Background jobs: a thread and a Spark job group each, with progress, cancelling and a commit point.

A job is cancelled by its group, so its Spark tasks end too, until it has passed its commit point; then it runs to its end.
"""

from __future__ import annotations

import itertools
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import SparkSession

KEEP_FINISHED = 64
LIST_LIMIT = 128


class Cancelled(Exception):
    """A job was told to stop."""


@dataclass
class Job:
    number: int
    title: str
    state: str = "queued"  # then running, then done, failed or cancelled
    progress: float = 0.0
    error: str | None = None
    result: object = None
    started: float = field(default_factory=time.time)
    _cancel: bool = False
    _committed: bool = False
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def check(self, progress: float | None = None) -> None:
        """Called by the work now and then; raises once the job is cancelled."""
        if progress is not None:
            self.progress = max(self.progress, min(1.0, progress))
        if self._cancel:
            raise Cancelled

    def commit(self) -> None:
        """From here on the job can't be cancelled."""
        with self._lock:
            self.check()
            self._committed = True


class Jobs:
    def __init__(self, spark: SparkSession):
        self.spark, self._numbers, self._all = spark, itertools.count(1), {}
        self._threads: dict[int, threading.Thread] = {}
        self._lock = threading.Lock()

    def start(self, title: str, work: Callable[[Job], object]) -> Job:
        job = Job(next(self._numbers), title)
        group = f"job-{id(self)}-{job.number}"

        def run() -> None:
            # a new thread has no active session, in which data sources are looked up
            getattr(self.spark._jvm, "org.apache.spark.sql.classic.SparkSession").setActiveSession(self.spark._jsparkSession)
            self.spark.sparkContext.setJobGroup(group, title, interruptOnCancel=True)
            job.state = "running"
            try:
                job.check()
                job.result = work(job)
                job.state, job.progress = "done", 1.0
            except Cancelled:
                job.state = "cancelled"
            except Exception as bad:  # whatever the work raises is the job's error
                job.state, job.error = ("cancelled", None) if job._cancel else ("failed", str(bad))
            self._forget_old()

        with self._lock:
            self._all[job.number] = (job, group)
            self._threads[job.number] = thread = InheritableThread(target=run, daemon=True)
        thread.start()
        return job

    def cancel(self, number: int) -> bool:
        """False if the job is over or past its commit point."""
        job, group = self._all[number]
        with job._lock:
            if job._committed or job.state not in ("queued", "running"):
                return False
            job._cancel = True
        self.spark.sparkContext.cancelJobGroup(group)
        return True

    def wait(self, number: int, seconds: float | None = None) -> Job:
        self._threads[number].join(seconds)
        return self._all[number][0]

    def list(self, limit: int = LIST_LIMIT) -> tuple[list[Job], bool]:
        """The newest first, and whether there are more."""
        found = sorted((j for j, _ in self._all.values()), key=lambda j: -j.number)
        return found[:limit], len(found) > limit

    def _forget_old(self) -> None:
        with self._lock:
            over = sorted(n for n, (j, _) in self._all.items() if j.state not in ("queued", "running"))
            for n in over[: max(0, len(over) - KEEP_FINISHED)]:
                del self._all[n], self._threads[n]
