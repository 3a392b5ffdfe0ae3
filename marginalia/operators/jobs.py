"""Long jobs that run once at a time, tell how far they are, can be cancelled from anywhere, and go on where they stopped."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .storage import names_in, put_new, text_of


class Busy(Exception):
    """Another run of the job holds its lease."""


class Cancelled(Exception):
    """The job was asked to stop."""


@dataclass(frozen=True)
class Progress:
    name: str
    done: int
    of: int
    seconds: float


class Job:
    """One run of the job ``name``, whose state is in small files below ``folder``.

    ``with Job(...) as job`` takes the lease, or raises :class:`Busy`. A lease lasts ``seconds`` after its holder was
    heard of last, so that of a driver that died is taken over. :meth:`report` tells the progress, renews the lease, and raises
    :class:`Cancelled` once :meth:`cancel` was called, in whatever process. Spark's jobs of the run bear its tag; a
    cancel in the same application ends those as well.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str, seconds: float = 600, listener: Callable[[Progress], None] | None = None) -> None:
        self.spark, self.name, self.seconds, self.listener = spark, name, seconds, listener
        self.folder = f"{folder.rstrip('/')}/jobs/{name.encode().hex()}"
        self.number, self.tag = -1, f"marginalia-job-{name.encode().hex()}"

    def _files(self) -> list[tuple[int, str]]:
        """Number of the run and kind of each file: ``lease-<k>``, ``cancel``, ``over``."""
        parts = (x.split(".", 1) for x in names_in(self.spark, self.folder) if not x.startswith("."))
        return sorted((int(n), kind) for n, kind in parts)

    def running(self) -> int | None:
        """The number of the run that holds the lease."""
        files = self._files()
        if not files:
            return None
        last = files[-1][0]
        kinds = [kind for n, kind in files if n == last]
        if "over" in kinds:
            return None
        beat = max(int(kind.partition("-")[2]) for kind in kinds if kind.startswith("lease-"))
        until = json.loads(text_of(self.spark, f"{self.folder}/{last}.lease-{beat}"))["until"]
        return last if until > time.time() else None

    def progress(self) -> Progress | None:
        """What the last run told last, in whatever process it runs."""
        beats = [(n, int(kind.partition("-")[2])) for n, kind in self._files() if kind.startswith("lease-")]
        if not beats:
            return None
        n, beat = max(beats)
        raw = json.loads(text_of(self.spark, f"{self.folder}/{n}.lease-{beat}"))
        return Progress(self.name, raw["done"], raw["of"], raw["seconds"])

    def cancel(self) -> bool:
        """Ask the run that holds the lease to stop; False if there is none."""
        at = self.running()
        if at is None:
            return False
        put_new(self.spark, f"{self.folder}/{at}.cancel", "")
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
        return True

    def _lease(self, done: int, of: int) -> bool:
        raw = {"until": time.time() + self.seconds, "done": done, "of": of, "seconds": time.time() - self.began}
        return put_new(self.spark, f"{self.folder}/{self.number}.lease-{self.beat}", json.dumps(raw))

    def __enter__(self) -> Job:
        if self.running() is not None:
            raise Busy(self.name)
        files = self._files()
        self.number, self.beat, self.began = (files[-1][0] + 1 if files else 0), 0, time.time()
        # of two that start at once one writes the first file of this number
        if not self._lease(0, 0):
            raise Busy(self.name)
        self.spark.sparkContext.addJobTag(self.tag)
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.spark.sparkContext.removeJobTag(self.tag)
        put_new(self.spark, f"{self.folder}/{self.number}.over", "")
        if kind is not None and not issubclass(kind, Cancelled) and self.stopped():
            raise Cancelled(self.name) from error

    def stopped(self) -> bool:
        return (self.number, "cancel") in self._files()

    def report(self, done: int, of: int) -> None:
        """Tell that ``done`` of ``of`` steps are done."""
        self.beat += 1
        if not self._lease(done, of) or self._files()[-1][0] != self.number:
            raise Busy(f"{self.name}: the lease went to another run")
        if self.listener:
            self.listener(Progress(self.name, done, of, time.time() - self.began))
        if self.stopped():
            raise Cancelled(self.name)
