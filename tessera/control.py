"""Progress of a run, and a handle that stops it."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

#: A bar, none, or a function of (done, total or None).
Progress = bool | Callable[[int, int | None], None]


class StopHandle:
    """Given to a run, ``stop`` ends it from another thread: no further request is sent, running Spark jobs of the run are cancelled."""

    def __init__(self, spark: SparkSession | None = None):
        self.tag, self._asked, self._spark = f"tessera-{uuid.uuid4().hex}", threading.Event(), spark

    @property
    def stopped(self) -> bool:
        return self._asked.is_set()

    def stop(self) -> None:
        self._asked.set()
        (self._spark or SparkSession.active()).sparkContext.cancelJobsWithTag(self.tag)


@contextlib.contextmanager
def tagged(spark: SparkSession, stop: StopHandle | None) -> Iterator[None]:
    """Jobs started inside belong to the handle."""
    if stop is None:
        yield
        return
    spark.sparkContext.addJobTag(stop.tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(stop.tag)


@contextlib.contextmanager
def ticking(progress: Progress, total: int | None, label: str) -> Iterator[Callable[[int], None]]:
    """A function that takes how many more are done. A bar needs tqdm and is left out without it."""
    done, bar = 0, None
    if progress is True:
        with contextlib.suppress(ImportError):
            from tqdm.auto import tqdm

            bar = tqdm(total=total, desc=label)

    def tick(n: int) -> None:
        nonlocal done
        done += n
        if bar is not None:
            bar.update(n)
        elif callable(progress):
            progress(done, total)

    try:
        yield tick
    finally:
        if bar is not None:
            bar.close()
