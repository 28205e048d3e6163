"""Limits on how long each job of a piece of work, and all of it, may run."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

Out = TypeVar("Out")


class JobTimeout(RuntimeError):
    """A job ran longer than allowed and was cancelled."""


def limited(spark: SparkSession, work: Callable[[], Out], seconds: float | None, what: str = "statement", *, deadline: float | None = None) -> Out:
    """work(), whose jobs are a group that is cancelled when one of them has run for ``seconds``, or when all of it has taken
    ``deadline`` seconds, however many jobs that is. Jobs that start after that are cancelled too."""
    if not seconds and not deadline:
        return work()
    sc, group = spark.sparkContext, f"twinlake-{uuid.uuid4().hex[:12]}"
    done, late, started = threading.Event(), [], time.monotonic()
    step = min(0.25, *(t / 4 for t in (seconds, deadline) if t))

    def watch() -> None:
        tracker, since = sc.statusTracker(), {}
        while not done.wait(step):
            now = time.monotonic()
            running = {j for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) and info.status == "RUNNING"}
            since = {j: since.get(j, now) for j in running}
            if not late and deadline and now - started >= deadline:
                late.append(f"cancelled after {deadline} s in all")
            if not late and seconds and any(now - t >= seconds for t in since.values()):
                late.append(f"cancelled after {seconds} s")
            if late:
                sc.cancelJobGroup(group)

    sc.setJobGroup(group, what, interruptOnCancel=True)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        return work()
    except Exception as e:
        if late:
            raise JobTimeout(late[0]) from e
        raise
    finally:
        done.set()
        watcher.join()
        sc.setLocalProperty("spark.jobGroup.id", None)
