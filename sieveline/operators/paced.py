"""Lookups that several tasks make at one common rate.

A service allows so many requests a second, whoever sends them. The tasks of a
barrier stage run together, so they can share that rate without talking: after
the barrier they count the same slots of time, and the slots are dealt to them in turn.
A retry waits as long as the service asks and then takes the next slot of its task, like any
request, so pauses never add up to a burst. A lookup that fails is a row that says so.

Should a task be lost, Spark runs the stage again and lookups, which only
read, are made again; the rows are written before they are returned, so later actions look nothing up.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.components import written

#: Longest pause before a retry, in seconds.
LONGEST = 5.0


class LookupFailed(RuntimeError):
    """An answer without a result; ``status`` 0: no answer came."""

    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after

    @property
    def may_pass(self) -> bool:
        return self.status in (0, 429) or self.status >= 500


class Slots:
    """The slots of one task: every ``tasks``-th of the common ones, ``interval`` seconds apart."""

    def __init__(self, task: int, tasks: int, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.step, self.clock, self.sleep = tasks * interval, clock, sleep
        self.next = clock() + task * interval

    def wait(self) -> None:
        """Sleep until the next slot that isn't over; slots missed meanwhile are lost."""
        now = self.clock()
        if self.next < now and self.step > 0:
            self.next += self.step * -(-(now - self.next) // self.step)
        if self.next > now:
            self.sleep(self.next - now)
        self.next += self.step


def pause(error: LookupFailed, attempt: int) -> float:
    return min(max(error.retry_after, 0.0), LONGEST) if error.retry_after is not None else min(0.5 * 2**attempt, LONGEST)


def looked_up(fetch: Callable[[str], str], key: str, slots: Slots, attempts: int) -> tuple[str | None, str | None]:
    """(answer, error) of one lookup."""
    for attempt in range(attempts):
        slots.wait()
        try:
            return fetch(key), None
        except LookupFailed as e:
            if attempt + 1 == attempts or not e.may_pass:
                return None, f"{type(e).__name__}: {e}"[:300]
            slots.sleep(pause(e, attempt))
        except Exception as e:  # noqa: BLE001 - a failed lookup is a row, not the end of the run
            return None, f"{type(e).__name__}: {e}"[:300]
    raise AssertionError


def lookups(keys: DataFrame, fetch: Callable[[str], str], *, tasks: int = 3, interval: float = 0.15, attempts: int = 3) -> DataFrame:
    """(key, answer, error) of every distinct, non-empty ``key``: one request every ``interval`` seconds over all ``tasks``."""
    wanted = keys.select(F.col("key").cast("string").alias("key")).where("key <> ''").distinct().repartition(tasks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get()
        context.barrier()
        slots = Slots(context.partitionId(), len(context.getTaskInfos()), interval)
        for frame in frames:
            got = [(k, *looked_up(fetch, k, slots, attempts)) for k in frame["key"]]
            yield pd.DataFrame(got, columns=["key", "answer", "error"])

    return written(wanted.mapInPandas(run, "key string, answer string, error string", barrier=True), "lookups")
