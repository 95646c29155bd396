"""Admission over a stream with a state of single entries, each with a time to live.

A ledger's tasks, calls and sums are entries of map states. An event reads and
writes the few it touches, so a micro-batch costs what it holds, whatever the
ledger has seen. Entries expire a while after they were last written: a call
when its reconciliation can't be expected any more, tasks and sums when their
month is over by far. So a ledger's state holds a few months of it and doesn't grow with the years.

An event that comes after its entry expired is judged as if the entry had never
been: a late reconciliation is ``unknown_call``. Needs the RocksDB state store.
Expiry needs no timers, so batches without data may be switched off
(``spark.sql.streaming.noDataMicroBatches.enabled``); a run of what is available ends only then.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sieveline.operators.ledger import EVENT, Replay
from sieveline.spec import BudgetSpec

DAY = 24 * 3600 * 1000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def packed(value: object) -> str:
    """A value of the ledger as text: dicts and lists of texts and decimals."""
    return json.dumps(value, default=lambda d: {"decimal": str(d)}, sort_keys=True)


def unpacked(text: str) -> Any:
    return json.loads(text, object_hook=lambda d: Decimal(d["decimal"]) if d.keys() == {"decimal"} else d)


class Entries(dict):
    """Entries of a map state, read when they are asked for and written back by ``flush`` if they have changed."""

    def __init__(self, state):
        super().__init__()
        self.state, self.stored = state, {}

    def __missing__(self, key):
        found = self.state.getValue((packed(key),)) if self.state.containsKey((packed(key),)) else None
        if found is None:
            raise KeyError(key)
        self.stored[key] = found[0]
        self[key] = value = unpacked(found[0])
        return value

    def __contains__(self, key) -> bool:
        return self.get(key) is not None

    def get(self, key, default=None):
        try:
            return self[key]
        except KeyError:
            return default

    def flush(self) -> None:
        for key, value in self.items():
            text = packed(value)
            if self.stored.get(key) != text:
                self.state.updateValue((packed(key),), (text,))


class Calls(Entries):
    """Calls; the keys of their sums are tuples again."""

    def __missing__(self, key):
        call = super().__missing__(key)
        call["keys"] = [tuple(k) for k in call["keys"]]
        return call


class Admission(StatefulProcessor):
    """Decides a ledger's events in the order of ``ord`` within a micro-batch."""

    def __init__(self, limits: BudgetSpec, call_ms: int, month_ms: int):
        self.limits, self.call_ms, self.month_ms = limits, call_ms, month_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = lambda name, ms: handle.getMapState(name, "key string", "value string", ms)
        self.tasks, self.months, self.sums = (kept(n, self.month_ms) for n in ("tasks", "months", "sums"))
        self.calls = kept("calls", self.call_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        replay = Replay(self.limits)
        replay.tasks, replay.month, replay.sums, replay.calls = Entries(self.tasks), Entries(self.months), Entries(self.sums), Calls(self.calls)
        frame = pd.concat(list(rows)).sort_values("ord")
        out = []
        for e in frame.astype(object).where(frame.notna(), None).to_dict("records"):
            e["input_tokens"], e["output_tokens"] = int(e["input_tokens"] or 0), int(e["output_tokens"] or 0)
            out.append(replay(e))
        for entries in (replay.tasks, replay.month, replay.sums, replay.calls):
            entries.flush()
        yield frame.assign(decision=out)

    def close(self) -> None:
        pass


def admissions(events: DataFrame, limits: BudgetSpec, *, call_days: float = 40, month_days: float = 100) -> DataFrame:
    """A stream of ``events`` (see EVENT) with ``decision``; calls are kept ``call_days`` after they were last written, the rest ``month_days``."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    processor = Admission(limits, max(1, int(call_days * DAY)), max(1, int(month_days * DAY)))
    return events.groupBy("ledger_id").transformWithStateInPandas(processor, EVENT + ", decision string", "Append", "ProcessingTime")
