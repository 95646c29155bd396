"""The ledger as a stream: totals by month, and admission with kept state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.ledger import EVENT, Replay
from sieveline.spec import BudgetSpec


def month_totals(calls: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """Spent or estimated money by month and provider over a stream of calls (created_at, provider, actual_cny, estimated_cny)."""
    month = F.date_format("created_at", "yyyy-MM")
    return calls.withWatermark("created_at", delay).groupBy(month.alias("month"), "provider").agg(F.sum(F.coalesce("actual_cny", "estimated_cny")).alias("cny"), F.count("*").alias("n"))


def admissions(events: DataFrame, limits: BudgetSpec) -> DataFrame:
    """``events`` (see EVENT) with ``decision``; the state of a ledger lives as long as the ledger.

    Within a micro-batch a ledger's events are taken by ``ord``; batches are
    taken as they come.
    """

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        replay = pickle.loads(state.get[0]) if state.exists else Replay(limits)
        rows = pd.concat(list(frames)).sort_values("ord")
        out = []
        for e in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            e["input_tokens"], e["output_tokens"] = int(e["input_tokens"] or 0), int(e["output_tokens"] or 0)
            out.append(replay(e))
        state.update((pickle.dumps(replay),))
        yield rows.assign(decision=out)

    return events.groupBy("ledger_id").applyInPandasWithState(decide, EVENT + ", decision string", "replay binary", "append", "NoTimeout")
