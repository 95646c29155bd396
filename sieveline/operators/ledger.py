"""The spend ledger: aggregates, and admission by replay of events in order.

Admission feeds back: a refused request spends nothing, so running sums alone
can't decide. Events are replayed in order within one ledger, which is the
unit that the limits of a month bind together; ledgers are independent and
spread over tasks. Replays read ordered batches and keep tasks, calls and sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import group_id
from sieveline.spec import BudgetSpec

# Prices in CNY a million tokens.
PRICES = (
    ("deepseek-v4-flash", "deepseek", "3", "9"),
    ("deepseek-v4-pro", "deepseek", "12", "24"),
    ("kimi-k2.6", "kimi", "6.5", "27"),
    ("kimi-k3", "kimi", "24", "120"),
    ("doubao-seed-2.1-pro", "doubao", "6", "30"),
)
CENT = Decimal("0.0001")


def price_table(spark) -> DataFrame:
    rows = [(a, p, Decimal(i), Decimal(o)) for a, p, i, o in PRICES]
    return spark.createDataFrame(rows, "alias string, provider string, input_price decimal(10,4), output_price decimal(10,4)")


def month_used(tasks: DataFrame, calls: DataFrame) -> DataFrame:
    """Per month: what finished tasks have spent and what others have reserved."""
    actual = task_actual(calls)
    both = tasks.join(actual, "task_id", "left")
    used = F.when(F.col("status").isin("completed", "failed"), F.coalesce("actual_cny", F.lit(0).cast("decimal(18,4)"))).otherwise(F.col("reserved_cny"))
    return both.groupBy("month").agg(F.sum(used).cast("decimal(18,4)").alias("used_cny"), F.count("*").alias("n_tasks"))


def task_actual(calls: DataFrame) -> DataFrame:
    return calls.groupBy("task_id").agg(F.sum(F.coalesce("actual_cny", F.lit(0).cast("decimal(18,4)"))).cast("decimal(18,4)").alias("actual_cny"))


def consumption(tasks: DataFrame, calls: DataFrame) -> DataFrame:
    """Spent or estimated, by group, by group and provider, and by month and provider, in one pass."""
    joined = calls.join(tasks.select("task_id", "month"), "task_id").select(group_id(F.col("task_id")).alias("budget_group_id"), "month", "provider", F.coalesce("actual_cny", "estimated_cny").alias("cny"))
    g, p, m = F.col("budget_group_id"), F.col("provider"), F.col("month")
    return joined.groupingSets([[g], [g, p], [m, p]], g, p, m).agg(F.sum("cny").cast("decimal(18,4)").alias("cny"))


def reconciled(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Actual money of calls by outcome: unknown keeps the estimate, not_billed is 0, else tokens at their price."""
    from sieveline.functions.text import price

    met = calls.join(F.broadcast(prices.select("alias", "input_price", "output_price")), calls.model_alias == prices.alias, "left")  # five rows
    known = F.assert_true(F.col("input_price").isNotNull(), "a model has no price")
    actual = F.when(F.col("outcome") == "unknown", F.col("estimated_cny")).when(F.col("outcome") == "not_billed", F.lit(0).cast("decimal(18,4)")).otherwise(price(F.col("input_tokens"), F.col("output_tokens"), F.col("input_price"), F.col("output_price")))
    return met.where(known.isNull()).select(*calls.columns, actual.alias("actual_cny"))


def migrated(tasks: DataFrame, calls: DataFrame) -> DataFrame:
    """Older task rows: the group id is filled in, and failed reservations become failures with what was spent."""
    both = tasks.withColumn("budget_group_id", F.coalesce(F.nullif(F.col("budget_group_id"), F.lit("")), group_id(F.col("task_id")))) if "budget_group_id" in tasks.columns else tasks.withColumn("budget_group_id", group_id(F.col("task_id")))
    spent = task_actual(calls).withColumnRenamed("actual_cny", "__spent")
    old = F.col("status") == "failed_reserved"
    met = both.join(spent, "task_id", "left")
    return met.withColumn("actual_cny", F.when(old, F.coalesce("__spent", F.lit(0).cast("decimal(18,4)"))).otherwise(F.col("actual_cny"))).withColumn("status", F.when(old, "failed").otherwise(F.col("status"))).drop("__spent")


def rounded_up(x: Decimal) -> Decimal:
    return x.quantize(CENT, rounding=ROUND_UP)


ZERO = Decimal(0)
#: Outcomes of a call; the first two are billed by tokens.
OUTCOMES = ("completed", "failed_billed", "failed_unknown", "failed_not_billed")


class Replay:
    """The state of one ledger; each event is admitted or refused for the first reason that holds.

    Calls count with their estimate until they are reconciled, then with what
    they have cost; a task that has ended counts with the cost of its
    reconciled calls, before that with its reservation. Calls are kept as long as the ledger.
    """

    def __init__(self, limits: BudgetSpec):
        self.limits = limits
        self.tasks: dict[str, dict] = {}
        self.calls: dict[str, dict] = {}
        self.month: dict[str, Decimal] = {}
        self.sums: dict[tuple[str, ...], Decimal] = {}
        self.prices = {a: (p, Decimal(i), Decimal(o)) for a, p, i, o in PRICES}

    def over(self, amount: Decimal, limit: object) -> bool:
        return not self.limits.unlimited and amount > Decimal(str(limit))

    def cost(self, model: str, input_tokens: int, output_tokens: int) -> Decimal:
        _, i, o = self.prices[model]
        return rounded_up((input_tokens * i + output_tokens * o) / Decimal(1_000_000))

    def reserve(self, e: dict) -> str:
        if e["task_id"] in self.tasks:
            return "known"
        amount = Decimal(str(e["amount"] or self.limits.task_limit))
        used = self.month.get(e["month"], ZERO)
        if self.over(used + amount, self.limits.month_stop):
            return "month_stop"
        self.tasks[e["task_id"]] = {"month": e["month"], "reserved": amount, "counted": amount, "status": "reserved", "spent": ZERO}
        self.month[e["month"]] = used + amount
        return "reserved"

    def authorize(self, e: dict) -> str:
        if e["model_alias"] not in self.prices:
            return "unknown_price"
        provider = self.prices[e["model_alias"]][0]
        estimate = rounded_up(self.cost(e["model_alias"], e["input_tokens"], e["output_tokens"]) * Decimal("1.10"))
        if self.over(estimate, self.limits.call_limit):
            return "call_limit"
        task = self.tasks.get(e["task_id"])
        if task is None:
            return "unknown_task"
        if task["status"] not in ("reserved", "running"):
            return "inactive_task"
        group = e["task_id"].split(":gh-")[0] if ":gh-" in e["task_id"] else e["task_id"].split(":local-")[0]
        bound = ((("group", group), task["reserved"], "task_limit"), (("group", group, provider), self.limits.provider_task_limit(provider), "provider_task_limit"), (("month", task["month"], provider), self.limits.model_month_limit, "provider_month_limit"))
        for key, limit, reason in bound:
            if self.over(self.sums.get(key, ZERO) + estimate, limit):
                return reason
        for key, _, _ in bound:
            self.sums[key] = self.sums.get(key, ZERO) + estimate
        task["status"] = "running"
        self.calls[str(e["call_id"] if e["call_id"] is not None else e["ord"])] = {"task": e["task_id"], "keys": [k for k, _, _ in bound], "model": e["model_alias"], "estimate": estimate, "value": estimate, "actual": ZERO}
        return "authorized"

    def reconcile(self, e: dict) -> str:
        if e["outcome"] not in OUTCOMES:
            return "unknown_outcome"
        call = self.calls.get(str(e["call_id"]))
        if call is None:
            return "unknown_call"
        actual = {"failed_unknown": call["estimate"], "failed_not_billed": ZERO}.get(e["outcome"])
        if actual is None:
            actual = self.cost(call["model"], e["input_tokens"], e["output_tokens"])
        for key in call["keys"]:
            self.sums[key] += actual - call["value"]
        self.tasks[call["task"]]["spent"] += actual - call["actual"]
        call["value"] = call["actual"] = actual
        return e["outcome"]

    def finish(self, e: dict, status: str) -> str:
        task = self.tasks.get(e["task_id"])
        if task is None:
            return "unknown_task"
        self.month[task["month"]] += task["spent"] - task["counted"]
        task["status"], task["counted"] = status, task["spent"]
        return status

    def __call__(self, e: dict) -> str:
        kind = e["kind"]
        if kind in ("complete", "fail"):
            return self.finish(e, "completed" if kind == "complete" else "failed")
        return {"reserve": self.reserve, "call": self.authorize, "reconcile": self.reconcile}[kind](e)


EVENT = "ledger_id string, ord long, kind string, task_id string, month string, model_alias string, amount double, input_tokens long, output_tokens long, call_id string, outcome string"


def admissions(events: DataFrame, limits: BudgetSpec) -> DataFrame:
    """``events`` (see EVENT) with ``decision``, replayed by ``ord`` in each ledger.

    Kinds are reserve, call, reconcile, complete and fail; a call without a
    call_id is known by its ord.
    """
    names = [c.split()[0] for c in EVENT.split(", ")]
    rows = events.select(*[c if c in events.columns else F.lit(None).cast("string").alias(c) for c in names]).repartition("ledger_id").sortWithinPartitions("ledger_id", "ord")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for frame in frames:
            out = []
            for e in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                if state is None or e["ledger_id"] != current:
                    current, state = e["ledger_id"], Replay(limits)
                e["input_tokens"], e["output_tokens"] = int(e["input_tokens"] or 0), int(e["output_tokens"] or 0)
                out.append(state(e))
            yield frame.assign(decision=out)

    return rows.mapInPandas(run, EVENT + ", decision string")
