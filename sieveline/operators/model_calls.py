"""Model calls: what an answer holds, and requests sent under a ledger's limits.

Sending itself is injected: a function from a request to the answer's JSON
text. Answers are read with built-in expressions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import let, stripped
from sieveline.operators.components import shared_dir, written
from sieveline.operators.effects import EffectLog
from sieveline.operators.ledger import Replay
from sieveline.spec import BudgetSpec

USAGE = "usage: struct<prompt_tokens: long, completion_tokens: long, input_tokens: long, output_tokens: long>"
ANSWER = f"struct<status: string, choices: array<struct<finish_reason: string, message: struct<content: string>>>, output: array<struct<type: string, content: array<struct<type: string, text: string>>>>, {USAGE}>"


def extracted(style: Column, payload: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """content, input_tokens, output_tokens and error (null: none) of an answer's JSON text.

    ``style`` is chat_completions or responses; the tokens given count where the answer tells none.
    """
    told = lambda value, other: F.coalesce(F.nullif(value, F.lit(0).cast("long")), other.cast("long"))

    def read(p: Column) -> Column:
        choice, chat = F.get(p["choices"], 0), style == "chat_completions"
        early = choice["finish_reason"].isin("length", "content_filter")
        messages = F.filter(p["output"], lambda o: o["type"] == "message")
        blocks = F.filter(F.flatten(F.transform(messages, lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>")))), lambda b: (b["type"] == "output_text") & (stripped(b["text"]) != ""))
        said = F.nullif(F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"), F.lit(""))
        error = (
            F.when(p.isNull(), "answer is no JSON object")
            .when(chat & choice.isNull(), "no choice")
            .when(chat & early, F.concat(F.lit("stopped early: "), choice["finish_reason"]))
            .when(~chat & (F.coalesce(p["status"], F.lit("completed")) != "completed"), F.concat(F.lit("not complete: "), p["status"]))
            .when(~chat & said.isNull(), "no output text")
        )
        content = F.when(error.isNull(), F.when(chat, choice["message"]["content"]).otherwise(said))
        taken = F.when(chat, told(p["usage"]["prompt_tokens"], input_tokens)).otherwise(told(p["usage"]["input_tokens"], input_tokens))
        given = F.when(chat, told(p["usage"]["completion_tokens"], output_tokens)).otherwise(told(p["usage"]["output_tokens"], output_tokens))
        return F.struct(content.alias("content"), taken.alias("input_tokens"), given.alias("output_tokens"), error.alias("error"))

    return let(F.from_json(payload, ANSWER), read)


class NotBilled(RuntimeError):
    """A request that failed and costs nothing."""


REQUEST = "ledger_id string, ord long, task_id string, model_alias string, style string, prompt string, input_tokens long, output_tokens long"


def used(request: dict, answer: str) -> dict:
    """The outcome and tokens that an answer is reconciled with, as the expressions of ``extracted`` read it."""
    chat = request["style"] == "chat_completions"
    unknown = {"outcome": "failed_unknown", "input_tokens": request["input_tokens"], "output_tokens": request["output_tokens"]}
    try:
        got = json.loads(answer)
        if chat:
            good = bool(got["choices"]) and got["choices"][0].get("finish_reason") not in ("length", "content_filter")
        else:
            blocks = [b for o in got.get("output") or [] if o.get("type") == "message" for b in o.get("content") or []]
            good = (got.get("status") or "completed") == "completed" and any(b.get("type") == "output_text" and (b.get("text") or "").strip() for b in blocks)
        usage = got.get("usage") or {}
        taken, given = (usage.get(k) for k in (("prompt_tokens", "completion_tokens") if chat else ("input_tokens", "output_tokens")))
        return {"outcome": "completed", "input_tokens": int(taken or request["input_tokens"]), "output_tokens": int(given or request["output_tokens"])} if good else unknown
    except (ValueError, KeyError, TypeError, AttributeError, IndexError):
        return unknown


def sent(requests: DataFrame, send: Callable[[dict], str], limits: BudgetSpec, month: str, *, log: str | None = None, patience: float = 660) -> DataFrame:
    """``requests`` (see REQUEST) in the order of each ledger, with ``decision`` and ``answer`` or ``failure``.

    Each task is reserved at its first request. A refused request isn't sent.
    An answer counts with the tokens it tells before the next request is
    judged, a failure with its estimate, or nothing after NotBilled.

    A request, known by its ledger and ord, is sent once. This runs at the call
    and writes its rows, so actions on them send nothing. Within it, and in
    later calls with the same ``log`` (a folder; default: a new one in the
    shared folder), the effect log answers what was sent before: a task that
    runs again replays the decisions up to where it was lost. The request in flight then is a
    failure, Interrupted, and counts with its estimate.
    """
    names = [c.split()[0] for c in REQUEST.split(", ")]
    folder = log or f"{shared_dir(requests.sparkSession).rstrip('/')}/effects-{uuid.uuid4().hex}"
    EffectLog(folder)  # an address that can't hold a log is an error before anything is sent
    rows = requests.select(*names).repartition("ledger_id").sortWithinPartitions("ledger_id", "ord")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ledger, state = None, None
        effects = EffectLog(folder, patience=patience)

        def tried(r: dict) -> dict:
            try:
                return {"answer": send(r), "failure": None, "billed": True}
            except Exception as e:  # noqa: BLE001 - a failed request is a row, not the end of the run
                return {"answer": None, "failure": f"{type(e).__name__}: {str(e)[:240]}", "billed": not isinstance(e, NotBilled)}

        for frame in frames:
            out = []
            for r in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                if state is None or r["ledger_id"] != ledger:
                    ledger, state = r["ledger_id"], Replay(limits)
                event = {"month": month, "amount": None, "call_id": str(r["ord"]), "outcome": None, **r}
                decision, got = state.reserve(event), {"answer": None, "failure": None}
                if decision in ("reserved", "known"):
                    decision = state.authorize(event)
                if decision == "authorized":
                    got = effects.once(f"{r['ledger_id']}\0{r['ord']}", lambda r=r: tried(r), {"answer": None, "failure": "Interrupted: sent by a task that was lost", "billed": True})
                    failed = {"outcome": "failed_unknown" if got["billed"] else "failed_not_billed"}
                    state.reconcile(event | (used(r, got["answer"]) if got["failure"] is None else failed))
                out.append({**r, "decision": decision, "answer": got["answer"], "failure": got["failure"]})
            yield pd.DataFrame(out, columns=[*names, "decision", "answer", "failure"])

    return written(rows.mapInPandas(run, REQUEST + ", decision string, answer string, failure string"), "sent")


def settled(answers: DataFrame) -> DataFrame:
    """Rows of ``sent`` with the content or error of their answer, and the outcome and tokens to reconcile each call with."""
    read = answers.withColumn("__got", extracted(F.col("style"), F.col("answer"), F.col("input_tokens"), F.col("output_tokens")))
    failed = F.col("failure").isNotNull() | F.col("__got.error").isNotNull()
    outcome = F.when(F.col("decision") == "authorized", F.when(F.startswith(F.col("failure"), F.lit("NotBilled")), "failed_not_billed").when(failed, "failed_unknown").otherwise("completed"))
    return read.select("ledger_id", "ord", "task_id", "model_alias", "decision", F.col("__got.content").alias("content"), F.coalesce("failure", F.when(F.col("answer").isNotNull(), F.col("__got.error"))).alias("error"), outcome.alias("outcome"), F.col("__got.input_tokens").alias("used_input"), F.col("__got.output_tokens").alias("used_output"))
