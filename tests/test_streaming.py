"""Streams against the batch operators."""

from __future__ import annotations

from sieveline.operators import ledger
from sieveline.spec import BudgetSpec
from sieveline.streaming import ledger_state, ledger_stream


def test_stream_admits_as_the_batch_does(spark, tmp_path):
    rows = [(f"L{k % 3}", k, "reserve" if k % 7 == 0 else "call", f"t{k % 2}", "2026-01", "kimi-k3", 20.0, 10_000 * (k % 5), 1000, None, None) for k in range(60)]
    for n, part in enumerate((rows[:30], rows[30:])):
        spark.createDataFrame(part, ledger.EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    want = {(r.ledger_id, r.ord): r.decision for r in ledger.admissions(spark.createDataFrame(rows, ledger.EVENT), BudgetSpec()).collect()}
    stream = spark.readStream.schema(ledger.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = ledger_stream.admissions(stream, BudgetSpec()).writeStream.format("memory").queryName("decided").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.ledger_id, r.ord): r.decision for r in spark.sql("SELECT * FROM decided").collect()} == want


def test_month_totals(spark, tmp_path):
    spark.sql("SELECT timestamp'2026-01-05 10:00:00' AS created_at, 'a' AS provider, cast(null AS decimal(18,4)) AS actual_cny, cast(2 AS decimal(18,4)) AS estimated_cny UNION ALL SELECT timestamp'2026-01-06 10:00:00', 'a', 1, 9").write.parquet(f"{tmp_path}/calls")
    stream = spark.readStream.schema("created_at timestamp, provider string, actual_cny decimal(18,4), estimated_cny decimal(18,4)").parquet(f"{tmp_path}/calls")
    q = ledger_stream.month_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", f"{tmp_path}/t").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.month, r.provider, float(r.cny), r.n) for r in spark.sql("SELECT * FROM totals").collect()] == [("2026-01", "a", 3.0, 2)]


def decided(spark, tmp_path, name, batches, **options):
    for n, part in enumerate(batches):
        spark.createDataFrame(part, ledger.EVENT).coalesce(1).write.parquet(f"{tmp_path}/{name}/in/{n}")
    stream = spark.readStream.schema(ledger.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}/in")
    q = ledger_state.admissions(stream, BudgetSpec(), **options).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}/state").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return {(r.ledger_id, r.ord): r.decision for r in spark.sql(f"SELECT * FROM {name}").collect()}


def test_entries_of_state_decide_as_the_batch_does(spark, tmp_path):
    """Calls, reconciliations and ends of three ledgers over two micro-batches; entries that expire are forgotten."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    kinds = ["reserve", "call", "call", "reconcile", "call", "reconcile", "complete"]
    rows = []
    for k in range(63):
        kind = kinds[k // 3 % 7]
        call = str(k - 6) if kind == "reconcile" else None
        rows.append((f"L{k % 3}", k, kind, f"t{k // 21}", "2026-01", "kimi-k3", 20.0, 10_000 * (k % 5), 1000, call, ("completed", "failed_not_billed")[k % 2] if kind == "reconcile" else None))
    want = {(r.ledger_id, r.ord): r.decision for r in ledger.admissions(spark.createDataFrame(rows, ledger.EVENT), BudgetSpec()).collect()}
    assert {"authorized", "completed", "failed_not_billed", "reserved"} <= set(want.values())
    assert decided(spark, tmp_path, "kept", [rows[:30], rows[30:]]) == want
    one = [("L", 0, "reserve", "t", "2026-01", None, 20.0, 0, 0, None, None), ("L", 1, "call", "t", "2026-01", "kimi-k3", None, 10, 10, "c", None)]
    late = [("L", 2, "reconcile", "t", "2026-01", None, None, 1, 1, "c", "completed")]
    assert decided(spark, tmp_path, "expired", [one, late], call_days=1e-9)[("L", 2)] == "unknown_call"
