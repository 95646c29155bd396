"""Numbers of batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.operators import evidence


def test_batches_are_numbered_in_ranges_that_stay(spark):
    """the ranges that were counted weren't those that were numbered."""
    n = 120_000
    cards = spark.range(0, n, 1, 24).select(F.col("id").alias("ord"), F.concat(F.lit("k" * 40), F.col("id").cast("string")).alias("citation_key"), F.concat(F.lit("e" * 200), F.col("id").cast("string")).alias("evidence_id"))
    got = evidence.batches(cards)
    wrong = got.where(F.col("batch_number").isNull() | (F.col("batch_number") != F.floor(F.col("ord") / 8) + 1))
    assert wrong.count() == 0 and got.agg(F.max("batch_number")).first()[0] == n // 8
