"""Shards of the source divergence audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.llm import source_divergence as sd


def test_shards_of_many_blocks(spark):
    """the block after the first one that was combined failed, as the count of the combined rows was left open."""
    counts = spark.range(0, 400, 1, 4).select(F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.concat(F.lit("t"), F.col("id") % 5).alias("term"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("docs"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = lambda **options: sorted(map(str, sd.kept_terms(counts, least_docs=1, **options).collect()))
        assert rows(block_rows=3) == rows() and len(rows()) == 15
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shards_grow_with_the_texts(spark):
    """a shard held its share of all terms, however many there were, until its database was full."""
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sd.shards(spark, 0, 10) == few and sd.shards(spark, 10_001, 10) == 1001
    texts = [("en", f"s{i % 3}", " ".join("abcdefghijklmnop"[(i * k) % 16] * (1 + k % 3) for k in range(40))) for i in range(90)]
    docs = spark.createDataFrame([*texts, ("en", "s0", None), (None, "x", "a")], "lang string, source string, text string")
    rows = lambda **options: sorted(map(tuple, sd.source_divergence(docs, least_docs=5, **options).collect()))
    seen = []
    real = sd.kept_terms
    sd.kept_terms = lambda counts, **options: seen.append(options["parts"]) or real(counts, **options)
    try:
        assert rows(shard_bytes=200, shard_rows=7) == rows()
    finally:
        sd.kept_terms = real
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert seen == [max(few, -(-size // 200)), few] and seen[0] > few
