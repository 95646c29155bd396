"""Word boundaries of forbidden patterns."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from sieveline.operators import benchmarking


def test_word_boundaries_as_in_sql(spark):
    """Java's word boundary counts accented letters."""
    texts = ["a station", "stationé x", "stationary", "Nation-x", "ation_", "éb"]
    shown = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.rlike("t", F.concat(F.lit("(?iu)"), benchmarking.ascii_boundaries(F.lit("tion\\b"))))).collect()]
    assert shown == [duckdb.execute("SELECT regexp_matches(?, '(?i)tion\\b')", [t]).fetchone()[0] for t in texts] == [True, True, False, True, False, False]
    kept = spark.range(1).select(benchmarking.ascii_boundaries(F.lit("a\\\\b"))).first()[0]
    assert kept == "a\\\\b"
