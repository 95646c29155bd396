"""Inverted indexes of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import text as T


def test_index_of_rows(spark):
    """F8: the index was made of all words of all documents in two shuffles, by doc_id."""
    d = spark.createDataFrame([(1, "b a\n\nb  c"), (1, "x"), (2, ""), (3, None), (4, " \n")], "doc_id long, text string")
    index = T.inverted_index(d)
    assert index.where("index['b'] = array(0, 2)").count() == 1
    assert sorted(((r[0], r[1]) for r in index.select("doc_id", T.decoded_index(F.col("index"))).collect()), key=str) == [(1, "b a b c"), (1, "x"), (2, ""), (3, None), (4, "")]
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
