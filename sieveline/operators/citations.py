"""Numbered citations in order of first appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import CITATION


def numbers(reviews: DataFrame) -> DataFrame:
    """(doc, citation_key, number): keys numbered from 1 by first appearance in their text."""
    keys = F.regexp_extract_all("markdown", F.lit(CITATION), F.lit(1))
    seen = reviews.select("doc", F.posexplode(keys).alias("at", "citation_key")).groupBy("doc", "citation_key").agg(F.min("at").alias("at"))
    return seen.select("doc", "citation_key", F.row_number().over(Window.partitionBy("doc").orderBy("at")).alias("number"))


def clusters(reviews: DataFrame) -> DataFrame:
    """(doc, at, numbers): each bracket's numbers, sorted, once each."""
    groups = F.regexp_extract_all("markdown", F.lit(r"\[(@[^\]]+)\]"), F.lit(1))
    one = reviews.select("doc", F.posexplode(groups).alias("at", "g")).select("doc", "at", F.explode(F.regexp_extract_all("g", F.lit(CITATION), F.lit(1))).alias("citation_key"))
    return one.join(numbers(reviews), ["doc", "citation_key"]).groupBy("doc", "at").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
