"""Scoring of model answers against cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import stripped


CASE = "case_id string, category string, instruction string, evidence array<map<string, string>>, required_citations array<string>, forbidden_patterns array<string>"


def load_cases(spark, path: str) -> DataFrame:
    """Cases from a JSON list that isn't empty; ``allowed`` are the ids of their evidence. A case without id, category or instruction is an error."""
    cases = spark.read.schema(CASE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if cases.isEmpty():
        raise ValueError("a suite is a JSON list of cases")
    whole = F.assert_true(F.col("case_id").isNotNull() & F.col("category").isNotNull() & F.col("instruction").isNotNull(), "a case lacks an id, a category or an instruction").isNull()
    none = F.array().cast("array<string>")
    ids = F.filter(F.transform("evidence", lambda e: F.try_element_at(e, F.lit("id"))), lambda i: i.isNotNull() & (i != ""))
    return cases.where(whole).select("case_id", "category", "instruction", "evidence", F.coalesce(ids, none).alias("allowed"), F.coalesce("required_citations", none).alias("required"), F.coalesce("forbidden_patterns", none).alias("forbidden"))


#: A word boundary of which only ASCII letters, digits and _ are words, as RE2 and DuckDB have it.
ASCII_BOUNDARY = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def ascii_boundaries(pattern: Column) -> Column:
    r"""``pattern`` with each ``\b`` outside escapes as an ASCII one; Java's follows Unicode letters or not by its version."""
    return F.regexp_replace(pattern, r"(?<!\\)((?:\\\\)*)\\b", "$1" + ASCII_BOUNDARY)


def score(citations: Column, text: Column, allowed: Column, required: Column, forbidden: Column) -> Column:
    """100 points: 35 no invalid citation, 25 required ones (10 off each missing), 25 nothing forbidden, 15 text and a list of citations."""
    some, said = F.coalesce(citations, F.array().cast("array<string>")), stripped(F.coalesce(text, F.lit("")))
    valid = F.when(F.size(F.array_except(some, allowed)) == 0, 35).otherwise(0)
    missing = F.greatest(F.lit(0), 25 - 10 * F.size(F.array_except(required, some)))
    clean = F.when(F.exists(forbidden, lambda p: F.rlike(said, F.concat(F.lit("(?iu)"), p))), 0).otherwise(25)
    form = F.when((said != "") & citations.isNotNull(), 15).otherwise(0)
    return valid + missing + clean + form


def summarize(results: DataFrame) -> DataFrame:
    """Per label: cases, mean score to 2 places, failed cases."""
    return results.groupBy("label").agg(F.count("*").alias("cases"), F.round(F.avg("score"), 2).alias("average"), F.count_if(F.col("failed")).alias("failed"))


def blinded(models: list[str], cases: DataFrame, seed: int) -> tuple[DataFrame, dict[str, str]]:
    """(label, case) of every model and case, labels in a seeded order, and the private map."""
    import random

    order = list(models)
    random.Random(seed).shuffle(order)
    labels = {f"candidate_{chr(65 + i)}": m for i, m in enumerate(order)}
    return cases.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels]))), labels
