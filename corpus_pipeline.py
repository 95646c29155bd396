"""The corpus pipeline: five stages over documents, each written and read again.

1. Documents that the quality classifier rejects go.
2. Later repeats of passages of 50 words or more are deleted line by line; a
   document of which nothing is left goes.
3. Of each group of documents linked by Jaccard similarity of word shingles,
   the one with the least doc_id stays.
4. Documents with a window of a benchmark item go.
5. The rest is packed into sequences.

Null and empty texts pass stages 2 to 4 and go only where the classifier rejects
them. Rows without a doc_id are never taken for copies, but stages 1 and 4 judge
them by their text like any other. Rows of equal doc_id are told apart by their texts; rows of
equal doc_id and text are one document and go or stay together. All columns of the input
stay through stage 4, whatever their names, ``n_chars`` with the new length where a text changed.
Empty tables pass through; without labels nothing is rejected, without
benchmark items nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm.common import written
from sieveline.llm.decontaminate import without_leaks
from sieveline.llm.jaccard_join import one_of_each
from sieveline.llm.line_dedup import dedup_lines
from sieveline.llm.packing import pack
from sieveline.llm.quality_classifier import keep_good


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs, length="n_chars", drop_emptied=True)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Learned scores, sampled paths and tokenisation can't be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
