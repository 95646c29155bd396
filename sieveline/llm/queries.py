"""The registered queries of this folder, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, filter_audit, jaccard_join, language_model, line_dedup, pii, quality_classifier, quality_rules, secret_scan, source_divergence, token_store
from .packing import pack, pack_answers
from .token_count import count_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


#: The Spark setting that holds the key of surrogates; a run that is to be kept apart from others sets its own.
KEY = "spark.sieveline.surrogateKey"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents"), key=spark.conf.get(KEY, "corpus-surrogates-1"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_corpus(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_documents(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of ``op10`` where only answers bear loss."""
    return pack_answers(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_count": op1_token_count,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_pii": op4_pii,
    "op5_line_dedup": op5_line_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_language_model": op7_language_model,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_packing": op10_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_ids": op12_token_ids,
    "op13_source_divergence": op13_source_divergence,
    "instruction_packing": instruction_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.REPORT_SQL,
    "op3_quality_rules": quality_rules.rules_sql(),
    "op11_filter_audit": filter_audit.AUDIT_SQL,
    "op13_source_divergence": source_divergence.DIVERGENCE_SQL,
}
