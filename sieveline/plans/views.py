"""Bibliographic views of the driver's tables, in Spark and in DuckDB SQL.

The tables hold no papers, so each document stands for one: its first line is
the title, the rest the abstract; identifiers, years and licences follow from
doc_id by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers; ``ord`` is their order."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    head = F.substring_index("text", "\n", 1)
    n = F.col("doc_id")
    return d.select(
        n.alias("ord"),
        F.concat(F.lit("doc:"), n.cast("string")).alias("record_id"),
        head.alias("title"),
        F.expr("substring(text, length(substring_index(text, '\\n', 1)) + 2)").alias("abstract"),
        (1990 + n % 36).cast("int").alias("year"),
        F.lit(None).cast("string").alias("publication_date"),
        F.array(F.concat(F.lit("Author "), (n % 97).cast("string"))).alias("authors"),
        F.when(n % 5 != 0, F.concat(F.lit("Venue "), F.col("source"))).alias("venue"),
        F.element_at(F.array(*[F.lit(x) for x in ("journal-article", "book", "proceedings-article", "dissertation", "report", "book-chapter", None)]), (n % 7 + 1).cast("int")).alias("work_type"),
        F.when(n % 3 == 0, F.concat(F.lit("10.5555/D"), (F.floor(n / 6)).cast("string"))).alias("doi"),
        F.when(n % 4 == 1, (n % 1000 + 10_000).cast("string")).alias("pmid"),
        F.lit(None).cast("string").alias("pmcid"),
        F.lit(None).cast("string").alias("arxiv_id"),
        F.coalesce("n_chars", F.lit(0)).cast("long").alias("citation_count"),
        F.array("source").alias("source_names"),
        F.create_map(F.col("source"), n.cast("string")).alias("source_ids"),
        F.concat(F.lit("https://example.org/"), n.cast("string")).alias("landing_page_url"),
        F.when(n % 2 == 0, F.concat(F.lit("https://example.org/"), n.cast("string"), F.lit(".pdf"))).alias("open_access_pdf_url"),
        F.element_at(F.array(*[F.lit(x) for x in ("CC-BY 4.0", "https://creativecommons.org/licenses/by/4.0/", "MIT", None, "Public Domain")]), (n % 5 + 1).cast("int")).alias("open_access_license"),
        F.array("lang").alias("topics"),
        F.element_at(F.array(*[F.lit(x) for x in ("no_adverse_update_found", "unchecked", "updated", "retracted", "check_failed", "no_adverse_update_found", "withdrawn", "no_adverse_update_found", "identifier_unavailable", "expression_of_concern", "no_adverse_update_found")]), (n % 11 + 1).cast("int")).alias("publication_status"),
    )


PAPERS_SQL = r"""papers AS (
  SELECT n AS ord, 'doc:' || n AS record_id, split_part(text, chr(10), 1) AS title,
    substr(text, length(split_part(text, chr(10), 1)) + 2) AS abstract, (1990 + n % 36)::INT AS year,
    ['Author ' || (n % 97)] AS authors, CASE WHEN n % 5 <> 0 THEN 'Venue ' || source END AS venue,
    (['journal-article', 'book', 'proceedings-article', 'dissertation', 'report', 'book-chapter', NULL])[n % 7 + 1] AS work_type,
    CASE WHEN n % 3 = 0 THEN '10.5555/D' || (n // 6) END AS doi,
    CASE WHEN n % 4 = 1 THEN (n % 1000 + 10000)::VARCHAR END AS pmid,
    coalesce(n_chars, 0)::BIGINT AS citation_count, [source] AS source_names, source, lang,
    'https://example.org/' || n AS landing_page_url,
    CASE WHEN n % 2 = 0 THEN 'https://example.org/' || n || '.pdf' END AS open_access_pdf_url,
    (['CC-BY 4.0', 'https://creativecommons.org/licenses/by/4.0/', 'MIT', NULL, 'Public Domain'])[n % 5 + 1] AS open_access_license,
    (['no_adverse_update_found', 'unchecked', 'updated', 'retracted', 'check_failed', 'no_adverse_update_found', 'withdrawn', 'no_adverse_update_found', 'identifier_unavailable', 'expression_of_concern', 'no_adverse_update_found'])[n % 11 + 1] AS publication_status
  FROM (SELECT doc_id AS n, coalesce(text, '') AS text, lang, source, n_chars FROM documents))"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as evidence cards of the papers that they label."""
    labels = table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull())
    n = F.col("doc_id")
    return labels.select(
        n.alias("ord"),
        F.concat(F.lit("card_"), n.cast("string")).alias("evidence_id"),
        F.concat(F.lit("doc:"), n.cast("string")).alias("record_id"),
        F.when(n % 6 == 0, "bibliographic_metadata").when(n % 3 == 1, "fulltext").otherwise("abstract").alias("evidence_type"),
        (n % 3 == 1).alias("fulltext_verified"),
        F.concat(F.lit("claim "), n.cast("string")).alias("claim"),
        F.array(F.concat(F.lit("limit "), (n % 4).cast("string"))).alias("limitations"),
    )


CARDS_SQL = """cards AS (
  SELECT doc_id AS ord, 'card_' || doc_id AS evidence_id, 'doc:' || doc_id AS record_id,
    CASE WHEN doc_id % 6 = 0 THEN 'bibliographic_metadata' WHEN doc_id % 3 = 1 THEN 'fulltext' ELSE 'abstract' END AS evidence_type,
    doc_id % 3 = 1 AS fulltext_verified, 'claim ' || doc_id AS claim
  FROM labels WHERE doc_id IS NOT NULL)"""


def ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as model calls, and their users as tasks."""
    e = table(spark, sf_dir, "events")
    # One task a user; its month is that of its first event.
    tasks = e.groupBy("user_id").agg(F.min("ts").alias("created_at")).select(
        F.concat(F.lit("task-"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, F.lit(":gh-1-1")).otherwise(F.lit(":local-1"))).alias("task_id"),
        F.col("user_id"), F.date_format("created_at", "yyyy-MM").alias("month"), "created_at",
        F.lit(35).cast("decimal(18,4)").alias("reserved_cny"),
        F.when(F.col("user_id") % 3 == 0, "running").when(F.col("user_id") % 3 == 1, "completed").otherwise("failed").alias("status"),
    )
    calls = e.select(
        "event_id", F.col("user_id"), F.col("event_type").alias("provider"), F.col("ts").alias("created_at"),
        F.abs("value").cast("decimal(18,4)").alias("estimated_cny"),
        F.when(F.col("event_id") % 3 != 0, (F.abs("value") * 0.5).cast("decimal(18,4)")).alias("actual_cny"),
    ).join(tasks.select("user_id", "task_id"), "user_id")
    return tasks, calls


LEDGER_SQL = """tasks AS (
  SELECT 'task-' || user_id || CASE WHEN user_id % 2 = 0 THEN ':gh-1-1' ELSE ':local-1' END AS task_id, user_id,
    strftime(min(ts), '%Y-%m') AS month, min(ts) AS created_at, 35::DECIMAL(18,4) AS reserved_cny,
    CASE WHEN user_id % 3 = 0 THEN 'running' WHEN user_id % 3 = 1 THEN 'completed' ELSE 'failed' END AS status
  FROM events GROUP BY user_id),
calls AS (
  SELECT event_id, user_id, task_id, event_type AS provider, ts AS created_at, abs(value)::DECIMAL(18,4) AS estimated_cny,
    CASE WHEN event_id % 3 <> 0 THEN (abs(value) * 0.5)::DECIMAL(18,4) END AS actual_cny
  FROM events JOIN tasks USING (user_id))"""
