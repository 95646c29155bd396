"""Writers of a run's results into its folder."""

from __future__ import annotations

import json
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import citation_key, csl_item, normal_doi
from sieveline.operators.benchmarking import summarize
from sieveline.operators.ledger import month_used
from sieveline.sources.one_file import write_one
from sieveline.spec import BudgetSpec, TaskSpec

PARTS = ("search", "evidence", "draft", "audit", "private_work")
# The columns of papers.csv.
CSV = ("rank", "citation_key", "title", "year", "authors", "venue", "doi", "pmid", "citation_count", "rank_score", "sources", "open_access_pdf_url", "publication_status", "quality_flags")


def prepare(path: str | Path) -> Path:
    base = Path(path)
    for p in PARTS:
        (base / p).mkdir(parents=True, exist_ok=True)
    return base


def csv_rows(ranked: DataFrame) -> DataFrame:
    """Rows of the paper list: lists joined, nulls empty. ``ranked`` has ``rank`` from 1 and ``source_names`` or ``sources``."""
    if "sources" not in ranked.columns:
        ranked = ranked.withColumnRenamed("source_names", "sources")
    if "citation_key" not in ranked.columns:
        ranked = ranked.withColumn("citation_key", citation_key(normal_doi(F.col("doi")), F.col("pmid"), F.col("arxiv_id"), F.col("title"), F.col("year")))
    kinds = dict(ranked.dtypes)
    show = lambda c: F.array_join(c, "; ") if kinds[c].startswith("array") else F.col(c).cast("string")
    return ranked.select(*[F.coalesce(show(c), F.lit("")).alias(c) for c in CSV])


def write_papers(ranked: DataFrame, path: str) -> None:
    """papers.json, one list, and papers.csv, by rank."""
    ordered = ranked.orderBy("rank")
    write_one(ordered, f"{path}/search/papers.json", "json")
    write_one(csv_rows(ordered), f"{path}/search/papers.csv", "csv")


def source_status(log: DataFrame) -> dict[str, dict]:
    """By source: status, records and the queries with theirs; ``log`` (source, query, status, error, records) has a row a query, in order."""
    found: dict[str, dict] = {}
    for r in log.collect():  # at most 4 sources and 20 queries, by the specification
        one = found.setdefault(r["source"], {"status": "failed", "queries": [], "records": 0})
        told = {"query": r["query"], "records": r["records"], "status": r["status"]}
        one["queries"].append(told | ({"error": r["error"]} if r["status"] == "failed" else {}))
        one["records"] += r["records"]
        if r["status"] == "ok":
            one["status"] = "ok"
    return found


def write_search_run(ranked: DataFrame, log: DataFrame, path: str, *, task_id: str, started_at: str, completed_at: str, queries: list[str], raw: int, deduplicated: int) -> None:
    """search_run.json: what was asked, what came, and the papers by rank."""
    run = {"task_id": task_id, "started_at": started_at, "completed_at": completed_at, "queries": queries, "source_status": source_status(log), "raw_record_count": raw, "deduplicated_record_count": deduplicated}
    write_one(ranked.orderBy("rank"), f"{path}/search/search_run.json", "json", within=json.dumps(run), key="papers")


def csl_references(papers: DataFrame) -> DataFrame:
    return papers.select(csl_item({c: F.col(c) for c in ("citation_key", "work_type", "title", "authors", "venue", "year", "doi", "landing_page_url")}).alias("value"))


def write_references(papers: DataFrame, path: str) -> None:
    """references.csl.json, one list by rank where there is one."""
    ordered = papers.orderBy("rank") if "rank" in papers.columns else papers
    write_one(csl_references(ordered), f"{path}/search/references.csl.json", "json_texts")


# The columns of evidence_matrix.csv.
MATRIX = ("evidence_id", "citation_key", "title", "year", "evidence_type", "study_design", "population", "claim", "result", "limitations", "locator", "confidence")


def evidence_matrix(cards: DataFrame, papers: DataFrame) -> DataFrame:
    """Cards with their paper's key, title and year, lists joined and nulls empty; a card of an unknown paper is an error."""
    known = papers.select("record_id", F.col("citation_key").alias("__key"), F.col("title").alias("__title"), F.col("year").alias("__year"))
    met = cards.drop("citation_key", "title", "year").join(known, "record_id", "left")
    met = met.where(F.assert_true(F.col("__key").isNotNull(), "a card has no paper").isNull())
    from_paper = {"citation_key": "__key", "title": "__title", "year": "__year"}
    kinds = dict(met.dtypes)

    def shown(c: str) -> Column:
        name = from_paper.get(c, c)
        if name not in kinds:
            return F.lit("").alias(c)
        value = F.array_join(name, "; ") if kinds[name].startswith("array") else F.col(name).cast("string")
        return F.coalesce(value, F.lit("")).alias(c)

    return met.select(*[shown(c) for c in MATRIX])


def write_evidence(cards: DataFrame, papers: DataFrame, path: str) -> None:
    """evidence_cards.json, one list, and evidence_matrix.csv, by evidence id."""
    write_one(cards.orderBy("evidence_id"), f"{path}/evidence/evidence_cards.json", "json")
    write_one(evidence_matrix(cards, papers).orderBy("evidence_id"), f"{path}/evidence/evidence_matrix.csv", "csv")


def content_hash(content: Column) -> Column:
    """SHA-256 of a file's bytes, in hexadecimal digits."""
    return F.sha2(content, 256)


def write_provenance(path: str | Path, spec: TaskSpec, queries: list[str], *, day: str, execution_id: str, model_calls: bool) -> None:
    """What a run was made with, for private audit."""
    value = {"task_id": spec.resolved_id(day), "execution_id": execution_id, "model_calls_enabled": model_calls, "models": asdict(spec.models) if model_calls else None, "query_count": len(queries), "private_audit_only": True, "included_in_default_submission_package": False}
    write_json(Path(path) / "private_work" / "private_provenance.json", value)


def month_export(tasks: DataFrame, calls: DataFrame, month: str, limits: BudgetSpec) -> dict:
    """A month's sums, limits and tasks in the order of their creation; ``tasks`` of one month are few."""
    used = month_used(tasks.where(F.col("month") == month), calls).first()
    mine = tasks.where(F.col("month") == month).orderBy("created_at", "task_id").collect()
    return {"month": month, "used_or_reserved": str(used["used_cny"] if used else 0), "limits": asdict(limits), "tasks": [{k: str(v) for k, v in r.asDict().items()} for r in mine]}


def search_report(ranked: DataFrame, contributions: DataFrame, *, top: int = 30) -> str:
    """A Markdown report: counts, sources and the first papers."""
    counts = ranked.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("abstract"), F.lit("")) != "").alias("abstracts"), F.count_if(F.col("open_access_pdf_url").isNotNull()).alias("open")).first()
    lines = ["# Search report", "", f"- papers: {counts['n']}", f"- with abstract: {counts['abstracts']}", f"- with open full text: {counts['open']}", "", "| source | records |", "|---|---|"]
    lines += [f"| {r['source']} | {r['records']} |" for r in contributions.orderBy("source").collect()]  # one row a source
    lines += ["", "| rank | score | year | title |", "|---|---|---|---|"]
    rows = ranked.orderBy("rank").limit(top).select("rank", "rank_score", "year", "title").collect()
    lines += [f"| {r['rank']} | {r['rank_score']:.3f} | {r['year'] or ''} | {r['title'].replace('|', chr(92) + '|')} |" for r in rows]
    return "\n".join(lines) + "\n"


# The lines of quality_report.md, and the entries of quality_report.json that they show.
REPORT_TITLE, FINDINGS_TITLE, NOTES_TITLE, NO_FINDINGS = "质量审计报告", "发现", "说明", "未发现阻断性自动检查问题。"
REPORT_LINES = (
    ("正常响应数据源", "operational_sources"), ("实际贡献记录的数据源", "contributing_sources"), ("原始记录", "raw_records"), ("去重后记录", "deduplicated_records"), ("保留记录", "retained_records"), ("证据卡片", "evidence_cards"),
    ("进入证据矩阵的文献", "evidence_papers"), ("仅用于历史定位的书目元数据文献", "bibliographic_metadata_papers"), ("全文核验文献", "fulltext_verified_papers"), ("明确许可支持的全文文献", "fulltext_license_verified_papers"),
    ("完成发表状态核查的证据文献", "publication_status_checked_papers"), ("发表状态分布", "publication_status_counts"), ("正文引用文献", "citations_used"), ("正文引用的实质性证据文献", "substantive_citations_used"), ("模型复核方式", "model_review_mode"), ("模型复核结论", "model_review_verdict"),
)
REPORT_NOTES = ("这是程序审计，不替代用户的学术判断、学校或期刊的正式审查，也不替代指定查重系统。", "本项目输出为普通叙述性文献综述，不声称采用系统综述方法或穷尽所有数据库。")


def quality_markdown(report: dict) -> str:
    """quality_report.md: the status, a line for each count (lists by their length), the findings."""
    shown = lambda v: len(v) if isinstance(v, list) else v
    lines = [f"# {REPORT_TITLE}", "", f"- 自动审计状态：**{report['status']}**", *[f"- {label}：{shown(report[key])}" for label, key in REPORT_LINES]]
    found = [f"- [{f['severity']}] `{f['code']}`：{f['message']}" for f in report["findings"]] or [f"- {NO_FINDINGS}"]
    return "\n".join([*lines, "", f"## {FINDINGS_TITLE}", "", *found, "", f"## {NOTES_TITLE}", "", *REPORT_NOTES]) + "\n"


def write_quality_report(report: dict, path: str | Path) -> None:
    """quality_report.json and .md of ``audit.quality_report``."""
    folder = Path(path) / "audit"
    folder.mkdir(parents=True, exist_ok=True)
    write_json(folder / "quality_report.json", report, sort_keys=False)
    (folder / "quality_report.md").write_text(quality_markdown(report), encoding="utf-8")


# Headings and labels of the sheet that people score on.
SHEET_HEAD = ("# 三模型盲测人工评分表", "", "请在不知道模型身份的情况下按每题 100 分评分：证据忠实度35、中文综合25、结构遵循15、长文本取证15、稳定性5、成本5。", "")
SHEET_TABLE = ("| 题目 | 类别 | 自动分 | 人工分 | 备注 |", "|---|---|---:|---:|---|")


def human_sheet(results: DataFrame) -> DataFrame:
    """Lines (label, block, place, line) of the sheet; ``results`` as ``write_benchmark`` has them.

    For each label a table of its cases, then each answer with the evidence it names.
    """
    said = F.coalesce(F.nullif(F.col("response.text"), F.lit("")), F.concat(F.lit("运行失败："), F.coalesce("error", F.lit("未知错误"))))
    cited = F.concat(F.lit("证据编号："), F.array_join(F.coalesce("response.citations", F.array().cast("array<string>")), "、"))
    row = F.format_string("| %s | %s | %d |  |  |", "case_id", "category", F.coalesce("score", F.lit(0)).cast("int"))
    heads = results.groupBy("label").agg(F.lit(-1).cast("long").alias("place"))
    lines = lambda df, block, *texts: df.select("label", F.lit(block).alias("block"), "place", F.posexplode(F.array(*texts)).alias("line", "value"))
    return (
        lines(heads, 0, F.concat(F.lit("## "), "label"), F.lit(""), *[F.lit(x) for x in SHEET_TABLE])
        .unionByName(lines(results, 1, row))
        .unionByName(lines(results, 2, F.lit(""), F.concat(F.lit("### "), "case_id", F.lit(" 回答")), F.lit(""), said, F.lit(""), cited, F.lit(""), F.lit("人工评分：____ / 100；备注：________________")))
        .unionByName(lines(heads, 3, F.lit("")))
    )


def write_benchmark(results: DataFrame, private_map: dict[str, str], path: str | Path) -> None:
    """blinded_results.json, score_summary.json, the sheet for people, and the private map of labels.

    ``results``: label, place, case_id, category, response (text, citations), error and score, a row for each label and case.
    """
    base = prepare(path)
    scored = F.struct(F.coalesce("score", F.lit(0)).alias("total"), F.col("error").isNotNull().alias("failed")).alias("automatic_score")
    # A suite is one file of cases, so those of a label are few.
    cases = F.array_sort(F.collect_list(F.struct("place", F.struct("case_id", "category", "response", "error", scored).alias("case"))))
    blind = results.groupBy(F.col("label").alias("key")).agg(F.to_json(F.transform(cases, lambda x: x["case"])).alias("value"))
    write_one(blind.orderBy("key"), f"{base}/blinded_results.json", "json_object")
    totals = summarize(results.withColumn("failed", F.col("error").isNotNull()).fillna(0, ["score"])).orderBy("label").collect()  # one row a model
    candidates = {r["label"]: {"cases": r["cases"], "automatic_average": r["average"], "failed_cases": r["failed"], "human_score_pending": True} for r in totals}
    write_json(base / "score_summary.json", {"candidates": candidates, "selection_status": "human_blind_scoring_required", "automatic_scores_are_not_sufficient_for_model_selection": True}, sort_keys=False)
    head = results.sparkSession.createDataFrame([("", 0, -2, i, line) for i, line in enumerate(SHEET_HEAD)], "label string, block int, place long, line int, value string")
    write_one(head.unionByName(human_sheet(results)).orderBy("label", "block", "place", "line").select("value"), f"{base}/human_scoring_sheet.md", "text")
    write_json(base / "private_work" / "private_model_map.json", private_map)


def write_json(path: str | Path, value: object, sort_keys: bool = True) -> None:
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=sort_keys, default=str) + "\n", encoding="utf-8")


def write_batch(df: DataFrame, path: str) -> None:
    """A resume point: only the partitions of the given batches are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_number").parquet(path)


def remaining(batches: DataFrame, path: str) -> DataFrame:
    """Batches without a resume point yet."""
    spark = batches.sparkSession
    try:
        done = spark.read.parquet(path).select("batch_number").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return batches
    return batches.join(done, "batch_number", "left_anti")
