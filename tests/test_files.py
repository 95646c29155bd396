"""Files of a run as one whole file each, the quality report, and the files of a benchmark."""

from __future__ import annotations

import csv
import json

import pytest
from pyspark.sql import functions as F

from sieveline.operators import audit
from sieveline.plans import views
from sieveline.sources import sinks
from sieveline.sources.one_file import write_one
from sieveline.spec import TaskSpec


def test_a_frame_becomes_one_list_in_order(spark, tmp_path):
    rows = [(i, f"line\n\"{i}\" é漢", None if i % 3 else [i, i + 1], {"k": str(i)}) for i in range(50)]
    frame = spark.createDataFrame(rows, "n int, text string, xs array<int>, m map<string,string>").repartition(5)
    path = tmp_path / "out" / "list.json"
    write_one(frame.orderBy(F.desc("n")), path, "json")
    want = [{"n": n, "text": t, "xs": xs, "m": m} for n, t, xs, m in reversed(rows)]
    assert path.read_text(encoding="utf-8") == json.dumps(want, ensure_ascii=False, indent=2) + "\n"
    assert [p.name for p in path.parent.iterdir()] == ["list.json"]
    write_one(frame.where("n < 0"), path, "json")
    assert path.read_text() == "[]\n"
    write_one(frame.where("n < 2").select("n").orderBy("n"), path, "json", within=json.dumps({"a": {"b": [1]}, "c": None}), key="rows")
    assert path.read_text() == json.dumps({"a": {"b": [1]}, "c": None, "rows": [{"n": 0}, {"n": 1}]}, indent=2) + "\n"
    write_one(frame.where("n < 0").select("n"), path, "json", within="{}", key="rows")
    assert json.loads(path.read_text()) == {"rows": []}


def test_a_failed_write_leaves_the_file_as_it_was(spark, tmp_path):
    path = tmp_path / "x.csv"
    frame = spark.range(30).select("id", F.concat(F.lit('a,"b'), F.col("id").cast("string")).alias("v"))
    write_one(frame.orderBy("id"), path, "csv")
    raw = path.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfid,v\r\n") and list(csv.reader(raw.decode("utf-8-sig").splitlines()))[1:] == [[str(i), f'a,"b{i}'] for i in range(30)]
    broken = frame.select(F.when(F.col("id") < 29, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id"))
    with pytest.raises(Exception, match="lost"):
        write_one(broken, path, "csv")
    assert path.read_bytes() == raw and [p.name for p in tmp_path.iterdir()] == ["x.csv"]
    with pytest.raises(Exception, match="no kind"):
        write_one(frame, path, "xml")


def test_search_run_and_references(spark, tmp_path):
    base = sinks.prepare(tmp_path)
    papers = spark.createDataFrame([(2, "r2", "B", None), (1, "r1", "A", 2020)], "rank int, record_id string, title string, year int")
    log = spark.createDataFrame([("crossref", "q1", "ok", None, 2), ("crossref", "q2", "failed", "E", 0), ("europe_pmc", "q1", "failed", "E", 0)], "source string, query string, status string, error string, records int").coalesce(1)
    sinks.write_search_run(papers, log, str(base), task_id="t", started_at="a", completed_at="b", queries=["q1", "q2"], raw=2, deduplicated=2)
    got = json.loads((base / "search" / "search_run.json").read_text())
    assert [p["record_id"] for p in got["papers"]] == ["r1", "r2"] and list(got)[-1] == "papers" and got["raw_record_count"] == 2
    assert got["source_status"]["crossref"] == {"status": "ok", "queries": [{"query": "q1", "records": 2, "status": "ok"}, {"query": "q2", "records": 0, "status": "failed", "error": "E"}], "records": 2}
    assert got["source_status"]["europe_pmc"]["status"] == "failed"
    whole = views.papers(spark, "/root/testdata/sf0.001").withColumn("rank", F.col("ord") + 1).withColumn("citation_key", F.col("record_id"))
    sinks.write_references(whole, str(base))
    listed = json.loads((base / "search" / "references.csl.json").read_text())
    assert [x["id"] for x in listed] == [r.record_id for r in whole.orderBy("rank").select("record_id").collect()]


def test_quality_report(spark, tmp_path):
    papers = spark.createDataFrame([("r1", "k1", "no_adverse_update_found", "cc-by", "https://x/p.pdf", 1), ("r2", "k2", "retracted", None, None, 2), ("r3", "k3", "unchecked", None, None, 3)], "record_id string, citation_key string, publication_status string, open_access_license string, open_access_pdf_url string, ord long")
    cards = spark.createDataFrame([("r1", "fulltext", True), ("r1", "abstract", False), ("r2", "abstract", False), ("r3", "bibliographic_metadata", False)], "record_id string, evidence_type string, fulltext_verified boolean")
    log = spark.createDataFrame([("crossref", "q", "ok", None, 3), ("europe_pmc", "q", "failed", "E", 0)], "source string, query string, status string, error string, records int")
    text = "# T\n\n## One\n\nSaid [@k1; @zz].\n\n## Two\n\n" + "long words " * 20 + "without an end"
    reviews = spark.createDataFrame([(0, text)], "doc int, markdown string")
    spec = TaskSpec(title="T", task_id="t")
    report = audit.quality_report(reviews, papers, cards, log, spec, task_id="t", raw=5, deduplicated=3)
    shown = ("status", "operational_sources", "retained_records", "evidence_cards", "evidence_papers", "bibliographic_metadata_papers", "fulltext_verified_papers", "fulltext_verified_cards", "fulltext_license_verified_papers", "citations_used", "substantive_citations_used", "unknown_citations", "unfinished_sections")
    assert [report[k] for k in shown] == ["blocked", ["crossref"], 3, 4, 2, 1, 1, 1, 1, 2, 1, ["zz"], ["Two"]]
    assert report["publication_status_counts"] == {"no_adverse_update_found": 1, "retracted": 1, "unchecked": 1} and len(report["uncited_long_paragraphs"]) == 1
    assert {"unknown_citations", "adverse_publication_in_evidence", "insufficient_sources"} <= {f["code"] for f in report["findings"]}
    sinks.write_quality_report(report, tmp_path)
    assert json.loads((tmp_path / "audit" / "quality_report.json").read_text()) == report
    lines = (tmp_path / "audit" / "quality_report.md").read_text().split("\n")
    assert "- 保留记录：3" in lines and "- 正常响应数据源：1" in lines and any(x.startswith("- [high] `unknown_citations`：") for x in lines)
    without = audit.quality_report(reviews, papers, None, log, spec, task_id="t", raw=5, deduplicated=3)
    assert without["evidence_cards"] == 0 and without["publication_status_counts"] == {}


def test_benchmark_files(spark, tmp_path):
    schema = "label string, place long, case_id string, category string, response struct<text: string, citations: array<string>>, error string, score int"
    rows = [("candidate_B", 0, "c1", "x", ("said", ["e1", "e2"]), None, 90), ("candidate_B", 1, "c2", "y", None, "E: lost", None), ("candidate_A", 0, "c1", "x", ("", []), None, 35), ("candidate_A", 1, "c2", "y", ("ok", None), None, 60)]
    sinks.write_benchmark(spark.createDataFrame(rows, schema).repartition(3), {"candidate_A": "m1", "candidate_B": "m2"}, tmp_path)
    blind = json.loads((tmp_path / "blinded_results.json").read_text())
    assert list(blind) == ["candidate_A", "candidate_B"]
    assert [(label, b["case_id"], b["automatic_score"]["total"], b["automatic_score"]["failed"]) for label, cases in blind.items() for b in cases] == [("candidate_A", "c1", 35, False), ("candidate_A", "c2", 60, False), ("candidate_B", "c1", 90, False), ("candidate_B", "c2", 0, True)]
    assert "m1" not in (tmp_path / "blinded_results.json").read_text() + (tmp_path / "human_scoring_sheet.md").read_text()
    assert json.loads((tmp_path / "private_work" / "private_model_map.json").read_text()) == {"candidate_A": "m1", "candidate_B": "m2"}
    summary = json.loads((tmp_path / "score_summary.json").read_text())["candidates"]
    assert summary["candidate_B"] == {"cases": 2, "automatic_average": 45.0, "failed_cases": 1, "human_score_pending": True}
    sheet = (tmp_path / "human_scoring_sheet.md").read_text().split("\n")
    assert sheet[4:10] == ["## candidate_A", "", "| 题目 | 类别 | 自动分 | 人工分 | 备注 |", "|---|---|---:|---:|---|", "| c1 | x | 35 |  |  |", "| c2 | y | 60 |  |  |"]
    assert "### c2 回答" in sheet and "运行失败：E: lost" in sheet and "证据编号：e1、e2" in sheet
