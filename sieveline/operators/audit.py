"""Audit gates over a run: findings with a code and a severity, and a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators.evidence import ADVERSE
from sieveline.spec import TaskSpec

VERIFIED = ("no_adverse_update_found", "updated")
UNCITED_HEADINGS = ("摘要", "参考文献")


def used_citations(reviews: DataFrame) -> DataFrame:
    """(doc, citation_key): the distinct citations of each review text."""
    return reviews.select("doc", F.explode(F.array_distinct(F.regexp_extract_all("markdown", F.lit(T.CITATION), F.lit(1)))).alias("citation_key"))


def unknown_citations(used: DataFrame, known: DataFrame) -> DataFrame:
    return used.join(known.select("citation_key").distinct(), "citation_key", "left_anti")


def uncited_paragraphs(markdown: Column) -> Column:
    """Long paragraphs of prose without a citation."""
    parts = F.filter(F.transform(F.split(markdown, r"\n\s*\n"), T.stripped), lambda p: F.length(p) >= 120)
    return F.filter(parts, lambda p: ~p.rlike(r"^(---|#|\||\*\*关键词)") & ~p.rlike(T.CITATION))


def sections(reviews: DataFrame) -> DataFrame:
    """(doc, at, heading, body) of second-level sections."""
    marked = F.regexp_replace("markdown", r"(?m)^##\s+", "\x1d")
    parts = F.slice(F.split(marked, "\x1d"), 2, 1_000_000)
    rows = reviews.select("doc", F.posexplode(parts).alias("at", "part"))
    return rows.select("doc", "at", T.stripped(F.substring_index("part", "\n", 1)).alias("heading"), F.when(F.instr("part", "\n") > 0, F.expr("substring(part, instr(part, '\\n') + 1)")).otherwise("").alias("body"))


def unfinished_sections(reviews: DataFrame) -> DataFrame:
    s = sections(reviews)
    return s.where(~F.col("heading").isin(*UNCITED_HEADINGS) & T.unfinished(F.col("body")))


def status_histogram(cards: DataFrame, papers: DataFrame) -> DataFrame:
    """Publication statuses of the distinct papers with evidence."""
    return cards.select("record_id").distinct().join(papers.select("record_id", "publication_status"), "record_id").groupBy("publication_status").agg(F.count("*").alias("n"))


def evidence_counts(cards: DataFrame, papers: DataFrame) -> DataFrame:
    """One row: distinct papers with evidence, metadata only, full text, licensed full text, and statuses."""
    met = cards.join(papers.select("record_id", "publication_status", "open_access_license", "open_access_pdf_url"), "record_id", "left")
    real, full = F.col("evidence_type") != "bibliographic_metadata", F.col("fulltext_verified")
    per = met.groupBy("record_id").agg(F.bool_or(real).alias("real"), F.bool_or(~real).alias("meta"), F.bool_or(full).alias("full"), F.bool_or(full & T.license_allows(F.col("open_access_license"), F.col("open_access_pdf_url"))).alias("licensed"), F.first("publication_status").alias("status"))
    n = lambda c: F.count_if(c)
    return per.agg(n("real").alias("evidence_papers"), n("meta").alias("metadata_papers"), n("full").alias("fulltext_papers"), n("licensed").alias("licensed_papers"), n(F.col("status").isin(*VERIFIED)).alias("verified"), n(~F.coalesce("status", F.lit("")).isin(*VERIFIED, *ADVERSE)).alias("incomplete"), n(F.col("status").isin(*ADVERSE)).alias("adverse"))


def source_contributions(log: DataFrame) -> DataFrame:
    """Per source: records, whether any query worked, whether it contributed."""
    return log.groupBy("source").agg(F.sum("records").cast("long").alias("records"), (F.count_if(F.col("status") == "ok") > 0).alias("operational"), (F.sum("records") > 0).alias("contributing"))


def run_facts(papers: DataFrame, cards: DataFrame | None, log: DataFrame) -> dict:
    """Counts of a run: sources that contributed, papers kept, and of papers with evidence. One row reaches the driver."""
    facts = source_contributions(log).agg(F.count_if("contributing").alias("contributing")).first().asDict() | papers.agg(F.count("*").alias("retained")).first().asDict()
    if cards is None:
        return facts | {"cards": None}
    status, real = F.col("publication_status"), F.col("evidence_type") != "bibliographic_metadata"
    per = cards.groupBy("record_id").agg(F.count("*").alias("cards"), F.bool_or(real).alias("real"), F.bool_or("fulltext_verified").alias("full"))
    known = papers.select("record_id", "publication_status", T.license_allows(F.col("open_access_license"), F.col("open_access_pdf_url")).alias("licensed"), F.lit(True).alias("known"))
    met = per.join(known, "record_id", "left")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return facts | met.agg(
        F.coalesce(F.sum("cards"), F.lit(0)).alias("cards"), n(F.col("real")).alias("evidence"), n(F.col("full")).alias("fulltext"), n(F.col("real") & status.isin(*VERIFIED)).alias("verified"),
        n(F.col("real") & F.col("known") & ~F.coalesce(status, F.lit("")).isin(*VERIFIED, *ADVERSE)).alias("incomplete"), n(status.isin(*ADVERSE)).alias("adverse"), n(F.col("full") & ~F.coalesce("licensed", F.lit(False))).alias("unlicensed"),
    ).first().asDict()


def draft_facts(reviews: DataFrame, papers: DataFrame, cards: DataFrame | None) -> DataFrame:
    """Per draft (doc, markdown): unknown and adverse citations, substantive ones, long paragraphs without any, unfinished sections."""
    drafts = reviews.where(F.coalesce("markdown", F.lit("")) != "")
    known = papers.groupBy("citation_key").agg(F.max_by(F.struct("record_id", "publication_status"), "ord").alias("paper"))
    real = (cards.where("evidence_type <> 'bibliographic_metadata'").select("record_id") if cards is not None else papers.select("record_id").limit(0)).distinct()
    solid = real.join(papers.select("record_id", "citation_key"), "record_id").select("citation_key", F.lit(True).alias("solid")).distinct()
    used = used_citations(drafts).join(known, "citation_key", "left").join(solid, "citation_key", "left")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("citation_key")))), ", ")
    per = used.groupBy("doc").agg(listed(F.col("paper").isNull()).alias("unknown"), listed(F.col("paper.publication_status").isin(*ADVERSE)).alias("adverse_cited"), F.count("solid").alias("cited"))
    ends = unfinished_sections(drafts).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "heading"))), lambda x: x["heading"]), ", ").alias("unfinished"))
    whole = reviews.select("doc", (F.coalesce("markdown", F.lit("")) != "").alias("drafted"), F.size(uncited_paragraphs(F.coalesce("markdown", F.lit("")))).alias("uncited"))
    return whole.join(per, "doc", "left").join(ends, "doc", "left").na.fill({"unknown": "", "adverse_cited": "", "cited": 0})


def gates(reviews: DataFrame, papers: DataFrame, cards: DataFrame | None, log: DataFrame, spec: TaskSpec, verdicts: DataFrame | None = None) -> DataFrame:
    """(doc, code, severity, detail): what is wrong with each draft of a run.

    ``papers`` has ord, citation_key, status and licence; ``log`` one row a
    query; ``verdicts`` (doc, verdict, high_issues) those of model reviews. A
    draft without text is judged by the run alone.
    """
    run, limits = run_facts(papers, cards, log), spec.quality
    drafts = draft_facts(reviews, papers, cards)
    if verdicts is None:
        drafts = drafts.withColumn("verdict", F.lit(None).cast("string")).withColumn("high_issues", F.lit(0).cast("long"))
    else:
        drafts = drafts.join(verdicts.select("doc", "verdict", "high_issues"), "doc", "left")
    found: list[Column] = []

    def gate(when: Column | bool, code: str, detail: Column | object, severity: str = "high") -> None:
        when, detail = (x if isinstance(x, Column) else F.lit(x) for x in (when, detail))
        found.append(F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))))

    gate(run["contributing"] < spec.search.min_sources, "insufficient_sources", run["contributing"])
    gate(run["retained"] == 0, "no_papers", 0)
    gate(0 < run["retained"] < limits.min_retained, "insufficient_retained_records", run["retained"])
    gate(F.col("unknown") != "", "unknown_citations", F.col("unknown"))
    gate(F.col("uncited") > 0, "long_paragraphs_without_citations", F.col("uncited"), "medium")
    gate(F.col("unfinished").isNotNull(), "unfinished_section_endings", F.col("unfinished"))
    gate(F.col("adverse_cited") != "", "adverse_publication_cited", F.col("adverse_cited"))
    if run["cards"] == 0:
        gate(True, "no_evidence_cards", 0)
    if run["cards"]:
        gate(run["evidence"] < limits.min_evidence, "insufficient_evidence_papers", run["evidence"])
        gate(run["fulltext"] < limits.min_fulltext, "insufficient_fulltext_evidence", run["fulltext"])
        gate(run["verified"] < min(limits.min_evidence, run["evidence"]), "insufficient_publication_status_checks", run["verified"])
        gate(run["incomplete"] > 0, "publication_status_checks_incomplete", run["incomplete"], "medium")
        gate(run["adverse"] > 0, "adverse_publication_in_evidence", run["adverse"])
        gate(run["unlicensed"] > 0, "fulltext_license_not_verified", run["unlicensed"])
    gate(F.col("drafted") & (F.col("cited") < limits.min_cited), "insufficient_cited_papers", F.col("cited"))
    if spec.models.enabled and spec.models.second_review:
        verdict = F.coalesce("verdict", F.lit("not_run"))
        gate(verdict != "pass", "model_review_not_passed", verdict)
    gate(F.coalesce("high_issues", F.lit(0)) > 0, "model_review_high_severity_issues", F.col("high_issues"))
    return drafts.select("doc", F.explode(F.filter(F.array(*found), lambda g: g.isNotNull())).alias("g")).select("doc", "g.*")


def run_status(found: DataFrame) -> str:
    return "pass" if found.where("severity = 'high'").isEmpty() else "blocked"


def quality_report(reviews: DataFrame, papers: DataFrame, cards: DataFrame | None, log: DataFrame, spec: TaskSpec, *, task_id: str, raw: int, deduplicated: int, verdicts: DataFrame | None = None, review_mode: str = "not_run") -> dict:
    """The report of one run and its draft (one row of ``reviews``): counts, findings and status."""
    found = gates(reviews, papers, cards, log, spec, verdicts)
    findings = [{"code": r["code"], "severity": r["severity"], "message": r["detail"]} for r in found.select("code", "severity", "detail").collect()]  # 17 at most
    sources = source_contributions(log).orderBy("source").collect()  # one row a source
    names = lambda flag: [r["source"] for r in sources if r[flag]]
    none = {"evidence_papers": 0, "metadata_papers": 0, "fulltext_papers": 0, "licensed_papers": 0, "verified": 0}
    counts = evidence_counts(cards, papers).first().asDict() if cards is not None else none
    totals = cards.agg(F.count("*").alias("cards"), F.count_if("fulltext_verified").alias("full")).first() if cards is not None else {"cards": 0, "full": 0}
    statuses = {r["publication_status"]: r["n"] for r in status_histogram(cards, papers).orderBy("publication_status").collect()} if cards is not None else {}
    facts = draft_facts(reviews, papers, cards).first()
    drafts = reviews.where(F.coalesce("markdown", F.lit("")) != "")
    paragraphs = drafts.select(F.explode(uncited_paragraphs(F.col("markdown")))).toDF("p").collect()  # of one draft
    verdict = verdicts.first()["verdict"] if verdicts is not None and not verdicts.isEmpty() else "not_run"
    listed = lambda text: [x for x in (text or "").split(", ") if x]
    return {
        "status": "pass" if all(f["severity"] != "high" for f in findings) else "blocked",
        "task_id": task_id,
        "operational_sources": names("operational"),
        "contributing_sources": names("contributing"),
        "successful_sources": names("operational"),
        "raw_records": raw,
        "deduplicated_records": deduplicated,
        "retained_records": papers.count(),
        "evidence_cards": totals["cards"],
        "evidence_papers": counts["evidence_papers"],
        "bibliographic_metadata_papers": counts["metadata_papers"],
        "fulltext_verified_papers": counts["fulltext_papers"],
        "fulltext_verified_cards": totals["full"],
        "fulltext_license_verified_papers": counts["licensed_papers"],
        "publication_status_counts": statuses,
        "publication_status_checked_papers": counts["verified"],
        "citations_used": used_citations(drafts).select("citation_key").distinct().count(),
        "substantive_citations_used": facts["cited"] if facts else 0,
        "unknown_citations": listed(facts["unknown"] if facts else ""),
        "uncited_long_paragraphs": [r["p"] for r in paragraphs],
        "unfinished_sections": listed(facts["unfinished"] if facts else ""),
        "model_review_mode": review_mode,
        "model_review_verdict": verdict,
        "findings": findings,
        "human_review_required": True,
        "review_type_claim": "narrative review; not a systematic review",
    }
