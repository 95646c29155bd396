"""Parsers of service answers, paging, and the writers."""

from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from sieveline.sources import records, scan, services, sinks

CROSSREF = {"title": [" ", "A <i>title</i>"], "DOI": "10.1/ABC", "author": [{"given": "Ann", "family": "Lee"}, {"family": ""}], "abstract": "<p>Fish &amp; chips\n are</p>", "link": [{"content-type": "text/html", "URL": "h"}, {"content-type": "application/PDF", "URL": "https://x/p.pdf"}], "license": [{"URL": "https://creativecommons.org/licenses/by/4.0/"}], "container-title": ["V"], "type": "book", "is-referenced-by-count": 7, "published-print": {"date-parts": [[2020, 5]]}}
S2 = {"title": "T", "paperId": "p1", "externalIds": {"DOI": "10.1/X", "ArXiv": "1"}, "authors": [{"name": "A"}, {"name": ""}], "year": 0, "citationCount": "3", "fieldsOfStudy": ["Bio"], "openAccessPdf": {"url": "u", "status": "GOLD"}}
EPMC = {"title": "T", "id": "5", "pubYear": "2019", "fullTextUrlList": {"fullTextUrl": [{"documentStyle": "pdf", "availability": "Subscription", "url": "a"}, {"documentStyle": "PDF", "availability": "Free", "url": "b"}]}}
ALEX = {"id": "https://openalex.org/W1", "title": "T", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "referenced_works": ["https://openalex.org/W2"]}


def parsed(spark, name, *items):
    raw = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "rank int, item string")
    return records.PARSERS[name](raw).collect()


def test_parsers(spark):
    (c,) = parsed(spark, "crossref", CROSSREF, {"title": [], "DOI": "10.1/none"})
    assert (c.record_id, c.title, c.abstract, c.year, c.publication_date, c.authors, c.citation_count) == ("crossref:10.1/ABC", "A <i>title</i>", "Fish & chips are", 2020, "2020-05", ["Ann Lee"], 7)
    assert (c.doi, c.open_access_pdf_url, c.source_relevance, c.source_ids) == ("10.1/abc", "https://x/p.pdf", 1.0, {"crossref": "10.1/ABC"})
    (s,) = parsed(spark, "semantic_scholar", S2, {"title": "no id"})
    assert (s.year, s.authors, s.arxiv_id, s.open_access_license, s.topics) == (None, ["A"], "1", None, ["Bio"])
    (e,) = parsed(spark, "europe_pmc", EPMC)
    assert (e.record_id, e.open_access_pdf_url, e.landing_page_url) == ("europe_pmc:MED:5", "b", "https://europepmc.org/article/MED/5")
    (o,) = parsed(spark, "openalex", ALEX)
    assert (o.abstract, o.referenced_work_ids) == ("a b a", ["W2"])
    assert parsed(spark, "crossref", {"title": ["No Id: here!"]})[0].record_id == "crossref:no-id-here"


def test_search_isolates_failures_and_asks_once(spark, tmp_path):
    def fetch(url, params):
        (tmp_path / uuid.uuid4().hex).touch()
        if "bad" in (params.get("query"), params.get("query.bibliographic")):
            raise services.ServiceError(500)
        if "crossref" in url:
            return {"message": {"items": [CROSSREF, {"title": []}, CROSSREF, CROSSREF]}}
        return {"data": [{"title": "no id"}, S2, S2], "token": "t" if "token" not in params else None}

    papers, log = scan.search(spark, ["crossref", "semantic_scholar"], ["good", "bad"], fetch=fetch, limit=3)
    assert [(r.source_names[0], r.source_relevance) for r in papers.orderBy("ord").collect()] == [("crossref", 1.0), ("crossref", 1 / 3), ("crossref", 1 / 4), ("semantic_scholar", 1 / 2), ("semantic_scholar", 1 / 3), ("semantic_scholar", 1 / 4)]
    assert [tuple(r) for r in log.select("source", "query", "status", "records").collect()] == [("crossref", "good", "ok", 3), ("crossref", "bad", "failed", 0), ("semantic_scholar", "good", "ok", 3), ("semantic_scholar", "bad", "failed", 0)]
    assert log.where("error = 'ServiceError: status 500'").count() == 2
    # One request a query and one page more, whatever was read afterwards.
    assert len(list(tmp_path.iterdir())) == 5


def test_filters_reach_the_services(spark, tmp_path):
    dated = lambda y: CROSSREF | {"DOI": f"10.1/{y}", "published-print": {"date-parts": [[y]]}}

    def fetch(url, params):
        (tmp_path / uuid.uuid4().hex).write_text(json.dumps(params))
        return {"message": {"items": [dated(1999), dated(2004), {"title": "undated"}]}}

    spark.conf.set(scan.PUSHDOWN, "true")
    try:
        rows = scan.scan(spark, ["crossref", "openalex"], ["a", "b", "c"], fetch=fetch, columns=["title"]).where("year >= 2001 AND year < 2010 AND query IN ('a', 'c') AND source = 'crossref'")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Filter" not in plan.replace("RuntimeFilters", ""), plan
        assert sorted((r.query, r.year, r.rank) for r in rows.collect()) == [("a", 2004, 1), ("c", 2004, 1)]
    finally:
        spark.conf.unset(scan.PUSHDOWN)
    asked = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    assert sorted(a["query.bibliographic"] for a in asked) == ["a", "c"]
    assert {a["filter"] for a in asked} == {"from-pub-date:2001-01-01,until-pub-date:2009-12-31"} and {a["select"] for a in asked} == {"DOI,title,published,published-online,published-print"}
    plain = scan.scan(spark, ["crossref"], ["a"], fetch=fetch).where("year >= 2001")
    assert [r.year for r in plain.collect()] == [2004]


def test_recordings_answer_instead_of_services(spark, tmp_path):
    key = services.request_key(services.CROSSREF_URL, services.crossref_request("q", 10, (None, None)))
    path = str(tmp_path / "recordings")
    spark.createDataFrame([(key, json.dumps({"message": {"items": [CROSSREF]}}))], "request string, answer string").write.parquet(path)
    answer = services.recorded_fetch(path)
    assert answer(services.CROSSREF_URL, services.crossref_request("q", 10, (None, None)))["message"]["items"] == [CROSSREF]
    with pytest.raises(services.ServiceError):
        answer(services.CROSSREF_URL, services.crossref_request("other", 10, (None, None)))


def test_cursor_stops_on_a_repeat():
    one = {"title": "T", "id": "1"}
    pages = [{"resultList": {"result": [one] * 1000}, "nextCursorMark": "a"}, {"resultList": {"result": [one] * 1000}, "nextCursorMark": "a"}]
    assert len(services.records_of(lambda u, p: pages.pop(0), "europe_pmc", "q", 5000, (None, None))) == 2000
    asked = []
    services.records_of(lambda u, p: asked.append(p) or {}, "europe_pmc", "q", 5000, (2000, None))
    assert asked[0]["query"] == "(q) AND FIRST_PDATE:[2000-01-01 TO 2100-12-31]" and asked[0]["pageSize"] == 1000
    with pytest.raises(services.ServiceError):
        services.records_of(None, "openalex", "q", 1, (None, None))


def test_retries_pause_as_asked():
    tries, pauses = [services.ServiceError(429, 99), services.ServiceError(500), {"ok": 1}], []

    def fetch(url, params):
        x = tries.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert services.with_retries(fetch, sleep=pauses.append)("u", {}) == {"ok": 1} and pauses == [20, 2]


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([(1, "r1", "A|B", 2020, ["X", "Y"], None, "10.1/a", None, 5, 0.5, ["s"], None, "unchecked", [], "abs", "ref_1", "book", None)], "rank int, record_id string, title string, year int, authors array<string>, venue string, doi string, pmid string, citation_count long, rank_score double, source_names array<string>, open_access_pdf_url string, publication_status string, quality_flags array<string>, abstract string, citation_key string, work_type string, landing_page_url string")
    base = sinks.prepare(tmp_path / "run")
    sinks.write_papers(p, str(base))
    back = spark.read.option("header", True).csv(f"{base}/search/papers.csv")
    assert back.columns[0].endswith("rank") and back.first().authors == "X; Y" and len(back.columns) == 14
    item = json.loads(sinks.csl_references(p).first().value)
    assert item == {"id": "ref_1", "type": "book", "title": "A|B", "author": [{"literal": "X"}, {"literal": "Y"}], "issued": {"date-parts": [[2020]]}, "DOI": "10.1/a"}
    assert "A\\|B" in sinks.search_report(p, spark.createDataFrame([("s", 1)], "source string, records long"))
    batches = spark.createDataFrame([(1, "x"), (2, "y")], "batch_number int, v string")
    assert sinks.remaining(batches, f"{base}/digest").count() == 2
    sinks.write_batch(batches.where("batch_number = 1"), f"{base}/digest")
    assert [r.batch_number for r in sinks.remaining(batches, f"{base}/digest").collect()] == [2]
    with pytest.raises(Exception, match="no paper"):
        sinks.evidence_matrix(spark.createDataFrame([("zz",)], "record_id string"), p).collect()
