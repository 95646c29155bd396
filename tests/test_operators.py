"""Scenarios of ranking, selection, evidence, audit, ledger and text functions."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators import audit, benchmarking, citation_graph, citations, evidence, integrity, ledger, ranking, selection
from sieveline.spec import BudgetSpec, ModelSpec, QualitySpec, SearchSpec, SpecError, TaskSpec, confined, keyword_form


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert value(spark, T.normal_doi(F.lit(" https://doi.org/10.1/ABC. "))) == "10.1/abc"
    assert value(spark, T.normal_title(F.lit("Évidence-Based  Straße 漢"))) == "evidence based stra e"
    assert value(spark, T.canonical_key(F.lit(""), F.lit(None), F.lit("A1"), F.lit("T"), F.lit(2020))) == "arxiv:a1"
    assert value(spark, T.canonical_key(F.lit(None), F.lit(None), F.lit(None), F.lit("漢字"), F.lit(2020))) == "title::2020"
    assert value(spark, T.tokens(F.lit("State-of-the-art X"))) == ["state-of", "the-art", "x"]
    assert value(spark, T.token_estimate(F.lit(""))) == 0 and value(spark, T.token_estimate(F.lit("a b"))) == 3
    assert value(spark, T.price(F.lit(1000), F.lit(1000), F.lit("6.5"), F.lit("27"))) == Decimal("0.0335")
    assert value(spark, T.group_id(F.lit("t:gh-1-1"))) == "t"
    assert value(spark, T.fragments(F.lit("aaa\n\nbbb\n\ncccc"), 8)) == ["aaa\n\nbbb", "cccc"]
    assert value(spark, T.fragments(F.lit(" a \n \n b\n\n\n c"), 4)) == ["a \n \n b", "c"] and value(spark, T.fragments(F.lit(" \n\n "), 4)) == [" \n\n "]
    assert value(spark, T.decoded_index(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2))))) == "a b a"
    assert value(spark, T.unfinished(F.lit("Done. [@ref_1]"))) is False and value(spark, T.unfinished(F.lit("First.\n\nnot done [@x]"))) is True
    assert value(spark, T.parsed_json(F.lit('```json\n{"a": 1}\n```'), "a int")).a == 1
    aliases = F.array(F.struct(F.lit("c1").alias("alias"), F.lit("ref_0123456789").alias("key")))
    assert value(spark, T.rewritten_citations(F.lit("[@c1; @ref_0123456789_e2] x"), aliases)) == "[@ref_0123456789] x"
    two = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(k).alias("key")) for a, k in (("c1", "k.a"), ("c10", "kb"))])
    assert value(spark, T.rewritten_citations(F.lit("k.a says [@c1; @c10; @c1] and [@kb] [@c10_e3] [@kb]; kxa, (kb)"), two)) == "该研究 says [@k.a; @kb] and [@kb]; kxa, (该研究)"
    assert value(spark, T.cluster_unique(F.lit("[@a; @b; @a] [@c;@c]"))) == "[@a; @b] [@c]"


def papers(spark, rows):
    names = "ord long, record_id string, title string, abstract string, year int, doi string, pmid string, citation_count long, venue string, open_access_pdf_url string, authors array<string>, source_names array<string>, topics array<string>"
    return spark.createDataFrame([(i, f"r{i}", t, a, y, None, None, c, None, None, [], ["s"], []) for i, (t, a, y, c) in enumerate(rows)], names)


def test_relevant_beats_highly_cited(spark):
    spec = TaskSpec(title="x", keywords=("graph learning",))
    got = ranking.top_papers(ranking.rank_papers(papers(spark, [("Unrelated", "nothing here", 2020, 9000), ("Graph learning", "graph learning at work", 2020, 3)]), spec), 2).collect()
    assert [r.record_id for r in got] == ["r1", "r0"]
    assert "topical_anchor_missing" in got[1].quality_flags and "topical_anchor_missing" not in got[0].quality_flags


def test_year_bounds_drop_unknown_years(spark):
    p = papers(spark, [("a", "", 2020, 0), ("b", "", None, 0), ("c", "", 1990, 0)])
    assert [r.record_id for r in ranking.filter_papers(p, TaskSpec(title="x", year_from=2000)).collect()] == ["r0"]
    assert ranking.filter_papers(p, TaskSpec(title="x")).where("year IS NULL").count() in (0, 1)


def test_quota_and_breaker(spark):
    rows = spark.createDataFrame([("g", i, ok) for i, ok in enumerate([True, False, None, False, True, False, False, None, False, True])], "g string, i int, ok boolean")
    assert [r.i for r in selection.within_quota(rows, F.coalesce("ok", F.lit(False)), 2, ["i"], ["g"]).orderBy("i").collect()] == [0, 1, 2, 3, 4]
    assert [r.i for r in selection.before_breaker(rows, ~F.col("ok"), ["i"], ["g"]).orderBy("i").collect()] == list(range(9))


def test_cards_from_answers(spark):
    payload = '{"cards": [{"claim": " c1 ", "result": "r"}, {"claim": "", "result": "r"}, {"claim": "c3", "result": "r", "confidence": "HIGH"}]}'
    got = evidence.cards_from_payload(spark.createDataFrame([("p", "ref_1", payload, True)], "record_id string, citation_key string, payload string, verified boolean")).orderBy("evidence_id").collect()
    assert [(r.evidence_id, r.claim, r.confidence, r.locator) for r in got] == [("ref_1_e1", "c1", "medium", "full text"), ("ref_1_e3", "c3", "high", "full text")]


def test_batches_of_eight(spark):
    cards = spark.createDataFrame([(i, f"k{i // 2}", f"e{i}") for i in range(20)], "ord long, citation_key string, evidence_id string")
    got = evidence.batches(cards).groupBy("batch_number").count().orderBy("batch_number").collect()
    assert [(r.batch_number, r["count"]) for r in got] == [(1, 8), (2, 2)]


def test_digest_filter_falls_back_to_all(spark):
    d = spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "citation_key string, evidence_ids array<string>")
    assert evidence.filtered_digest(d, ["x"]).count() == 1 and evidence.filtered_digest(d, ["z"]).count() == 2 and evidence.filtered_digest(d, []).count() == 2


def test_reviews_merge(spark):
    issue = "array<struct<severity: string, problem: string>>"
    rows = [(0, "revise", [("low", "p")]), (1, "pass", [("low", "p"), ("high", "q")])]
    got = evidence.merged_reviews(spark.createDataFrame(rows, f"ord int, verdict string, issues {issue}")).first()
    assert got.verdict == "revise" and len(got.issues) == 2 and got.review_scope.fragment_count == 2 and got.citation_problems == []
    rows = [(0, "Reject", [("HIGH", "p")], ["b", "a"]), (1, "pass", None, ["a", "c"])]
    got = evidence.merged_reviews(spark.createDataFrame(rows, f"ord int, verdict string, issues {issue}, missing_perspectives array<string>")).first()
    assert got.verdict == "reject" and got.missing_perspectives == ["b", "a", "c"]


def test_issues_go_to_their_parts(spark):
    goes = lambda where, heading="2. 研究方法综述", number=2, structural=False: value(spark, evidence.issue_applies(F.lit(where), F.lit(heading), F.lit(number).cast("int"), F.lit(structural)))
    assert goes("") and goes(None) and goes("全文多处") and goes("第 2 节") and goes("研究方法综述一节") and not goes("第 3 节") and not goes("摘要") and not goes("global")
    assert goes("摘要", structural=True) and not goes("第 2 节", structural=True) and not goes("第 2 节", number=None)


def test_publication_status(spark):
    m = F.from_json(F.lit('{"update-to": [{"type": "Retraction"}], "relation": {"is-corrected-by": [{"id": "10.1/c"}]}}'), integrity.MESSAGE)
    got = value(spark, integrity.updates(m))
    assert [(u.type, u.doi, u.label) for u in got] == [("retraction", "", ""), ("correction", "10.1/c", "is-corrected-by")]
    assert value(spark, integrity.status(integrity.updates(m), F.lit("10.1/a"), F.lit(False))) == "retracted"


def audited(spark, markdown, *, n=40, evidence=20, full=6, cited=12, verdict="pass", high=0, status="no_adverse_update_found", sources=3, licence="CC-BY 4.0"):
    papers = spark.createDataFrame([(i, f"r{i}", f"ref_{i}", status, licence, "https://x/p.pdf") for i in range(n)], "ord long, record_id string, citation_key string, publication_status string, open_access_license string, open_access_pdf_url string")
    cards = spark.createDataFrame([(f"r{i}", "fulltext" if i < full else "abstract", i < full) for i in range(evidence)] + [("r39", "bibliographic_metadata", False)], "record_id string, evidence_type string, fulltext_verified boolean")
    log = spark.createDataFrame([(f"s{i}", 5, "ok") for i in range(sources)], "source string, records long, status string")
    drafts = spark.createDataFrame([(1, markdown)], "doc int, markdown string")
    verdicts = spark.createDataFrame([(1, verdict, high)], "doc int, verdict string, high_issues long")
    found = audit.gates(drafts, papers, cards, log, TaskSpec(title="xxx", models=ModelSpec(enabled=True)), verdicts)
    return found, {r.code: r.detail for r in found.collect()}


def test_gates_of_a_draft(spark):
    cite = "".join(f"[@ref_{i}]" for i in range(12))
    good = f"# T\n\n## One\nA full sentence {cite}.\n"
    found, codes = audited(spark, good)
    assert not codes and audit.run_status(found) == "pass"
    found, codes = audited(spark, good + "\n" + "Long prose without any citation. " * 5 + "\n\n## Two\ncut off [@zz] [@ref_39]", verdict="revise", high=2)
    assert codes == {"unknown_citations": "zz", "long_paragraphs_without_citations": "1", "unfinished_section_endings": "Two", "model_review_not_passed": "revise", "model_review_high_severity_issues": "2"}
    assert audit.run_status(found) == "blocked"
    _, codes = audited(spark, "## One\nBare. [@ref_0][@ref_39]", n=10, status="retracted", sources=2, licence=None)
    assert codes == {"insufficient_sources": "2", "insufficient_retained_records": "10", "adverse_publication_cited": "ref_0", "unknown_citations": "ref_39", "insufficient_publication_status_checks": "0", "adverse_publication_in_evidence": "10", "fulltext_license_not_verified": "6", "insufficient_cited_papers": "1"}
    found, codes = audited(spark, "", status="check_failed", full=2)
    assert codes == {"insufficient_fulltext_evidence": "2", "insufficient_publication_status_checks": "0", "publication_status_checks_incomplete": "20"}


def test_section_endings(spark):
    text = "## 摘要\nno end\n## A\nFine. [@x]\n## B\ncut off\n## C\n"
    got = audit.unfinished_sections(spark.createDataFrame([(1, text)], "doc int, markdown string")).orderBy("at").collect()
    assert [r.heading for r in got] == ["B", "C"]


def test_citation_clusters(spark):
    r = spark.createDataFrame([(1, "x [@b; @a] y [@c] z [@a; @a]")], "doc int, markdown string")
    assert [x.numbers for x in citations.clusters(r).orderBy("at").collect()] == [[1, 2], [3], [2]]


def event(kind, task, model="deepseek-v4-pro", i=0, o=0, amount=None, call=None, outcome=None):
    return {"kind": kind, "task_id": task, "month": "2026-01", "model_alias": model, "amount": amount, "input_tokens": i, "output_tokens": o, "call_id": call, "outcome": outcome, "ord": 0}


def test_admission_gates():
    r = ledger.Replay(BudgetSpec(model_month_limit=5.0))
    assert [r(event("reserve", f"t{k}")) for k in range(3)] == ["reserved", "reserved", "month_stop"]
    assert r(event("reserve", "t0")) == "known"
    assert r(event("call", "t0", i=100_000, o=10_000, call="a")) == "authorized" and r.calls["a"]["estimate"] == Decimal("1.5840")
    assert r(event("call", "t0", "none")) == "unknown_price" and r(event("call", "t0", o=1_000_000)) == "call_limit"
    assert r(event("call", "zz", i=10)) == "unknown_task"
    assert r(event("call", "t1", "kimi-k3", o=30_000, call="b")) == "authorized" and r(event("call", "t1", "kimi-k3", o=30_000)) == "provider_month_limit"
    assert r(event("complete", "t0")) == "completed" and r(event("call", "t0", i=10)) == "inactive_task"
    assert r.month["2026-01"] == Decimal(35)  # nothing was reconciled, so the ended task counts nothing


def test_calls_count_what_they_cost_once_reconciled():
    r = ledger.Replay(BudgetSpec())
    r(event("reserve", "g:gh-1-1"))
    assert r(event("call", "g:gh-1-1", "kimi-k3", o=37_000, call="a")) == "authorized"  # 4.8840
    assert r(event("reconcile", "", i=0, o=1000, call="a", outcome="completed")) == "completed"
    assert r.sums["group", "g"] == r.sums["group", "g", "kimi"] == Decimal("0.1200")
    assert r(event("reconcile", "", call="a", outcome="failed_unknown")) == "failed_unknown" and r.sums["group", "g"] == Decimal("4.8840")
    assert r(event("reconcile", "", call="a", outcome="failed_not_billed")) == "failed_not_billed" and r.sums["group", "g"] == 0
    assert r(event("reconcile", "", i=1000, o=1000, call="a", outcome="failed_billed")) == "failed_billed" and r.sums["month", "2026-01", "kimi"] == Decimal("0.1440")
    assert r(event("reconcile", "", call="zz", outcome="completed")) == "unknown_call" and r(event("reconcile", "", call="a", outcome="odd")) == "unknown_outcome"
    assert r(event("fail", "g:gh-1-1")) == "failed" and r.month["2026-01"] == Decimal("0.1440")
    # A later run of the same group shares its sums, under the limits of providers: 15 for deepseek, 20 for kimi.
    r(event("reserve", "g:gh-2-1"))
    calls = [r(event("call", "g:gh-2-1", "kimi-k3", o=37_000, call=f"k{k}")) for k in range(5)]
    assert calls == ["authorized"] * 4 + ["provider_task_limit"]
    assert [r(event("call", "g:gh-2-1", "deepseek-v4-pro", o=180_000, call=f"d{k}")) for k in range(4)] == ["authorized"] * 3 + ["task_limit"]
    assert r(event("call", "g:gh-2-1", "doubao-seed-2.1-pro", o=60_000)) == "task_limit"
    free = ledger.Replay(BudgetSpec(unlimited=True))
    assert {free(event("reserve", f"t{k}")) for k in range(9)} == {"reserved"} and free(event("call", "t0", o=9_000_000)) == "authorized"


def test_limits_must_agree():
    for broken in ({"call_limit": 9.0, "deepseek_task_limit": 8.0}, {"month_warning": 99.0}, {"task_limit": 36.0}, {"call_limit": 6.0, "model_month_limit": 5.0}):
        with pytest.raises(SpecError):
            BudgetSpec(**broken)
    assert BudgetSpec(model_task_limit=10.0).provider_task_limit("kimi") == 10


def test_admissions_keep_ledgers_apart(spark):
    rows = [(f"L{k % 2}", k, "reserve", f"t{k}", "2026-01", None, 60.0, 0, 0, None, None) for k in range(4)]
    got = ledger.admissions(spark.createDataFrame(rows, ledger.EVENT), BudgetSpec()).orderBy("ord").collect()
    assert [r.decision for r in got] == ["reserved", "reserved", "month_stop", "month_stop"]


def test_graph_expansion_saturates(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "citing long, cited long")
    found, log = citation_graph.expand(spark.createDataFrame([(1, 1.0)], "node long, score double"), edges, rounds=9, seeds_each=5, pool=10, threshold=0.01)
    assert sorted(r.node for r in found.collect()) == [1, 2, 3, 4] and len(log) == 4 and log[-1]["ratio"] == 0


def test_expansion_deals_one_budget(spark):
    """Two rounds against a loop over lists, the budget binding in both."""
    import random

    from sieveline.operators import citation_expansion

    rng = random.Random(4)
    works = [(i, f"https://openalex.org/W{i}", [f"W{rng.randint(0, 260)}" for _ in range(rng.randint(0, 6))], rng.random()) for i in range(240)]
    start, limits = works[:12], SearchSpec(citation_seeds=4, max_expansion=25, citation_rounds=2, saturation_ratio=1e-9, max_candidates=100, screening_pool=50)
    by_id = {f"W{w[0]}": w for w in works}
    ranked = lambda ws: sorted({w[0]: w for w in ws}.values(), key=lambda w: (-w[3], w[0]))[:100]
    current, done, added, log = ranked(start), set(), 0, []
    for _ in range(2):
        seeds = [w for w in current if w[1] not in done][:4]
        done |= {w[1] for w in seeds}
        rest = 25 - added
        ids = list(dict.fromkeys(r for w in seeds for r in w[2][:100]))
        back = [by_id[i] for i in ids if i in by_id][: min(rest // 2 or rest, len(ids), 500)]
        ahead = []
        for w in seeds:
            if len(ahead) + len(back) >= rest:
                break
            ahead += [x for x in works if f"W{w[0]}" in x[2]][: min(50, max(10, rest // 4))]
        before, keys = len(current), {w[0] for w in current}
        merged = {w[0]: w for w in [*current, *back, *ahead]}
        added += len(merged) - before
        current = ranked(merged.values())
        log.append((len(back), len(ahead), len(merged) - before, sum(w[0] not in keys for w in current[:50])))
    schema = "ord long, address string, referenced_work_ids array<string>, score double"
    frame = lambda ws: spark.createDataFrame(ws, schema).select("ord", F.col("ord").alias("node"), F.create_map(F.lit("openalex"), "address").alias("source_ids"), "referenced_work_ids", "score")
    order = [F.desc("score"), F.asc("node")]
    rank = lambda df: citation_expansion.reordered(df, order, 100)
    found, told = citation_expansion.expand(rank(frame(start)), frame(works), limits, merge=lambda df: df.dropDuplicates(["node"]), rank=rank, key=lambda df: df["node"])
    assert [r.node for r in found.orderBy("ord").collect()] == [w[0] for w in current]
    assert [(r["backward_records"], r["forward_records"], r["new_unique_records"], r["new_relevant_records_in_screening_pool"]) for r in told["rounds"]] == log and told["records_added"] == added
    assert citation_expansion.share(1, 3, 9) == citation_expansion.Share(1, 10, 1) and citation_expansion.share(5000, 30, 2000).backward == 500
    assert citation_expansion.expand(frame(start), frame(works), SearchSpec(), merge=None, rank=None, key=None)[1]["status"] == "skipped"


def test_foundational_works_equal_a_greedy_loop(spark):
    import math
    import random

    from sieveline.operators.dedupe import normal_title

    rng = random.Random(11)
    words = ["Theory", "of", "deep", "water", "Métal", "growth", "and", "light", "soil", "漢字"]
    schema = "record_id string, ord long, title string, abstract string, year int, citation_count long, publication_status string, rank_breakdown struct<scope_match: double, primary_scope_match: double, relevance: double>, quality_flags array<string>"
    for target, n in ((80, 300), (30, 60), (10, 3), (200, 0)):
        rows = [(f"r{i}", i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 5))), "x" * rng.choice([0, 250]), rng.choice([None, *range(1950, 2020)]), rng.choice([0, 1, 5, 5, 900]), rng.choice(["unchecked", "retracted", None]), (rng.choice([0.0, 0.5, 1.0]), rng.choice([0.0, 1.0]), rng.choice([0.0, 0.25])), rng.choice([None, ["a"]])) for i in range(n)]
        fit = [r for r in rows if r[4] is not None and r[5] > 0 and r[6] != "retracted" and r[7][0] > 0]
        reserve = min(8, max(2, target // 10), target)
        low, high = min((r[4] for r in fit), default=0), max((r[4] for r in fit), default=0)
        score = lambda r: math.log1p(r[5]) + 0.75 * (high - r[4]) / max(high - low, 1) + 0.75 * (len(r[3]) >= 200) + 0.5 * r[7][0] + 0.25 * r[7][2]  # noqa: B023, E731
        telling = lambda r: set(normal_title(r[2]).split()) - set(T.TITLE_STOPWORDS)
        same = lambda x, y: x[0] == y[0] or bool(telling(x) and telling(y)) and len(telling(x) & telling(y)) / min(len(telling(x)), len(telling(y))) >= 0.8
        chosen = []
        second = [r for r in fit if r[7][1] <= 0]
        for some, limit in (([r for r in fit if r[7][1] > 0], reserve - min(len(second), max(1, reserve // 4))), (second, reserve), (fit, reserve)):
            for r in sorted(some, key=lambda r: (-score(r), r[1])):
                if len(chosen) < limit and not any(same(r, c) for c in chosen):
                    chosen.append(r)
        got = selection.foundational(spark.createDataFrame(rows, schema).repartition(3), target).collect()
        assert [(g.record_id, g.place) for g in got] == [(c[0], k) for k, c in enumerate(chosen)]
        assert all(selection.FOUNDATIONAL in g.quality_flags for g in got)


def test_tasks_share_one_rate(spark, tmp_path):
    import time
    import uuid

    from sieveline.operators import integrity, paced

    def fetch(doi):
        (tmp_path / f"{time.time():.4f}-{uuid.uuid4().hex}").touch()
        if doi == "10.1/gone":
            raise paced.LookupFailed(404)
        if doi == "10.1/busy":
            raise paced.LookupFailed(429, 0.0)
        if doi == "10.1/odd":
            raise ValueError("x")
        return "{}"

    dois = ["10.1/gone", "10.1/busy", "10.1/odd", *(f"10.1/{i}" for i in range(12))]
    frame = spark.createDataFrame([(f"r{i}", d, "unchecked", None) for i, d in enumerate([*dois, "10.1/0", None])] + [("done", "10.1/x", "updated", ["a"])], "record_id string, doi string, publication_status string, quality_flags array<string>")
    got = integrity.refreshed(frame, fetch, tasks=3, interval=0.05, attempts=3)
    status = {r.record_id: r.publication_status for r in got.collect()}
    assert got.count() == len(dois) + 3 and status["done"] == "updated" and status["r0"] == status["r1"] == status["r2"] == "check_failed" and status["r3"] == "no_adverse_update_found"
    times = sorted(float(p.name.split("-")[0]) for p in tmp_path.iterdir())
    assert len(times) == len(dois) + 2  # three attempts for the busy one, none again for later actions
    assert times[-1] - times[0] >= 0.05 * (len(times) - 3) * 0.9
    errors = {r.key: r.error for r in paced.lookups(spark.createDataFrame([("10.1/gone",), ("10.1/odd",)], "key string"), fetch, interval=0.0).collect()}
    assert errors == {"10.1/gone": "LookupFailed: status 404", "10.1/odd": "ValueError: x"}


def test_slots_are_dealt_in_turn():
    from sieveline.operators import paced

    now, starts = [0.0], []
    def sleep(s):
        now[0] += s
    slots = paced.Slots(1, 3, 0.1, clock=lambda: now[0], sleep=sleep)
    for busy in (0.0, 0.0, 0.7, 0.0):
        slots.wait()
        starts.append(round(now[0], 6))
        now[0] += busy
    assert starts == [0.1, 0.4, 0.7, 1.6]  # 1.3 and 1.0 were over, 1.4 is no slot of this task
    assert paced.pause(paced.LookupFailed(429, 99), 0) == 5.0 and paced.pause(paced.LookupFailed(500), 2) == 2.0


def test_contract_and_docx_requirements(tmp_path):
    import zipfile

    from sieveline.spec import requirements_text, spec_from

    spec = spec_from({"title": "A title", "keywords": ["a b", "c"], "task_id": "t 1", "user_requirements": "u", "search": {"target_fulltexts": 20}, "budget": {"task_reservation_cny": 20}})
    got = spec.contract("20260101")
    assert len(got) == 20 and (got["task_id"], got["target_fulltexts"], got["budget"]["task_reservation_cny"], got["quality"]["minimum_cited_papers"], got["models"]["allow_second_model_review"]) == ("t-1", 20, 20, 12, True)
    assert got["base_queries"] == ['"a b" AND c', "a b", "c"] and got["requires_human_confirmation"] is True
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "<w:p><w:r><w:t>First </w:t></w:r><w:r><w:t>line here</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "r.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    assert requirements_text(tmp_path, "r.docx", " in ") == "in\n\nFirst line here\n\na\tb"
    (tmp_path / "x.docx").write_text("no archive of any kind")
    with pytest.raises(SpecError):
        requirements_text(tmp_path, "x.docx")


def test_scores_of_answers(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    s = lambda cites, text, need=("e1",): value(spark, benchmarking.score(cites, F.lit(text), arr("e1", "e2"), arr(*need), arr("secret")))
    assert s(arr("e1"), "fine") == 100 and s(arr("e9"), "fine") == 55 and s(arr("e1"), "a Secret") == 75 and s(F.array().cast("array<string>"), "fine", ()) == 100 and s(F.array().cast("array<string>"), "fine") == 90 and s(F.lit(None).cast("array<string>"), "  ") == 75 and s(arr("e2"), "fine", ("e1", "e2")) == 90


def test_specifications(tmp_path):
    spec = TaskSpec(title="T", keywords=(" a ", "a", "b"), include_terms=("c",), task_id="x y/z")
    assert spec.base_queries() == ["a AND b", "a", "b", "c"] and spec.resolved_id("20260101") == "x-y-z"
    assert spec.expanded_queries(["c", 5, "d" * 501, " e "])[-1] == "e"
    assert keyword_form("a，b; c\n", "t") == ["a", "b", "c"] and keyword_form(" ", "t") == ["t"]
    for broken in (lambda: TaskSpec(title="mail a@b.org"), lambda: SearchSpec(max_queries=0), lambda: SearchSpec(sources=("openalex",)), lambda: QualitySpec(min_cited=99), lambda: confined(tmp_path, "../x")):
        with pytest.raises(SpecError):
            broken()


def test_cases_of_a_suite(spark, tmp_path):
    import json

    case = {"case_id": "c1", "category": "x", "instruction": "do", "evidence": [{"id": "E1", "n": 5, "result": "r"}, {"n": 1}], "required_citations": ["E1"], "forbidden_patterns": ["a|b"]}
    path = tmp_path / "suite.json"
    path.write_text(json.dumps([case, {**case, "case_id": "c2", "required_citations": None}]))
    got = benchmarking.load_cases(spark, str(path)).orderBy("case_id").collect()
    assert [(r.case_id, r.instruction, r.allowed, r.required, r.forbidden) for r in got] == [("c1", "do", ["E1"], ["E1"], ["a|b"]), ("c2", "do", ["E1"], [], ["a|b"])]
    path.write_text(json.dumps([{"case_id": "c1"}]))
    with pytest.raises(Exception, match="lacks an id"):
        benchmarking.load_cases(spark, str(path)).collect()


def test_task_files(tmp_path):
    import json

    from sieveline.spec import load_spec

    data = {"title": "A title", "research_question": "What is it?", "keywords": ["a b", "c"], "year_from": 2000, "search": {"max_queries_per_source": 3, "minimum_independent_sources": 2}, "budget": {"single_request_cap_cny": 4}, "models": {"enabled": True, "primary_model": "kimi-k3"}, "output": {"formats": ["MD", "md"]}, "compliance": {"privacy_class": "B"}}
    path = tmp_path / "task.json"
    path.write_text(json.dumps(data))
    spec = load_spec(path)
    assert spec.base_queries() == ['"a b" AND c', "a b", "c"] and spec.search.min_sources == 2 and spec.budget.call_limit == 4 and spec.models.primary == "kimi-k3" and spec.output.formats == ("md",)
    for broken in ({"surprise": 1}, {"search": {"per_query": 5}}, {"models": {"cheap_model": "none"}}, {"compliance": {"rights_confirmed": False}}, {"languages": ["fr"]}, {"year_to": 1700}, {"title": "x"}):
        path.write_text(json.dumps(data | broken))
        with pytest.raises(SpecError):
            load_spec(path)


def test_manuscripts(spark):
    from sieveline.operators import manuscript

    heads = lambda *x: F.array(*[F.lit(h) for h in x])
    assert value(spark, manuscript.limitations_index(heads("1. 引言", "2. 方法的局限", "3. 局限与展望", "4. 结论"))) == 2
    assert value(spark, manuscript.limitations_index(heads("1. 引言", "2. 方法的局限"))) == 1 and value(spark, manuscript.limitations_index(heads("a"))) is None
    got = value(spark, manuscript.part_lengths(heads("1 引言", "2 A", "3 B", "4 局限", "5 结论"), F.lit(8000)))
    assert (got.main, got.frame, got.each) == ([1, 2], 2400, 2600)
    rows = [(' A "b" ', "ab", [" k1 ", "", "k2"], "in", [("2 M", "body m"), ("4 N", "body n"), ("5", "")], "end", "lim", "3 局限"), (None, None, None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "title string, abstract string, keywords array<string>, introduction string, sections array<struct<heading: string, body: string>>, conclusion string, limitations string, limitations_heading string")
    one, two = [r.m for r in d.select(manuscript.markdown({c: F.col(c) for c in d.columns}).alias("m")).collect()]
    assert one.split("\n---\n")[0].endswith('title: "A \'b\'"\nlang: "zh-CN"\nreference-section-title: "参考文献"\nlink-citations: true')
    assert [x for x in one.split("\n") if x.startswith("##")] == ["## 摘要", "## 引言", "## 2 M", "## 3 局限", "## 4 N", "## 结论"] and "**关键词：** k1；k2" in one and one.endswith("## 结论\n\nend\n")
    assert 'title: "文献综述"' in two and "## 局限" not in two


def test_answers_and_calls(spark):
    import json

    from sieveline.operators import model_calls

    chat = lambda text, reason="stop", **usage: json.dumps({"choices": [{"finish_reason": reason, "message": {"content": text}}], "usage": usage})
    other = json.dumps({"status": "completed", "output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "a"}, {"type": "output_text", "text": " "}, {"type": "output_text", "text": "b"}]}], "usage": {"input_tokens": 4}})
    read = lambda style, payload: tuple(value(spark, model_calls.extracted(F.lit(style), F.lit(payload), F.lit(7), F.lit(9))))
    assert read("chat_completions", chat("x", prompt_tokens=3)) == ("x", 3, 9, None) and read("responses", other) == ("a\nb", 4, 9, None)
    assert read("chat_completions", chat("x", "length"))[3] == "stopped early: length" and read("chat_completions", "{}")[3] == "no choice"
    assert read("responses", '{"status": "failed"}')[3] == "not complete: failed" and read("responses", "{}")[3] == "no output text" and read("responses", "no")[3] is not None

    def send(r):
        if r["prompt"] == "free":
            raise model_calls.NotBilled("429")
        if r["prompt"] == "bad":
            raise ValueError("x")
        return json.dumps({"choices": [{"message": {"content": r["prompt"]}}]})

    rows = [("L", i, "t", "kimi-k3", "chat_completions", p, 10, o) for i, (p, o) in enumerate([("a", 100), ("bad", 100), ("free", 100), ("big", 1_000_000)])]
    got = model_calls.settled(model_calls.sent(spark.createDataFrame(rows, model_calls.REQUEST), send, BudgetSpec(), "2026-01")).orderBy("ord").collect()
    assert [(r.decision, r.content, r.outcome) for r in got] == [("authorized", "a", "completed"), ("authorized", None, "failed_unknown"), ("authorized", None, "failed_not_billed"), ("call_limit", None, None)]
    assert got[1].error == "ValueError: x" and got[0].used_output == 100


def test_requests_are_sent_once(spark, tmp_path):
    import json
    import os
    import uuid

    from sieveline.operators import model_calls

    sends, log = tmp_path / "sends", str(tmp_path / "log")
    sends.mkdir()

    def send(r):
        (sends / f"{r['ord']}-{uuid.uuid4().hex}").touch()
        if r["prompt"] == "fatal":
            os._exit(1)  # the worker is lost while a request is in flight
        return json.dumps({"choices": [{"message": {"content": r["prompt"]}}], "usage": {"prompt_tokens": 1, "completion_tokens": 1}})

    rows = [("L", i, "t", "kimi-k3", "chat_completions", p, 10, 100) for i, p in enumerate(["a", "b", "fatal", "c", "d"])]
    requests = spark.createDataFrame(rows, model_calls.REQUEST)
    with pytest.raises(Exception, match="exited unexpectedly|crashed"):
        model_calls.sent(requests, send, BudgetSpec(), "2026-01", log=log, patience=0.5)
    got = model_calls.sent(requests, send, BudgetSpec(), "2026-01", log=log, patience=0.5)
    assert got.count() == 5 and [r.answer is None for r in got.orderBy("ord").collect()] == [False, False, True, False, False]
    assert got.where("failure LIKE 'Interrupted%'").first().ord == 2
    again = model_calls.sent(requests, send, BudgetSpec(), "2026-01", log=log)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    assert sorted(int(p.name.split("-")[0]) for p in sends.iterdir()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="mounted"):
        model_calls.sent(requests, send, BudgetSpec(), "2026-01", log="s3://bucket/log")


def test_answers_count_before_the_next_request(spark):
    import json

    from sieveline.operators import ledger, model_calls

    # Of twelve estimates of over 4 four fit the provider's 20 a task; the costs that answers tell all do.
    _, _, output_price = next((p, i, float(o)) for a, p, i, o in ledger.PRICES if a == "kimi-k3")
    most = int(4 / 1.1 / output_price * 1_000_000)
    requests = spark.createDataFrame([("L", i, "t", "kimi-k3", "chat_completions", "x", 10, most) for i in range(12)], model_calls.REQUEST)
    told = lambda r: json.dumps({"choices": [{"message": {"content": "x"}}], "usage": {"prompt_tokens": 1, "completion_tokens": 1}})
    counts = [model_calls.sent(requests, answer, BudgetSpec(), "2026-01").where("decision = 'authorized'").count() for answer in (told, lambda r: "{}")]
    assert counts == [12, 4]


def test_two_tasks_have_one_effect(tmp_path):
    import threading

    from sieveline.operators.effects import EffectLog

    done, got = [], []

    def effect():
        done.append(1)
        return {"n": len(done)}

    runs = [threading.Thread(target=lambda: got.append(EffectLog(str(tmp_path), pause=0.01).once("k", effect, {"n": 0}))) for _ in range(8)]
    for t in runs:
        t.start()
    for t in runs:
        t.join()
    assert done == [1] and got == [{"n": 1}] * 8


def test_seeds_and_exports(spark, tmp_path):
    import json

    from sieveline.sources import seed, sinks

    (tmp_path / "seed.json").write_text(json.dumps({"cards": [{"evidence_id": "e1", "record_id": "r1", "claim": "c", "limitations": ["a", "b"]}], "papers": [{"record_id": "r1", "title": "T", "year": 2020}], "log": [1, {"a": 1}], "writing_checkpoints": {"x": 1}}))
    got = seed.read_seed(spark, tmp_path, "seed.json")
    assert got["cards"].count() == 1 and got["papers"].first().title == "T" and got["log"] == [{"a": 1}] and got["writing_checkpoints"] == {"x": 1} and got["digest"] == []
    assert seed.read_seed(spark, tmp_path, None)["cards"].count() == 0
    for broken in ([], {"cards": {"a": 1}}, {"writing_checkpoints": [1]}):
        (tmp_path / "bad.json").write_text(json.dumps(broken))
        with pytest.raises(SpecError):
            seed.read_seed(spark, tmp_path, "bad.json")
    for name in ("../x.json", "none.json"):
        with pytest.raises(SpecError):
            seed.read_seed(spark, tmp_path, name)
    matrix = sinks.evidence_matrix(got["cards"], got["papers"].withColumn("citation_key", F.lit("k"))).first()
    assert tuple(matrix.asDict()) == sinks.MATRIX and (matrix.citation_key, matrix.year, matrix.limitations, matrix.locator) == ("k", "2020", "a; b", "")
    keyed = spark.createDataFrame([("a",), ("b",)], "canonical_key string")
    assert [r.canonical_key for r in seed.without_seeded(keyed, keyed.where("canonical_key = 'a'")).collect()] == ["b"]
    sinks.prepare(tmp_path)
    sinks.write_provenance(tmp_path, TaskSpec(title="T", task_id="t"), ["q"], day="2026-01-01", execution_id="x", model_calls=False)
    assert json.loads((tmp_path / "private_work" / "private_provenance.json").read_text())["query_count"] == 1
    tasks = spark.createDataFrame([("t1", "2026-01", "running", 1), ("t2", "2026-02", "running", 2)], "task_id string, month string, status string, created_at int").withColumn("reserved_cny", F.lit(35).cast("decimal(18,4)"))
    calls = spark.createDataFrame([], "task_id string, actual_cny decimal(18,4)")
    month = sinks.month_export(tasks, calls, "2026-01", BudgetSpec())
    assert month["used_or_reserved"] == "35.0000" and [t["task_id"] for t in month["tasks"]] == ["t1"]
