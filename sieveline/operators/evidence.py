"""Evidence cards, packets, digests and their text shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import ordered_unique, stripped
from sieveline.operators.components import written

ADVERSE = ("retracted", "withdrawn", "expression_of_concern")
PAYLOAD = "struct<cards: array<struct<claim: string, result: string, study_design: string, population: string, limitations: array<string>, locator: string, confidence: string>>>"


def sound_cards(cards: DataFrame, papers: DataFrame) -> DataFrame:
    """Cards of known papers without an adverse status."""
    ok = papers.where(~F.coalesce(F.col("publication_status"), F.lit("")).isin(*ADVERSE)).select("record_id")
    return cards.join(ok, "record_id", "left_semi")


def cards_from_payload(answers: DataFrame) -> DataFrame:
    """Cards from model answers (record_id, citation_key, payload, verified): the first twelve items with claim and result.

    The number in evidence_id is the item's place in the answer, so gaps stay.
    """
    items = F.slice(F.from_json("payload", PAYLOAD)["cards"], 1, 12)
    rows = answers.select("record_id", "citation_key", "verified", F.posexplode(items).alias("at", "c")).where(F.col("c").isNotNull())
    text = lambda f: F.nullif(stripped(F.col(f"c.{f}")), F.lit(""))
    made = rows.select(
        F.concat("citation_key", F.lit("_e"), (F.col("at") + 1).cast("string")).alias("evidence_id"), "record_id", text("claim").alias("claim"), text("result").alias("result"),
        F.when(F.col("verified"), "fulltext").otherwise("abstract").alias("evidence_type"), text("study_design").alias("study_design"), text("population").alias("population"),
        ordered_unique(F.col("c.limitations")).alias("limitations"), F.coalesce(text("locator"), F.when(F.col("verified"), F.lit("full text")).otherwise(F.lit("abstract"))).alias("locator"),
        F.col("verified").alias("fulltext_verified"), F.lower(F.coalesce(text("confidence"), F.lit("medium"))).alias("confidence"),
    )
    return made.where(F.col("claim").isNotNull() & F.col("result").isNotNull())


def metadata_cards(papers: DataFrame, fulltext: DataFrame) -> DataFrame:
    """A bibliographic card for foundational papers whose text is under 200 characters."""
    text = papers.join(fulltext.select("record_id", F.length("text").alias("__n")), "record_id", "left")
    n = F.coalesce("__n", F.length("abstract"), F.lit(0))
    return text.where(F.array_contains("quality_flags", "foundational_priority") & (n < 200)).select(
        F.concat("citation_key", F.lit("_metadata")).alias("evidence_id"), "record_id", F.concat(F.col("title"), F.lit(" is a cited work of "), F.coalesce(F.col("year").cast("string"), F.lit("unknown year"))).alias("claim"), F.lit("bibliographic_metadata").alias("evidence_type"), F.lit(False).alias("fulltext_verified"), F.lit("low").alias("confidence")
    )


def evidence_text(papers: DataFrame, fulltext: DataFrame, *, limit: int = 45_000) -> DataFrame:
    """Each paper's text for extraction: verified full text or abstract, cut; texts under 200 characters are out."""
    got = papers.join(fulltext.where("status = 'extracted'").select("record_id", F.col("text").alias("__full")), "record_id", "left")
    text = F.coalesce("__full", "abstract", F.lit(""))
    return got.select(*papers.columns, F.substring(text, 1, limit).alias("text"), F.col("__full").isNotNull().alias("verified")).where(F.length("text") >= 200)


def refreshed(papers: DataFrame, newer: DataFrame, columns: list[str]) -> DataFrame:
    """Rows overridden by record_id where there is a newer one."""
    new = newer.select("record_id", F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = papers.join(new, "record_id", "left")
    return both.select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in papers.columns])


def packet(cards: DataFrame, papers: DataFrame) -> DataFrame:
    """Cards with their papers' columns; a card of an unknown paper is out."""
    return cards.join(papers.select("record_id", "citation_key", "title", "year"), "record_id")


def batches(cards: DataFrame, *, size: int = 8) -> DataFrame:
    """Cards grouped by citation key in order of first sight, ``size`` keys a batch, numbered from 1.

    Keys are numbered range by range: ranges of the order are counted, and the
    counts before a range are added, so no task numbers them all.
    """
    groups = cards.groupBy("citation_key").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "evidence_id"))).alias("items"))
    ranked = numbered(groups, "ord")
    return ranked.select(F.floor(F.col("number") / size + 1).cast("int").alias("batch_number"), "citation_key", F.transform("items", lambda x: x["evidence_id"]).alias("evidence_ids"), "ord")


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``number`` from 0 in the order of columns that are distinct together, without gathering the rows in one task.

    The ranges are written: another execution may draw or join them otherwise, and
    their counts would be those of other ranges.
    """
    from pyspark.sql import Window

    spread = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    within = written(spread.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1), "ranges")
    sizes = {r["__part"]: r["n"] for r in within.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    offsets = F.create_map(*[F.lit(x) for p, b in before.items() for x in (p, b)]) if before else F.lit(None).cast("map<int,int>")
    return within.withColumn("number", F.col("__n") + offsets[F.col("__part")]).drop("__n", "__part")


def fallback_summaries(cards: DataFrame) -> DataFrame:
    """A summary for each paper from its own cards: the first four items, eight limitations, three designs and populations."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "evidence_id", "claim", "study_design", "population", "limitations")))
    g = cards.groupBy("citation_key").agg(rows.alias("r"))
    pick = lambda f, n: F.slice(ordered_unique(F.transform("r", lambda x: x[f])), 1, n)
    return g.select("citation_key", F.slice(F.transform("r", lambda x: x["evidence_id"]), 1, 4).alias("evidence_ids"), F.slice(F.transform("r", lambda x: x["claim"]), 1, 4).alias("supported_findings"), F.concat(pick("study_design", 3), pick("population", 3)).alias("design_and_population"), F.slice(ordered_unique(F.flatten(F.transform("r", lambda x: x["limitations"]))), 1, 8).alias("limitations"))


def sanitized_digest(summaries: DataFrame, allowed: DataFrame, fallback: DataFrame) -> DataFrame:
    """Summaries of a batch's own keys only, each once, ids cut to known ones; missing keys get their fallback.

    ``summaries``: (ord, citation_key, evidence_ids, ...); ``allowed``: (citation_key, ids).
    """
    known = summaries.join(allowed, "citation_key").withColumn("evidence_ids", F.array_intersect("evidence_ids", "ids"))
    first = known.groupBy("citation_key").agg(F.min_by("evidence_ids", "ord").alias("evidence_ids")).withColumn("origin", F.lit("model"))
    missing = allowed.join(first.select("citation_key"), "citation_key", "left_anti").join(fallback.select("citation_key", "evidence_ids"), "citation_key").select("citation_key", "evidence_ids").withColumn("origin", F.lit("fallback"))
    return first.unionByName(missing)


def filtered_digest(digest: DataFrame, ids: list[str], column: str = "evidence_ids") -> DataFrame:
    """Summaries that share an id with ``ids``; all of them where none does."""
    wanted = F.array(*[F.lit(i) for i in ids]) if ids else F.array().cast("array<string>")
    marked = digest.withColumn("__hit", F.arrays_overlap(column, wanted))
    some = marked.agg(F.coalesce(F.bool_or("__hit"), F.lit(False)).alias("__some"))
    return marked.join(F.broadcast(some)).where(F.col("__hit") | ~F.col("__some")).drop("__hit", "__some")  # one row


def alias_map(digest: DataFrame) -> DataFrame:
    """(alias, key): evidence ids and their citation keys, the last one of each."""
    return digest.select("ord", "citation_key", F.explode("evidence_ids").alias("alias")).groupBy("alias").agg(F.max_by("citation_key", "ord").alias("key"))


def merged_reviews(reviews: DataFrame) -> DataFrame:
    """One review from fragment reviews (ord, verdict, issues, and missing_perspectives, citation_problems where known).

    Issues and other entries are kept once, in order; any high issue takes the
    pass away, and then a reject beats a revise, whatever their case.
    """
    issues = reviews.select("ord", F.posexplode_outer("issues").alias("at", "issue"))
    distinct = issues.where(F.col("issue").isNotNull()).groupBy(F.to_json("issue").alias("j")).agg(F.min(F.struct("ord", "at")).alias("o"), F.first("issue").alias("issue"))
    listed = distinct.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "j", "issue"))), lambda x: x["issue"]).alias("issues"), F.coalesce(F.bool_or(F.lower("issue.severity") == "high"), F.lit(False)).alias("high"))
    joined = listed.join(F.broadcast(reviews.agg(F.coalesce(F.bool_or(F.lower("verdict") == "reject"), F.lit(False)).alias("rejected"), F.count("*").alias("fragments"))))  # one row
    for name in ("missing_perspectives", "citation_problems"):
        if name in reviews.columns:
            entries = reviews.select("ord", F.posexplode(name).alias("at", "x")).where(F.col("x").isNotNull()).groupBy("x").agg(F.min(F.struct("ord", "at")).alias("o"))
            joined = joined.join(F.broadcast(entries.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda e: e["x"]).alias(name))))  # one row
        else:
            joined = joined.withColumn(name, F.array().cast("array<string>"))
    verdict = F.when(~F.col("high"), "pass").when(F.col("rejected"), "reject").otherwise("revise")
    return joined.select(verdict.alias("verdict"), "issues", "missing_perspectives", "citation_problems", F.struct(F.col("fragments").alias("fragment_count")).alias("review_scope"))


# Words of a location that mean the whole text, and its frame.
EVERYWHERE = ("全文", "全篇", "整篇", "各节", "多处")
FRAME = ("标题", "摘要", "引言", "结论", "局限")


def issue_applies(location: Column, heading: Column, number: Column, structural: Column) -> Column:
    """Whether a review issue belongs to a part: everywhere; a structural part by its name; a section by its number or heading."""
    where = stripped(F.coalesce(location, F.lit("")))
    core = stripped(F.regexp_replace(F.coalesce(heading, F.lit("")), r"^(?U)\s*\d+[.、：:\s]*", ""))
    holds = lambda words: F.rlike(where, F.lit("|".join(words)))
    numbered = number.isNotNull() & F.rlike(where, F.concat(F.lit(r"(?U)第\s*"), F.coalesce(number.cast("string"), F.lit("x")), F.lit(r"\s*节")))
    named = (F.length(core) >= 4) & F.contains(where, core)
    return (where == "") | holds(EVERYWHERE) | F.when(structural, holds(FRAME)).otherwise(numbered | named)
