"""Ordered selection: tiers, quotas, breakers and reserved places.

Quotas and breakers are running sums over the order of a group (one run of one
source), so groups are spread and only a single group is sequential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators.components import written


def tier(primary: Column, scope: Column) -> Column:
    """0: the main topic is met or unknown, 1: some topic, 2: none."""
    return F.when(primary.isNull() | (primary > 0), 0).when(scope > 0, 1).otherwise(2)


def tiered(papers: DataFrame, target: int | None = None) -> DataFrame:
    out = papers.withColumn("tier", tier(F.col("rank_breakdown.primary_scope_match"), F.col("rank_breakdown.scope_match"))).orderBy("tier", "ord")
    return out.limit(target) if target is not None else out


def within_quota(rows: DataFrame, accepted: Column, target: int, order: list[str], group: list[str]) -> DataFrame:
    """Rows of each group, in order, until ``target`` are accepted; rejected ones before the cut stay."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__before", F.coalesce(F.sum(accepted.cast("int")).over(w), F.lit(0))).where(F.col("__before") < target).drop("__before")


def before_breaker(rows: DataFrame, failed: Column, order: list[str], group: list[str], *, limit: int = 3) -> DataFrame:
    """Rows of each group up to and with the ``limit``-th failure in a row; null neither counts nor resets."""
    w = Window.partitionBy(*group).orderBy(*order)
    marked = rows.withColumn("__f", failed).withColumn("__run", F.coalesce(F.sum(F.when(~F.col("__f"), 1)).over(w), F.lit(0)))
    streak = Window.partitionBy(*group, "__run").orderBy(*order)
    counted = marked.withColumn("__c", F.when(F.col("__f"), F.sum(F.when(F.col("__f"), 1).otherwise(0)).over(streak)).otherwise(0))
    cut = w.rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("__cut", F.coalesce(F.max("__c").over(cut), F.lit(0))).where(F.col("__cut") < limit).drop("__f", "__run", "__c", "__cut")


def checked_count(n: int, target: int) -> int:
    return min(n, max(2 * target, 100))


#: Flag of the works below.
FOUNDATIONAL = "foundational_priority"
#: Most places for them.
RESERVE = 8


def telling_words(title: Column) -> Column:
    """The distinct words of a title that tell works apart."""
    words = F.filter(F.split(T.normal_title(F.coalesce(title, F.lit(""))), " "), lambda w: w != "")
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in T.TITLE_STOPWORDS]))


def foundational(papers: DataFrame, target: int) -> DataFrame:
    """A few places for older works of high impact, with their flag and ``place``: at most eight, near-duplicates passed over.

    Each round takes the best work left, by an aggregate over all candidates,
    and then those that share four fifths of the shorter title's telling words
    with it are left out: one row a round reaches the driver, and no candidate is cut off
    beforehand. Most places go to works that the main scope fits, a quarter (one at least) to
    others if there are any, and what is left to the best of both.
    """
    reserve = min(RESERVE, max(2, target // 10), target)
    b = F.col("rank_breakdown")
    fit = papers.where(F.col("year").isNotNull() & (F.col("citation_count") > 0) & ~F.coalesce(F.col("publication_status"), F.lit("")).isin("retracted", "withdrawn") & (F.coalesce(b["scope_match"], F.lit(1.0)) > 0))
    parts = fit.select(
        "record_id", "ord", "year", "citation_count",
        telling_words(F.col("title")).alias("words"),
        (F.length(F.coalesce("abstract", F.lit(""))) >= 200).cast("int").alias("told"),
        F.coalesce(b["scope_match"], F.lit(0.0)).alias("scope"),
        F.coalesce(b["relevance"], F.lit(0.0)).alias("relevance"),
        (F.coalesce(b["primary_scope_match"], F.lit(1.0)) > 0).alias("primary"),
    )
    # Papers and texts are read once here: years and rounds need only what is written.
    left = written(parts, "candidates")
    ends = left.agg(F.min("year").alias("low"), F.max("year").alias("high"), F.count_if(~F.col("primary")).alias("others")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    score = F.log1p(F.col("citation_count").cast("double")) + 0.75 * (high - F.col("year")) / max(high - low, 1) + 0.75 * F.col("told") + 0.5 * F.col("scope") + 0.25 * F.col("relevance")
    left = left.select("record_id", "ord", "words", score.alias("score"), "primary")
    chosen: list[str] = []
    ords: list[int] = []

    def take(tier: Column, limit: int) -> None:
        nonlocal left
        while len(chosen) < limit:
            best = left.where(tier).agg(F.max_by(F.struct("record_id", "ord", "words"), F.struct("score", -F.col("ord"))).alias("b")).first()["b"]
            if best is None:
                return
            chosen.append(best["record_id"])
            ords.append(best["ord"])
            words = F.array(*[F.lit(w) for w in best["words"]]).cast("array<string>")
            shared = F.size(F.array_intersect("words", words)) / F.least(F.size("words"), F.lit(len(best["words"])))
            left = left.where((F.col("record_id") != best["record_id"]) & ~((F.size("words") > 0) & F.lit(bool(best["words"])) & (F.coalesce(shared, F.lit(0.0)) >= 0.8)))

    take(F.col("primary"), reserve - min(ends["others"], max(1, reserve // 4)))
    take(~F.col("primary"), reserve)
    take(F.lit(True), reserve)
    if not chosen:
        return papers.withColumn("place", F.lit(0)).limit(0)
    # At most eight places, as literals; ord is what scores are joined by, so both sides are cut down before the join.
    place = F.array_position(F.array(*[F.lit(c) for c in chosen]), F.col("record_id"))
    own = F.coalesce("quality_flags", F.array().cast("array<string>")) if "quality_flags" in papers.columns else F.array().cast("array<string>")
    found = papers.where(F.col("ord").isin(ords) & F.col("record_id").isin(chosen)).withColumn("place", (place - 1).cast("int")).withColumn("quality_flags", F.array_union(own, F.array(F.lit(FOUNDATIONAL))))
    return found.orderBy("place")


def evidence_order(papers: DataFrame, foundational_ids: DataFrame, fulltext: DataFrame, key: Column, target: int) -> DataFrame:
    """Foundational papers, then those with full text, then the rest; a key once, ``target`` in all."""
    marked = papers.join(foundational_ids.select("record_id", F.lit(0).alias("__a")), "record_id", "left").join(fulltext.select("record_id", F.lit(1).alias("__b")).distinct(), "record_id", "left")
    placed = marked.withColumn("place", F.coalesce("__a", "__b", F.lit(2))).withColumn("__key", key)
    rows = F.struct(*[F.col(c) for c in placed.columns])
    first = placed.groupBy("__key").agg(F.min_by(rows, F.struct("place", "ord")).alias("r")).select("r.*")
    return first.orderBy("place", "ord").limit(target).drop("__a", "__b", "__key")


def with_evidence(papers: DataFrame, cards: DataFrame, target: int) -> DataFrame:
    return papers.join(cards.select("record_id").distinct(), "record_id", "left_semi").orderBy("ord").limit(target)


