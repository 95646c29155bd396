"""Papers expanded by citations, round by round, under one budget.

A round takes the best papers not expanded yet as seeds (at most 30). Half of
what is left of the budget goes backward, to what the seeds cite, in the order of
seeds and references; the rest goes forward, to what cites them: so many
works a seed, seed by seed, until the budget is met. All of it is merged with the papers,
ranked anew and cut, and what was new counts against the budget. Rounds end
when few of the best papers are new.

``works`` stands for the service: everything that can be looked up, with
``source_ids`` (of which ``openalex`` is an address or a bare identifier),
``referenced_work_ids`` (bare) and ``ord``, the order of its answers. It is scanned once a round for
each direction, filtered by the seeds' identifiers as literals; of the works that cite a
seed the first few are found by a top-k for each seed before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.components import written
from sieveline.spec import SearchSpec

#: References of a seed that are looked up, and works of a round found by them.
REFERENCES, BACKWARD = 100, 500
#: Fewest and most works that cite a seed.
FORWARD = (10, 50)


@dataclass(frozen=True)
class Share:
    """What a round may look up."""

    backward: int
    forward_each: int
    total: int


def share(remaining: int, seeds: int, references: int) -> Share:
    """How the ``remaining`` budget is dealt over a round."""
    return Share(min(remaining // 2 or remaining, references, BACKWARD), min(FORWARD[1], max(FORWARD[0], remaining // max(seeds, 1))), remaining)


def bare(address: Column) -> Column:
    """The identifier at the end of an address."""
    return F.element_at(F.split(address, "/"), -1)


def work_id(df: DataFrame) -> Column:
    return bare(F.element_at(df["source_ids"], F.lit("openalex")))


def backward(works: DataFrame, ids: list[str], limit: int) -> DataFrame:
    """The first ``limit`` known works of ``ids``, with ``place`` (by their order there)."""
    order = F.array_position(F.array(*[F.lit(i) for i in ids]), work_id(works)) if ids else F.lit(0)
    found = works.where(work_id(works).isin(ids)).withColumn("place", order.cast("long"))
    return found.orderBy("place", "ord").limit(limit)


def forward(works: DataFrame, seeds: list[str], limits: Share, taken: int) -> DataFrame:
    """Works that cite the seeds, with ``place``: of each seed the first by ord, seeds in turn while fewer than the budget are found."""
    if not seeds:
        return works.limit(0).withColumn("place", F.lit(0).cast("long"))
    listed = F.array(*[F.lit(s) for s in seeds])
    citing = works.where(F.arrays_overlap("referenced_work_ids", listed)).select(F.col("ord").alias("__at"), F.explode(F.array_intersect("referenced_work_ids", listed)).alias("__seed"))
    first = citing.withColumn("__k", F.row_number().over(Window.partitionBy("__seed").orderBy("__at"))).where(F.col("__k") <= limits.forward_each)
    chosen = first.withColumn("__s", F.array_position(listed, F.col("__seed")).cast("long"))
    # At most 30 seeds and 50 works each from here.
    counts = chosen.groupBy("__s").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + taken
    open_ = counts.withColumn("__before", before).where(F.col("__before") < limits.total).select("__s")
    kept = chosen.join(F.broadcast(open_), "__s").select("__at", (F.col("__s") * 1000 + F.col("__k")).alias("place"))
    return works.join(F.broadcast(kept), works["ord"] == kept["__at"]).drop("__at")


def expand(papers: DataFrame, works: DataFrame, limits: SearchSpec, *, merge: Callable[[DataFrame], DataFrame], rank: Callable[[DataFrame], DataFrame], key: Callable[[DataFrame], Column], until_saturated: bool = True) -> tuple[DataFrame, dict]:
    """``papers`` (with ``ord``, their rank) expanded, and what happened.

    ``merge`` makes records one by their order ``ord``; ``rank`` orders the
    merged ones: it returns at most ``limits.max_candidates``, with ``ord`` anew; ``key`` is the key by which a
    paper is known. ``works`` has the columns of ``papers``. Without ``until_saturated`` all rounds are made, saturated or not.
    """
    if limits.citation_seeds == 0 or limits.max_expansion == 0:
        return papers, {"status": "skipped", "saturation_reached": False, "rounds": []}
    columns = papers.columns
    current, works = papers, works.select(*columns)
    expanded: list[str] = []
    added, log, saturated = 0, [], False
    for n in range(1, limits.citation_rounds + 1):
        own = F.element_at("source_ids", F.lit("openalex"))
        seeds = current.where(own.isNotNull() & (own != "") & ~own.isin(expanded)).dropDuplicates(["ord"]).orderBy("ord").limit(limits.citation_seeds).select(own.alias("id"), F.slice(F.coalesce("referenced_work_ids", F.array().cast("array<string>")), 1, REFERENCES).alias("refs")).collect()
        if not seeds:
            log.append({"round": n, "status": "no_new_seeds", "new_records": 0})
            break
        expanded += [s.id for s in seeds]
        remaining = max(0, limits.max_expansion - added)
        if remaining == 0:
            break
        ids = list(dict.fromkeys(r for s in seeds for r in s.refs))
        dealt = share(remaining, len(seeds), len(ids))
        back = written(backward(works, ids, dealt.backward), "backward")
        n_back = back.count()
        ahead = written(forward(works, [s.id.rsplit("/", 1)[-1] for s in seeds], dealt, n_back), "forward")
        before = current.count()
        base = current.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0] + 1
        moved = lambda df, start: df.withColumn("ord", F.col("place") + start).select(*columns)
        joined = written(merge(current.unionByName(moved(back, base)).unionByName(moved(ahead, base + 1_000_000))), "expanded")
        new = max(0, joined.count() - before)
        added += new
        known = current.select(key(current).alias("__key")).distinct()
        current = written(rank(joined), "reranked")
        pool = current.orderBy("ord").limit(limits.screening_pool)
        fresh = pool.select(key(pool).alias("__key")).join(known, "__key", "left_anti").count()
        ratio = fresh / max(min(before, limits.screening_pool), 1)
        log.append({"round": n, "status": "ok", "seed_count": len(seeds), "backward_records": n_back, "forward_records": ahead.count(), "new_unique_records": new, "new_relevant_records_in_screening_pool": fresh, "new_relevant_ratio": round(ratio, 6)})
        saturated = ratio < limits.saturation_ratio
        if saturated and until_saturated:
            break
    return current, {"status": "ok", "records_added": added, "saturation_reached": saturated, "rounds": log}


def reordered(ranked: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` of ``ranked`` in an order, with ``ord`` their rank; k is a limit of the specification (20,000 at most)."""
    first = ranked.orderBy(*order).limit(k)
    return first.withColumn("ord", F.row_number().over(Window.orderBy(*order)).cast("long"))
