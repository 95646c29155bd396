"""Iterative expansion of a citation graph with a saturation stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.components import settled


def step(seeds: DataFrame, edges: DataFrame, seen: DataFrame, *, per_seed_back: int, per_seed_forward: int) -> DataFrame:
    """New nodes one edge from ``seeds`` (node), both ways, so many a seed; ``edges`` is (citing, cited)."""
    first = lambda key, other: Window.partitionBy(key).orderBy(other)
    back = edges.join(seeds.select(F.col("node").alias("citing")), "citing", "left_semi").withColumn("k", F.row_number().over(first("citing", "cited"))).where(F.col("k") <= per_seed_back).select(F.col("cited").alias("node"))
    forward = edges.join(seeds.select(F.col("node").alias("cited")), "cited", "left_semi").withColumn("k", F.row_number().over(first("cited", "citing"))).where(F.col("k") <= per_seed_forward).select(F.col("citing").alias("node"))
    return back.unionByName(forward).distinct().join(seen.select("node"), "node", "left_anti")


def expand(start: DataFrame, edges: DataFrame, *, rounds: int, seeds_each: int, pool: int, threshold: float, per_seed_back: int = 100, per_seed_forward: int = 50, rank: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, list[dict]]:
    """Nodes with the round that found them, and a log of the rounds.

    ``start`` has (node, score); each round expands the best nodes not expanded
    yet and stops when few of the best ``pool`` are new.
    """
    ranked = rank or (lambda df: df)
    found = settled(ranked(start.select("node", "score").withColumn("round", F.lit(0))))
    expanded = None
    log: list[dict] = []
    for n in range(1, rounds + 1):
        open_ = found if expanded is None else found.join(expanded, "node", "left_anti")
        seeds = settled(open_.orderBy(F.desc("score"), "node").limit(seeds_each).select("node"))
        if seeds.isEmpty():
            break
        new = step(seeds, edges, found, per_seed_back=per_seed_back, per_seed_forward=per_seed_forward).select("node", F.lit(0.0).alias("score"), F.lit(n).alias("round"))
        before = found.count()
        found = settled(ranked(found.unionByName(new)))
        expanded = seeds if expanded is None else settled(expanded.unionByName(seeds))
        fresh = found.orderBy(F.desc("score"), "node").limit(pool).where(F.col("round") == n).count()
        ratio = fresh / max(min(before, pool), 1)
        log.append({"round": n, "before": before, "after": found.count(), "ratio": ratio})
        if ratio < threshold:
            break
    return found, log
