"""Connected components of an edge table (u, v: long): contraction inside tasks, then alternating star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, salted_join


def _settled(edges: DataFrame) -> bool:
    """Whether every edge (u, v) leads from a node with no other edge to a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    per = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return per.where("out > 1 OR (out > 0 AND least = 0)").isEmpty()


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, sorted, and the least node of each one's component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


def contracted(edges: DataFrame, *, held: int) -> DataFrame:
    """Edges with the same components, fewer: each task joins what it has, up to ``held`` edges at a time, and returns one edge for each node that isn't a root there."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, size = [], [], 0

        def joined() -> pa.RecordBatch:
            nodes, roots = least_of(np.concatenate(us), np.concatenate(vs))
            inner = nodes != roots
            us.clear()
            vs.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(roots[inner])], names=["u", "v"])

        for part in parts:
            us.append(part.column("u").to_numpy())
            vs.append(part.column("v").to_numpy())
            size += part.num_rows
            if size >= held:
                yield joined()
                size = 0
        if us:
            yield joined()

    return edges.mapInArrow(batches, "u long, v long")


def components(edges: DataFrame, *, rounds: int = 60, held: int = 100_000) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is the least node of its component.

    Edges are first contracted in chunks of ``held``, a task each, which leaves at most an edge
    for each node and chunk. Rounds then join every larger neighbour to the least one (large star),
    then every smaller neighbour (small star). Minima are combined before
    they are shuffled, the number of edges doesn't grow, and the edges of a
    node with very many neighbours meet their minimum in several tasks.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = checkpoint(pairs)
    edges = checkpoint(contracted(edges.coalesce(1 + edges.count() // held), held=held).distinct())
    for _ in range(rounds):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, least, ["u"], ["v"], salts=8).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Here u is the larger end: it has few neighbours after the large star.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select("u", F.col("m").alias("v")).unionByName(met.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))).distinct()
        edges = checkpoint(small)
    else:
        raise RuntimeError(f"components unsettled after {rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(own.join(roots.select("node"), "node", "left_anti"))
