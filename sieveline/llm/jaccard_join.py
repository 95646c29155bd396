"""N-gram Jaccard self-join by chosen paths.

A document is its set of shingles (five words; all words of a shorter text).
In each run a path starts empty and is extended token by token: of a set's
tokens those are chosen whose hash under the path is below 1 / (similarity x
set size), the same for every set, so sets that share much follow the same
paths. Sets at the end of a path of ``first`` tokens are a bucket, and buckets that share a set
are a group. A group of ``bucket`` sets or fewer is compared by brute force; a larger
one is split recursively by the paths one token longer, until ``levels``
tokens are shared. Groups are disjoint, so a pair is compared once. Runs are
repeated until a pair at the threshold shares a path of ``levels`` tokens with
probability ``recall``, also where one set contains the other.

What is still larger then is mostly one cluster of different near copies,
where the links themselves are quadratic. Its sets are dealt into chunks, sets
with the same least path together, and those pairs of chunks are compared, in tasks of
their own, that share a path; no pair is emitted: tasks return counts of links and one edge
per linked set. Equal sets are collapsed into classes first, so copies cost one row each.

Results: one row per input row. Texts without words and rows without a doc_id
link to nothing and are classes of their own; repeated rows and equal texts
link to each other; other columns are ignored, whatever their names; an empty
table gives no rows. Of rows with equal doc_id but different texts, each is a
document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, heavy_keys, rowed, salted_join, unrowed, written
from .graph import components

STEP = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, ``bound`` of them kept."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(raw: bytes, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = raw.split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(w))
    total = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        total = total * BASE + w[k : len(w) - n + 1 + k]
    return np.unique(mix(total))


def chosen_paths(tokens: np.ndarray, runs: int, levels: int, similarity: float, seed: int = 1) -> list[np.ndarray]:
    """The paths of a set over all runs: those of one token, of two and so on."""
    limit = np.uint64(min(2**64 - 1, int(2.0**64 / (similarity * len(tokens)))))
    paths = mix((np.arange(1, runs + 1, dtype=np.uint64) + np.uint64(seed << 20)) * STEP)
    block = max(1, (1 << 20) // len(tokens))
    found = []
    for _ in range(levels):
        nexts = []
        for at in range(0, len(paths), block):
            # Tokens are hashes; a path is their random odd multiplier.
            drawn = (paths[at : at + block, None] | np.uint64(1)) * tokens[None, :]
            rows, cols = np.nonzero(drawn < limit)
            nexts.append(mix(paths[at : at + block][rows] * STEP + tokens[cols]))
        paths = np.unique(np.concatenate(nexts)) if nexts else paths
        found.append(paths)
    return found


def runs_for(recall: float, similarity: float, levels: int) -> int:
    """Runs until a pair at the threshold is found with probability ``recall``.

    A pair of sizes a <= b shares at least similarity x b tokens where the
    smaller is contained in the larger, the worst case, and the larger set's
    limit counts: one shared chosen token a path is expected at least.
    """
    found = 1.0
    for _ in range(levels):
        found = 1 - math.exp(-found)
    return math.ceil(math.log(1 - recall) / math.log(1 - found))


def sketched(docs: DataFrame, size: int, similarity: float, runs: int, first: int, levels: int) -> DataFrame:
    """doc_id, copy (hash of the text), set (hash of the shingle set; null: none), n and the paths by length, from ``first``: p2, p3 and so on."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"p{k}" for k in range(first, levels + 1)]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in rows:
            keys, ns = [], []
            paths: list[list] = [[] for _ in names]
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                s = shingles(raw or b"", hashes, size)
                keys.append(int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)) if len(s) else None)
                ns.append(len(s))
                for out, mine in zip(paths, chosen_paths(s, runs, levels, similarity)[first - 1 :] if len(s) else [np.empty(0, np.uint64)] * len(names), strict=True):
                    out.append(mine.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(keys, pa.int64()), pa.array(ns, pa.int32()), *[pa.array(p, pa.list_(pa.int64())) for p in paths]], names=["doc_id", "copy", "set", "n", *names])

    return docs.select("doc_id", F.xxhash64("text").alias("copy"), "text").mapInArrow(batches, f"doc_id {kind}, copy long, set long, n int, " + ", ".join(f"{n} array<long>" for n in names))


def linked(sets: list[np.ndarray], sides: np.ndarray | None, similarity: tuple[int, int]) -> np.ndarray:
    """Which pairs have the similarity (a fraction), as a symmetric matrix; ``sides``: only across."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    ids, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes.astype(int))
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[place]
    rows, cols = owner[keep], column[place[keep]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    both = np.zeros((m, m), dtype=np.float32)
    width = 4096
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(cols, [at, at + width])
        block = np.zeros((m, width), dtype=np.float32)
        block[rows[a:b], cols[a:b] - at] = 1
        both += block @ block.T
    union = sizes[:, None] + sizes[None, :] - both
    near = similarity[1] * both.astype(np.float64) >= similarity[0] * union
    np.fill_diagonal(near, False)
    if sides is not None:
        near &= sides[:, None] != sides[None, :]
    return near


def least_linked(near: np.ndarray) -> np.ndarray:
    """The least index that each row is joined to within the matrix, through any links."""
    label = np.arange(len(near))
    while True:
        best = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def compare_groups(rows: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """(node, links, root) of each group (comp, a, b) of ``rows``, sorted by group and node."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sides, weights, sets, out = None, [], [], [], [], []

        def close() -> None:
            if len(nodes) > 1:
                across = np.array(sides) if key[1] != key[2] else None
                near = linked(sets, across, similarity)
                links = near @ np.array(weights, dtype=np.int64)
                root = least_linked(near)
                out.extend((nodes[i], int(links[i]), nodes[root[i]]) for i in np.flatnonzero(links))
            for x in (nodes, sides, weights, sets):
                x.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "links", "root"])

        for part in parts:
            for comp, a, b, side, node, weight, raw in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if (comp, a, b) != key:
                    close()
                    key = (comp, a, b)
                if nodes and nodes[-1] == node:  # a repeated row
                    continue
                nodes.append(node)
                sides.append(side)
                weights.append(weight)
                sets.append(np.frombuffer(raw, np.uint64))
            if len(out) > 10_000:
                yield flush()
        close()
        if out:
            yield flush()

    return rows.mapInArrow(batches, "node long, links long, root long")


def bucket_groups(ends: DataFrame, total: int) -> DataFrame:
    """(node, root): the groups of sets that buckets join, from ``ends`` (node, path), ``total`` rows."""
    shared = ends.groupBy("path").agg(F.min("node").alias("hub"), F.max("node").alias("far"), F.count("*").alias("rows")).where("hub <> far")
    hubs = written(shared.select("path", "hub", "rows"), "hubs")
    met = heavy_join(ends, hubs.drop("rows"), "path", heavy_keys(hubs, "path", "rows", total))
    return components(met.select(F.col("node").alias("u"), F.col("hub").alias("v")))


def chunks_on_paths(sets: DataFrame, chunked: DataFrame) -> DataFrame:
    """(path, root, own): the paths that lead to each chunk, from ``sets`` (node, paths) and ``chunked`` (node, root, own).

    A set meets its chunk as one row, and its paths are unfolded after that.
    """
    return sets.join(chunked.select("node", "root", "own"), "node").select("root", "own", F.explode("paths").alias("path")).distinct()


def groups_to_compare(sketch: DataFrame, classes: DataFrame, *, first: int, levels: int, bucket: int, bucket_tokens: int) -> DataFrame:
    """node, doc_id, copy, weight, group, own (chunk) and pairs (of chunks) of each set that shares a bucket.

    ``sketch`` and ``classes`` are written tables.
    """
    whose = classes.select(F.col("set").alias("node"), "doc_id", "copy", "weight", "n")
    mine = sketch.where(F.col("doc_id").isNotNull() & F.col("set").isNotNull())
    one = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    found = None
    for level in range(first, levels + 1):
        ends = mine.select(F.col("set").alias("node"), F.explode(f"p{level}").alias("path"))
        total = mine.agg(F.coalesce(F.sum(F.size(f"p{level}")), F.lit(0))).first()[0]
        groups = written(bucket_groups(ends, int(total)).join(whose, "node"), f"groups{level}")
        parts = F.ceil(F.greatest(F.count("*") / bucket, F.sum("n") / bucket_tokens)).cast("int")
        sizes = groups.groupBy("root").agg(parts.alias("chunks"))
        dealt = written(salted_join(groups, sizes, ["root"], ["node"]), f"dealt{level}")
        small = dealt.where("chunks = 1").select("node", "doc_id", "copy", "weight", F.xxhash64(F.lit(level), "root").alias("group"), F.lit(0).alias("own"), one.alias("pairs"))
        found = small if found is None else found.unionByName(small)
        large = dealt.where("chunks > 1")
        if large.isEmpty():
            return found
        # One row for each set goes on.
        mine = mine.join(large.select("doc_id", "copy"), ["doc_id", "copy"], "left_semi").dropDuplicates(["doc_id", "copy"])
        mine = written(mine.select("doc_id", "copy", "set", *[f"p{k}" for k in range(min(level + 1, levels), levels + 1)]), f"sketch{level}")
    leads = mine.select(F.col("set").alias("node"), F.array_min(f"p{levels}").alias("lead"))
    led = large.join(leads, "node")
    many = led.groupBy("root", "lead").agg(F.ceil(F.count("*") / bucket).cast("int").alias("parts"))
    led = salted_join(led, many, ["root", "lead"], ["node"])
    own = F.pmod(F.xxhash64("lead", F.pmod(F.xxhash64("node"), F.col("parts"))), F.col("chunks")).cast("int")
    chunked = written(led.select("node", "doc_id", "copy", "weight", "root", own.alias("own")), "chunks")
    # Pairs of chunks that share a path; a set's own chunk is compared with itself too.
    meet = chunks_on_paths(mine.select(F.col("set").alias("node"), F.col(f"p{levels}").alias("paths")), chunked)
    chunks = meet.groupBy("root", "path").agg(F.collect_set("own").alias("c")).where(F.size("c") > 1).select("root", F.array_sort("c").alias("c")).distinct()
    pairs = chunks.select("root", "c", F.explode("c").alias("a")).select("root", "a", F.explode("c").alias("b")).where("a < b").distinct()
    sides = pairs.select("root", F.col("a").alias("own"), "a", "b").unionByName(pairs.select("root", F.col("b").alias("own"), "a", "b")).unionByName(chunked.select("root", "own", F.col("own").alias("a"), F.col("own").alias("b")).distinct())
    listed = sides.groupBy("root", "own").agg(F.collect_set(F.struct("a", "b")).alias("pairs"))
    return found.unionByName(chunked.join(listed, ["root", "own"]).select("node", "doc_id", "copy", "weight", F.xxhash64(F.lit(0), "root").alias("group"), "own", "pairs"))


def with_sets(rows: DataFrame, size: int) -> DataFrame:
    """The shingle sets (tokens) of the texts of ``rows``."""
    kept = ["node", "weight", "group", "own", "pairs"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts:
            blobs = [shingles(raw or b"", hashes, size).tobytes() for raw in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(blobs, pa.binary())], names=[*kept, "tokens"])

    rows = rows.select("text", *kept)
    return rows.mapInArrow(batches, rows.select(*kept, F.lit(b"").alias("tokens")).schema)


def set_classes(docs: DataFrame, *, size: int, similarity: tuple[int, int], recall: float, first: int, levels: int, bucket: int, bucket_tokens: int) -> DataFrame:
    """doc_id, copy, set_id, class_id, class_copy and n_links of every row of ``docs`` (doc_id, text)."""
    share = similarity[0] / similarity[1]
    # Without a doc_id or words nothing links.
    sketch = written(sketched(docs, size, share, runs_for(recall, share, levels), first, levels), "sketch")
    real = sketch.where(F.col("doc_id").isNotNull() & F.col("set").isNotNull())
    by_set = real.groupBy("set").agg(F.min(F.struct("doc_id", "copy")).alias("rep"), F.count("*").alias("weight"), F.first("n").alias("n"))
    # From here a class is its set hash.
    classes = written(by_set.select("set", "rep.doc_id", "rep.copy", "weight", "n"), "classes")
    dealt = groups_to_compare(sketch, classes, first=first, levels=levels, bucket=bucket, bucket_tokens=bucket_tokens)
    texts = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text").join(dealt.hint("shuffle_hash"), ["doc_id", "copy"])
    rows = with_sets(texts, size).select("group", F.explode("pairs").alias("pair"), "own", "node", "weight", "tokens").select("group", "pair.a", "pair.b", "own", "node", "weight", "tokens")
    rows = rows.repartition("group", "a", "b").sortWithinPartitions("group", "a", "b", "node")
    links = written(compare_groups(rows, size, similarity), "links")
    totals = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = roots.join(classes.select(F.col("set").alias("node"), F.struct("doc_id", "copy").alias("rep")), "node")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    found = salted_join(named, least, ["root"], ["node"]).join(totals, "node").select(F.col("node").alias("set"), "least", "links")
    own = F.struct("doc_id", "copy")
    labels = classes.join(found, "set", "left").select("set", F.col("doc_id").alias("set_id"), F.coalesce("least", own).alias("least"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    rows = real.select("doc_id", "copy", "set")
    linked_rows = heavy_join(rows, labels, "set", heavy_keys(classes, "set", "weight", sketch.count())).select("doc_id", "copy", "set_id", F.col("least.doc_id").alias("class_id"), F.col("least.copy").alias("class_copy"), "n_links")
    alone = sketch.where(F.col("doc_id").isNull() | F.col("set").isNull()).select("doc_id", "copy", F.col("doc_id").alias("set_id"), F.col("doc_id").alias("class_id"), F.col("copy").alias("class_copy"), F.lit(0).cast("long").alias("n_links"))
    return linked_rows.unionByName(alone)


OPTIONS = {"size": 5, "similarity": (4, 5), "recall": 0.9999, "first": 2, "levels": 3, "bucket": 1024, "bucket_tokens": 1_000_000}


def jaccard_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, set_id, class_id and n_links of every row of ``docs`` (doc_id, text); ``options`` as in OPTIONS.

    ``set_id`` is the least doc_id with the same shingles, ``class_id`` the
    least doc_id that links lead to, ``n_links`` the number of other rows with
    the similarity (a fraction) or more, copies included.
    """
    return set_classes(docs, **OPTIONS | options).drop("copy", "class_copy")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each class: that of the least doc_id, then text hash.

    Rows of equal doc_id and text count as one document; a row with another
    text is another document, whatever its doc_id.
    """
    found = set_classes(docs, **OPTIONS | options)
    other = (F.col("doc_id") != F.col("class_id")) | (F.col("copy") != F.col("class_copy"))
    gone = found.where(other).select(F.struct("doc_id", "copy").alias("key")).distinct()
    keyed = docs.select(rowed(docs), "text", F.struct("doc_id", F.xxhash64("text").alias("copy")).alias("key"))
    return keyed.join(gone, "key", "left_anti").select(*unrowed(docs))
