"""Line deduplication by winnowing over line hashes.

A text is the sequence of its lines that have words. Every shortest run of
consecutive lines with ``min_words`` words or more, forwards from a line or back
to it, is a window; of each window the rightmost least line hash is selected.
Equal windows select the same line, so a repeated run of that many words has
selected positions in common wherever it occurs: guaranteed fingerprints. A
position is emitted once, however many windows select it, and positions are
joined on the line hash; those whose hash no other position has go no further.

A match is then extended from its line both ways: to the left as far as each
window that selected it reaches, and to the right. Runs that are equal line by
line, from the selected position to both ends, have equal hashes, so the
earliest text with a run is found by an aggregate and not by comparing all
texts that share a line. The windows that end a repeated run on either
side select positions of their own, so extensions cover the whole of it.
Of equal runs the earliest, by doc_id, text hash and position, stays; the
lines of later ones are deleted, blank lines inside them too.

Lines are equal if their words ``[^\\x20\\x09-\\x0D]+`` are, by 64-bit hashes.
Counts are combined before they are shuffled, and positions and runs meet their
key under a salt, so a line or run in very many texts is spread out.

Results: null texts stay null and empty ones empty; rows without a doc_id stay
as they are; rows of equal doc_id and text count as one document and are
treated alike, rows of equal doc_id with other texts are documents each; other
columns pass through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rowed, salted_join, unrowed, written
from .decontaminate import TWO, as_spans, merged

POSITIONS = "doc_id {kind}, copy long, print long, runs array<struct<run: long, first: int, last: int>>"
RUNS = pa.list_(pa.struct([("run", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))


def windows_of(sizes: list[int], least: int) -> list[tuple[int, int]]:
    """Shortest runs (first, last) of at least ``least`` words, forwards and backwards."""
    found: list[tuple[int, int]] = []
    n, j, total = len(sizes), 0, 0
    for i in range(n):
        while j < n and total < least:
            total += sizes[j]
            j += 1
        if total < least:
            break
        found.append((i, j - 1))
        total -= sizes[i]
    i = total = 0
    for j in range(n):
        total += sizes[j]
        while total - sizes[i] >= least:
            total -= sizes[i]
            i += 1
        if total >= least:
            found.append((i, j))
    return list(dict.fromkeys(found))


def selected(hashes: list[int], windows: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """The rightmost least hash of each window: position to the windows that select it."""
    found: dict[int, list[tuple[int, int]]] = {}
    for i, j in windows:
        least = min(hashes[i : j + 1])
        at = j
        while hashes[at] != least:
            at -= 1
        found.setdefault(at, []).append((i, j))
    return found


def fingerprints(text: str, least: int) -> Iterator[tuple[int, list[dict]]]:
    """(line hash, runs around it as hash and raw lines) of each selected position of a text."""
    raw, sizes, hashes = [], [], []
    for k, line in enumerate(text.encode().split(b"\n")):
        words = line.split()
        if words:
            raw.append(k)
            sizes.append(len(words))
            hashes.append(xxhash.xxh64_intdigest(b" ".join(words)))
    if sum(sizes) < least:
        return
    packed = np.array(hashes, dtype=np.uint64)
    bytes_ = packed.tobytes()
    signed = packed.view(np.int64).tolist()
    for at, windows in selected(signed, windows_of(sizes, least)).items():
        runs = []
        for i, j in windows:
            # The run's lines and the place of the selected line in it.
            key = xxhash.xxh64_intdigest(bytes_[8 * i : 8 * j + 8], seed=at - i)
            runs.append({"run": key - (1 << 64) if key >> 63 else key, "first": raw[i], "last": raw[j]})
        yield signed[at], runs


def positions(docs: DataFrame, min_words: int) -> DataFrame:
    """The selected positions of ``docs`` (doc_id, copy, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            at, prints, runs = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for line, around in fingerprints(text, min_words) if text else ():
                    at.append(k)
                    prints.append(line)
                    runs.append(around)
            whose = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(whose), batch.column("copy").take(whose), pa.array(prints, pa.int64()), pa.array(runs, RUNS)], names=["doc_id", "copy", "print", "runs"])

    return docs.mapInArrow(batches, POSITIONS.format(kind=kind))


def repeated_runs(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """doc_id, copy (hash of the text) and the raw line spans (end exclusive) of its later repeated runs."""
    own = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("copy"), "text")
    places = written(positions(own, min_words), "positions")
    shared = places.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    runs = salted_join(places, shared, ["print"], ["doc_id", "copy", "runs"]).select("doc_id", "copy", "print", F.explode("runs").alias("r")).select("doc_id", "copy", "print", "r.*")
    key = ["print", "run"]
    origins = runs.groupBy(*key).agg(F.min(F.struct("doc_id", "copy", "first")).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = salted_join(runs, origins, key, ["doc_id", "copy", "first"]).where(F.struct("doc_id", "copy", "first") != F.col("origin"))
    span = F.struct(F.col("first").cast("long").alias("start"), (F.col("last") + 1).cast("long").alias("end"))
    return later.groupBy("doc_id", "copy").agg(F.collect_set(span).alias("spans"))


def cleaned(docs: DataFrame, min_words: int) -> DataFrame:
    """row (the columns but the text), text without later repeats and removed (the deleted line spans, merged)."""
    runs = repeated_runs(docs, min_words=min_words)
    runs = runs.select(F.struct("doc_id", "copy").alias("key"), "spans")
    keyed = docs.select(rowed(docs), "text", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("copy"))).alias("key"))
    joined = keyed.join(runs.hint("shuffle_hash"), "key", "left").select("row", "text", "spans")
    out = keyed.select("row", "text", F.array().cast(TWO).alias("removed")).schema

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            spans = batch.column("spans").to_pylist()
            removed = [merged([(s["start"], s["end"]) for s in mine or ()]) for mine in spans]
            texts = batch.column("text")
            if any(removed):
                shown = texts.to_pylist()
                for k, gone in enumerate(removed):
                    if gone:
                        lines = shown[k].split("\n")
                        kept = [lines[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(lines)], strict=True)]
                        shown[k] = "\n".join(line for part in kept for line in part)
                texts = pa.array(shown, texts.type)
            yield pa.RecordBatch.from_arrays([batch.column("row"), texts, as_spans(removed)], names=["row", "text", "removed"])

    return joined.mapInArrow(batches, out)


def dedup_lines(docs: DataFrame, *, min_words: int = 50, length: str | None = None, drop_emptied: bool = False) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) with ``text`` cleaned, same columns.

    ``length`` names a column that gets the new length where a text changed;
    with ``drop_emptied`` rows go of which deletion leaves no words.
    """
    found = cleaned(docs, min_words)
    changed = F.size("removed") > 0
    if drop_emptied:
        found = found.where(~changed | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    fresh = {}
    if length in docs.columns:
        fresh[length] = F.when(changed, F.length("text").cast(docs.schema[length].dataType)).otherwise(F.col("row").getField(length)).alias(length)
    return found.select(*[fresh.get(c, v) for c, v in zip(docs.columns, unrowed(docs), strict=True)])


def line_report(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """doc_id, cleaned text, n_lines, n_removed and removed spans (start:end, end exclusive) per document."""
    found = cleaned(docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), "text"), min_words)
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    shown = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("row.doc_id", "text", F.greatest("row.n_lines", F.lit(0)).alias("n_lines"), total.alias("n_removed"), shown.alias("removed_lines"))
