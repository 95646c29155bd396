"""Benchmark decontamination with one Aho-Corasick automaton.

Items are lower-cased (A-Z only) and cut into words; every window of
``window`` consecutive words (all words of a shorter item) is a pattern. A
document is normalised the same way, byte by byte, and scanned once; matches
are mapped to word positions and, on request, to character offsets of the
original text. The automaton reads words as codes of three letters, one of each
of three alphabets, so a match can't begin or end inside a word, and its size
depends on the number of windows and not on the length of words.

The items are the small side, but nothing relies on that: they are dealt into
blocks by hash, so that a block has ``block_words`` words in expectation (about
1.5 KB of automaton a word), with one automaton and one scan each; the spans of the blocks are
merged row by row. Only a block at a time is sent from the driver, and between
blocks the rows are written, so a task has one worker and one automaton at any number of blocks.

Results: null and empty texts have no words and no hits; items without words
have no windows; equal windows of several items count for each; repeated
rows are judged each; rows without a doc_id are judged like any other; other
columns are ignored, whatever their names; empty tables give no rows or no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, rowed, unrowed, write_table

#: Bytes of UTF-8 to normal form: letters and digits stay, in lower case, as do bytes outside ASCII; others part words.
NORMAL = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


def patterns(items: list[tuple], window: int) -> dict[tuple[bytes, ...], list]:
    """Each window with its items."""
    found: dict[tuple[bytes, ...], list] = {}
    for item, text in items:
        words = words_of(text.encode()) if text else []
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            owners = found.setdefault(tuple(words[i : i + n]), [])
            if item not in owners:
                owners.append(item)
    return found


#: Letters in an alphabet; three of them make a code. A letter of the first alphabet alone is a word of no item.
BASE = 128
UNKNOWN = chr(0x0FF) * 3


def code_of(number: int) -> str:
    return chr(0x100 + number // (BASE * BASE)) + chr(0x200 + number // BASE % BASE) + chr(0x300 + number % BASE)


class Machine:
    """The automaton of some items."""

    def __init__(self, items: list[tuple], window: int):
        import ahocorasick

        self.codes: dict[bytes, str] = {}
        self.built = ahocorasick.Automaton()
        for words, owners in patterns(items, window).items():
            for word in words:
                if word not in self.codes:
                    self.codes[word] = code_of(len(self.codes))
            self.built.add_word("".join(map(self.codes.__getitem__, words)), (len(words), owners))
        if len(self.built):
            self.built.make_automaton()

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, list]]:
        """(first word, end, items) of each match, by end."""
        if len(self.built) and words:
            line = "".join([self.codes.get(word, UNKNOWN) for word in words])
            for last, (n, items) in self.built.iter(line):
                yield last // 3 + 1 - n, last // 3 + 1, items


#: The items last seen in this worker process, held so that they are told from later ones, and their automaton.
_BUILT: list[tuple] = []


def built_once(items: Broadcast, window: int) -> Machine:
    """One automaton at a time for each worker process."""
    if not _BUILT or _BUILT[0][0] is not items.value or _BUILT[0][1] != window:
        _BUILT.clear()
        _BUILT.append((items.value, window, Machine(items.value, window)))
    return _BUILT[0][2]


def scan(raw: bytes, machine: Machine) -> tuple[int, list[tuple[int, int]], list]:
    """Words of a text, merged word spans (end exclusive) inside windows, and items."""
    words = words_of(raw)
    spans: list[list[int]] = []
    owners: dict = {}
    for start, end, items in machine.matches(words):
        owners.update(dict.fromkeys(items))
        if spans and start <= spans[-1][1]:
            while len(spans) > 1 and start <= spans[-2][1]:
                spans.pop()
            spans[-1] = [min(spans[-1][0], start), end]
        else:
            spans.append([start, end])
    return len(words), [(a, b) for a, b in spans], list(owners)


def offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets (end exclusive) in the original text of word spans."""
    places = [m.span() for m in WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in spans]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


TWO = "array<struct<start: long, end: long>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def as_spans(rows: list) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in s] for s in rows], SPAN)


WORD_SQL = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def item_blocks(items: DataFrame, block_words: int) -> list[DataFrame]:
    """The items with words, as (item_id, text) of each block."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").rlike(WORD_SQL))
    total = items.agg(F.sum(F.regexp_count("text", F.lit(WORD_SQL)))).first()[0] or 0
    blocks = 1 + int(total) // block_words
    return [items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) for block in range(blocks)]


def add_block(rows: DataFrame, shared: Broadcast, window: int, with_offsets: bool, keep_text: bool) -> DataFrame:
    """``rows`` (row, text, n_words, spans, item_ids, places) with what one more block of items finds."""
    out = rows.schema if keep_text else rows.drop("text").schema

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = built_once(shared, window)
        for batch in parts:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            got = [scan(x or b"", machine) for x in texts]
            spans, items = [g[1] for g in got], [g[2] for g in got]
            for k, (spans_before, items_before) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist(), strict=True)):
                if items_before:
                    spans[k] = merged([*spans[k], *((s["start"], s["end"]) for s in spans_before)])
                    items[k] = list(dict.fromkeys([*items_before, *items[k]]))
            places = [offsets(x.decode(), s) if with_offsets and s else [] for x, s in zip(texts, spans, strict=True)]
            new = {"row": batch.column("row"), "text": batch.column("text"), "n_words": pa.array([g[0] for g in got], pa.int64()), "spans": as_spans(spans), "item_ids": pa.array(items, pa.list_(pa.string())), "places": as_spans(places)}
            yield pa.RecordBatch.from_arrays([new[c] for c in out.names], names=out.names)

    return rows.mapInArrow(batches, out)


def scanned(docs: DataFrame, items: DataFrame, *, window: int, block_words: int, with_offsets: bool = False, keep_text: bool = False) -> DataFrame:
    """n_words, spans, item_ids and places of each row, and the row itself: ``row`` has its columns but the text. No shuffle, one pass a block, all but the last one at the call."""
    found = docs.select(rowed(docs), "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(TWO).alias("spans"), F.array().cast("array<string>").alias("item_ids"), F.array().cast(TWO).alias("places"))
    blocks = item_blocks(items, block_words)
    spark, before = docs.sparkSession, None
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        shared = spark.sparkContext.broadcast([tuple(r) for r in block.collect()])  # a block
        found = add_block(found, shared, window, with_offsets, keep_text or not last)
        if last:
            return found
        # Chained passes would run in one stage, each with a worker and an automaton of its own.
        path, schema = write_table(found, "leaks"), found.schema
        shared.destroy()
        if before is not None:
            drop_table(spark, before)
        before, found = path, spark.read.schema(schema).parquet(path)
    return found


def find_leaks(docs: DataFrame, items: DataFrame, *, window: int = 10, block_words: int = 100_000, with_offsets: bool = False) -> DataFrame:
    """doc_id, n_words, spans of hit words and item_ids for every row of ``docs`` (doc_id, text).

    ``items`` has (item_id, text), item_id a number or a string. With
    ``with_offsets``, ``places`` holds the spans as character offsets of the
    original text.
    """
    found = scanned(docs.select("doc_id", "text"), items, window=window, block_words=block_words, with_offsets=with_offsets)
    return found.select("row.doc_id", "n_words", "spans", "item_ids", *(["places"] if with_offsets else []))


def leak_report(docs: DataFrame, items: DataFrame, *, window: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = find_leaks(docs, items, window=window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def without_leaks(docs: DataFrame, items: DataFrame, *, window: int = 10, block_words: int = 100_000) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of an item; each row is judged by its own text."""
    found = scanned(docs, items, window=window, block_words=block_words, keep_text=True).where(F.size("item_ids") == 0)
    return found.select(*unrowed(docs))


#: The same report in DuckDB SQL over ``documents`` and ``benchmark``.
REPORT_SQL = r"""
WITH lower_case AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents, lower_case),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark, lower_case),
sized AS (SELECT *, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
pattern AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS p FROM sized, unnest(range(1, len(w) - k + 2)) AS u(i)),
sizes AS (SELECT DISTINCT k FROM pattern),
place AS (
  SELECT r, i, k, array_to_string(w[i:i+k-1], ' ') AS p FROM d, sizes, unnest(range(1, greatest(len(w) - k + 2, 1))) AS u(i)),
found AS (SELECT r, i, k, item_id FROM place JOIN pattern USING (p, k)),
hit AS (SELECT r, count(DISTINCT j) AS n FROM found, unnest(range(i, i + k)) AS u(j) GROUP BY r),
owner AS (
  SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(owner.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN owner USING (r)
"""
