"""Token counts by heap-and-linked-list byte-pair merging.

A word is a doubly linked list of symbols and a heap of its adjacent pairs.
The lowest-ranked pair is popped and merged until no pair has a rank; the
count is the initial symbols minus the merges, and no identifiers are made.

Whole texts are normalised (NFC, white space, lower case), cut by the
vocabulary's pattern and counted word by word. Neither the normal form nor
the pattern reaches across a space, so counts of space-delimited chunks are
kept in a bounded table per Python worker.

Results: null and empty texts count 0 tokens and 0 bytes; repeated rows give
repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import tokenizer_path

#: Control characters that str.split takes for white space.
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges of ``symbols``."""
    n = len(symbols)
    if n < 2:
        return n
    value, before, after = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
    get = ranks.get
    heap = []
    for i in range(n - 1):
        rank = get((value[i], value[i + 1]))
        if rank is not None:
            heap.append((rank, i, value[i], value[i + 1]))
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        # A pair is stale once either side has been merged.
        if value[i] != a or j < 0 or value[j] != b:
            continue
        value[i], value[j] = a + b, ""
        nxt = after[i] = after[j]
        left -= 1
        if nxt >= 0:
            before[nxt] = i
            rank = get((value[i], value[nxt]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, value[i], value[nxt]))
        prev = before[i]
        if prev >= 0:
            rank = get((value[prev], value[i]))
            if rank is not None:
                heapq.heappush(heap, (rank, prev, value[prev], value[i]))
    return left


class Vocabulary:
    """Merge ranks, pattern and special strings of a tokenizers file of the word-end kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.known = set(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.symbols = byte_symbols()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = special

    def word(self, piece: str) -> int:
        symbols = [self.symbols[b] for b in piece.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.end
        return merge_count([s for s in symbols if s in self.known], self.ranks)

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text.isascii():
            # One character at a time: a final sigma is not treated apart.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return sum(map(self.word, self.pattern.findall(text.lower())))


class Chunks(dict):
    """Counts of chunks seen so far; at ``bound`` entries it starts anew."""

    def __init__(self, count: Callable[[str], int], bound: int):
        super().__init__()
        self.count, self.bound = count, bound

    def __missing__(self, chunk: str) -> int:
        n = self.count(chunk)
        if len(self) >= self.bound:
            self.clear()
        self[chunk] = n
        return n


class Counter:
    def __init__(self, path: str, bound: int = 400_000):
        self.vocabulary = Vocabulary(path)
        self.words = Chunks(self.vocabulary.word, bound)
        self.vocabulary.word = self.words.__getitem__
        self.chunks = Chunks(self.vocabulary.plain, bound)

    def stretch(self, text: str) -> int:
        if ODD_SPACE.search(text):
            return self.vocabulary.plain(text)
        return sum(map(self.chunks.__getitem__, text.split()))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        v = self.vocabulary
        if v.special is None or not any(m in text for m in v.marks):
            return self.stretch(text)
        parts = v.special.split(text)
        return len(parts) - 1 + sum(map(self.stretch, parts))


_COUNTERS: dict[str, Counter] = {}


def counter(vocabulary: str) -> Counter:
    """One counter for each worker process and vocabulary file."""
    if vocabulary not in _COUNTERS:
        _COUNTERS[vocabulary] = Counter(tokenizer_path(vocabulary))
    return _COUNTERS[vocabulary]


def count_tokens(docs: DataFrame, *, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in rows:
            texts = batch.column("text")
            n = pa.array([count(t) for t in texts.to_pylist()], pa.int64())
            size = pa.array([len(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.int64())
            over = pa.array([x > limit for x in n.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n, over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
