"""Vector bin packing of tokenised documents into fixed-length sequences.

An item is a vector (tokens, one segment, loss-bearing tokens); a sequence
limits all three at once. Of the open sequences that hold an item whole, it
goes to the one with the largest dot product of item and free space, both in
shares of the limits. Items may be cut: one that fits nowhere fills up the
fullest open sequence. Each partition packs on its own, with a bounded number
of open sequences; what is left at its end goes to full sequences and to
sequences whose lengths are powers of two, which need no padding.

Results: a null or empty text is the closing identifier alone; repeated rows
are packed each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path
from .token_count import ODD_SPACE, byte_symbols

#: Documents encoded at once.
GROUP = 200
#: A Latin word with at most one mark behind it; in lower case it is the normal form's word, and the mark is a word of its own.
SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)")


class Encoder:
    """Identifiers of whole texts as little-endian 32-bit bytes.

    Identifiers of space-delimited chunks are kept, ``bound`` of them at most.
    Texts with special strings or odd control characters go to the library whole.
    """

    def __init__(self, path: str, bound: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks: dict[str, bytes] = {}
        self.bound = bound
        self.symbols = byte_symbols()
        self.merge = self.tokenizer.model.tokenize
        self.points = {mark: self.whole(mark) for mark in ("", ".", ",")}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, word: str) -> bytes:
        """Identifiers of a word in normal form, by the library's merges alone."""
        piece = word if word.isascii() else "".join(self.symbols[b] for b in word.encode())
        return array("I", [t.id for t in self.merge(piece)]).tobytes()

    def learn(self, words: list[str]) -> None:
        """Add chunks, encoded in one go with a special string between them."""
        mark = self.marks[0]
        ids = np.array(self.tokenizer.encode(mark.join(words), add_special_tokens=False).ids, dtype="<u4")
        cuts = np.flatnonzero(ids == self.tokenizer.token_to_id(mark)) * 4
        raw = ids.tobytes()
        starts, ends = [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)]
        self.chunks.update(zip(words, map(raw.__getitem__, map(slice, starts, ends)), strict=True))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.chunks) > self.bound:
            self.chunks.clear()
        get = self.chunks.get
        cut: list[list[str]] = []
        found: list[list[bytes | None]] = []
        new: dict[str, None] = {}
        for t in texts:
            if not t or ODD_SPACE.search(t) or any(m in t for m in self.marks):
                cut.append([])
                found.append([self.whole(t)] if t else [])
                continue
            words = t.split()
            ids = list(map(get, words))
            if None in ids:
                for w in [w for w, x in zip(words, ids, strict=True) if x is None]:
                    simple = SIMPLE.fullmatch(w)
                    if simple is None:
                        new[w] = None
                        continue
                    core, mark = simple[1].lower(), simple[2]
                    if core not in self.chunks:
                        self.chunks[core] = self.merged(core)
                    self.chunks[w] = self.chunks[core] + self.points[mark]
            cut.append(words)
            found.append(ids)
        if new:
            self.learn(list(new))
        known = self.chunks.__getitem__
        found = [list(map(known, words)) if None in ids else ids for words, ids in zip(cut, found, strict=True)]
        return [b"".join(ids) for ids in found]


class Packer:
    """Places pieces; ``out`` gets (doc, start, length, crc32, doc tokens, sequence, offset)."""

    def __init__(self, capacity: int, max_segments: int, max_loss: int, open_limit: int, first: int):
        self.limits = np.array([capacity, max_segments, max_loss], dtype=np.float64)
        self.capacity, self.max_segments, self.max_loss = capacity, max_segments, max_loss
        self.free = np.zeros((open_limit, 3))
        self.held: list[list] = []
        self.open_limit = open_limit
        self.next = first
        self.out: list[tuple] = []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, tokens, _ in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), tokens, self.next, offset))
            offset += n
        self.next += 1

    @staticmethod
    def loss(piece: tuple) -> int:
        _, start, ids, _, first_loss = piece
        end = start + len(ids) // 4
        return max(0, end - max(start, first_loss))

    @staticmethod
    def cut(piece: tuple, n: int) -> tuple[tuple, tuple | None]:
        doc, start, ids, tokens, first_loss = piece
        rest = (doc, start + n, ids[4 * n :], tokens, first_loss) if 4 * n < len(ids) else None
        return (doc, start, ids[: 4 * n], tokens, first_loss), rest

    def within_loss(self, piece: tuple, most: int) -> int:
        """How many of the piece's tokens hold at most ``most`` loss-bearing ones."""
        _, start, ids, _, first_loss = piece
        return min(len(ids) // 4, max(0, first_loss - start) + most)

    def close(self, b: int) -> None:
        self.emit(self.held[b])
        last = len(self.held) - 1
        self.held[b] = self.held[last]
        self.free[b] = self.free[last]
        self.held.pop()

    def put(self, b: int, piece: tuple) -> None:
        self.held[b].append(piece)
        self.free[b] -= (len(piece[2]) // 4, 1, self.loss(piece))
        if self.free[b].min() <= 0 and (self.free[b, 0] <= 0 or self.free[b, 1] <= 0):
            self.close(b)

    def add(self, piece: tuple | None) -> None:
        while piece is not None:
            n = len(piece[2]) // 4
            whole = min(n, self.capacity, self.within_loss(piece, self.max_loss))
            if whole == self.capacity:
                head, piece = self.cut(piece, whole)
                self.emit([head])
                continue
            head, piece = self.cut(piece, whole)
            self.place(head)

    def place(self, piece: tuple | None) -> None:
        while piece is not None:
            n, loss = len(piece[2]) // 4, self.loss(piece)
            k = len(self.held)
            free = self.free[:k]
            # The last segment of a sequence has to fill it.
            fits = (free[:, 0] >= n) & (free[:, 2] >= loss) & ((free[:, 1] > 1) | (free[:, 0] == n))
            if fits.any():
                item = np.array([n, 1, loss]) / self.limits
                by = np.where(fits, (free / self.limits) @ item, -1.0)
                return self.put(int(by.argmax()), piece)
            if k < self.open_limit:
                self.held.append([])
                self.free[k] = self.limits
                return self.put(k, piece)
            room = np.array([min(f[0], self.within_loss(piece, int(f[2]))) for f in free])
            fills = np.flatnonzero((room == free[:, 0]) & (room <= n))
            if len(fills):
                b = int(fills[free[fills, 0].argmin()])
                head, piece = self.cut(piece, int(room[b]))
                self.put(b, head)
            else:
                self.close(int(free[:, 0].argmin()))

    def finish(self) -> None:
        """Full sequences from what is left, then ones of 1024, 512, ... tokens."""
        left = [p for pieces in self.held for p in pieces]
        self.held = []
        total = sum(len(p[2]) // 4 for p in left)
        left.reverse()
        while left:
            size = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            pieces, free, loss = [], size, self.max_loss
            while left and free and len(pieces) < self.max_segments:
                piece = left.pop()
                n = min(free, len(piece[2]) // 4, self.within_loss(piece, loss))
                if n == 0:
                    left.append(piece)
                    break
                head, rest = self.cut(piece, n)
                pieces.append(head)
                free, loss = free - n, loss - self.loss(head)
                if rest is not None:
                    left.append(rest)
            total -= size - free
            self.emit(pieces)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[vocabulary] = Encoder(tokenizer_path(vocabulary))
    return _ENCODERS[vocabulary]


def pack(
    docs: DataFrame,
    *,
    vocabulary: str = "word_bpe_49k.json",
    closing_id: int = 1,
    capacity: int = 2048,
    max_segments: int = 64,
    max_loss: int | None = None,
    loss_from: str | None = None,
    loss_after: str | None = None,
    open_sequences: int = 24,
) -> DataFrame:
    """Pieces of every document of ``docs`` (doc_id, text), dealt to sequences.

    ``loss_from`` names a column with the position of a document's first
    loss-bearing token (null: 0), as for prompts that bear no loss; ``loss_after``
    names one with the prompt itself, whose identifiers are counted by the same worker's encoder;
    ``max_loss`` limits such tokens of a sequence (default: its capacity).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    if loss_from and loss_after:
        raise ValueError("the first loss-bearing token is given by loss_from or loss_after")
    columns = ["doc_id", "text", *[c for c in (loss_from, loss_after) if c]]
    most = capacity if max_loss is None else max_loss
    if min(capacity, max_segments, most) < 1:
        raise ValueError("limits must be positive")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        packer = Packer(capacity, max_segments, most, open_sequences, TaskContext.get().partitionId() << 40)
        end = array("I", [closing_id]).tobytes()
        types = (doc_type := [None], pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def flush() -> pa.RecordBatch:
            columns = zip(*packer.out, strict=True) if packer.out else [[]] * 7
            out = pa.RecordBatch.from_arrays([pa.array(c, doc_type[0] if i == 0 else types[i]) for i, c in enumerate(columns)], names=names)
            packer.out = []
            return out

        for batch in rows:
            doc_type[0] = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                ids = encode(part.column(1).to_pylist())
                firsts = part.column(2).to_pylist() if loss_from or loss_after else [0] * len(ids)
                if loss_after:
                    firsts = [len(x) // 4 for x in encode(firsts)]
                for doc, x, first in zip(part.column(0).to_pylist(), ids, firsts, strict=True):
                    x += end
                    packer.add((doc, 0, x, len(x) // 4, first or 0))
            if packer.out:
                yield flush()
        packer.finish()
        if packer.out:
            yield flush()

    return docs.select(*columns).mapInArrow(batches, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_answers(conversations: DataFrame, *, max_loss: int = 1024, **options) -> DataFrame:
    """Pieces of each assistant turn after the turn before it, as ``pack`` gives them; doc_id is conv_id:turn.

    The tokens of the turn before bear no loss, so tokens, segments and
    loss-bearing tokens are three different limits. Of several turns of one
    number each is an answer to the least text before it; null texts are empty.
    """
    text = F.coalesce("text", F.lit(""))
    answers = conversations.where("role = 'assistant'").select("conv_id", "turn", text.alias("answer"))
    asked = conversations.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min(text).alias("prompt"))
    met = answers.join(asked, ["conv_id", "turn"], "left").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), F.concat(F.coalesce("prompt", F.lit("")), F.lit("\n")).alias("prompt"), "answer")
    return pack(met.select("doc_id", F.concat("prompt", "answer").alias("text"), "prompt"), loss_after="prompt", max_loss=max_loss, **options)
