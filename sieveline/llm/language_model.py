"""LM scoring with a weighted backoff automaton over the whole corpus.

Every n-gram of the training documents below the order is a state, and every
n-gram an arc: from the state of the words before its last word to the longest
state that the words end with. A state without an arc on a word
has a failure arc, of weight K / (c + K), to the state without the
first word. Smoothing is Dirichlet: an arc weighs (c(state, word) + K p) /
(c(state) + K), with p the probability below; at the root p is (c + 1) / (N +
V + 1), one share being kept for unknown words. Probabilities of every state
add up to 1, whatever was seen. One left-to-right traversal of a text carries
the state, takes failure arcs until an arc fits and adds log10 weights.

The automaton is never gathered in one place. Documents are cut into blocks,
and a block needs only the states and arcs of its own n-grams, with the counts
of the whole corpus. A block's n-grams are a sorted list of hashes of
``KEY_BITS`` bits with its own training counts. A list is cut by the next
``FAN_BITS`` bits of the hash into at most 1024 pieces, whatever the size of
the corpus; pieces of the same range of up to 1024 lists meet in one task. With more
lists than that, the pieces of each group of lists are merged, the merged
lists, each of one range, go the same way again, and what comes back is handed
down to the pieces. So messages are pieces of lists and grow with the corpus, times the
number of levels (one up to 1024 blocks, a billion tokens, two up to a
million blocks), and a task holds about as many keys as a list has. An n-gram
sends one entry a block however often it occurs, so frequent words are no hot
keys. Hashes of 52 bits take an unseen n-gram for a seen one with a chance of
(number of n-grams) / 2^52.

Results: a null or empty text is the end token alone; without training
documents the root gives every token probability 1; rows with equal doc_id are
documents each; a null doc_id is in training; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, written
from .jaccard_join import STEP, WordHashes, mix

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
BEGIN = np.uint64(xxhash.xxh64_intdigest(b"\n\n"))
#: Bits of the hash of an n-gram, and bits by which a list of them is cut.
KEY_BITS, FAN_BITS = 52, 10
#: Fold of doc_id that is not trained on.
FOLDS, HELD_OUT = 7, 2


def squeezed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes, after their number."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unsqueezed(raw: bytes, dtype: type) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.empty(0, dtype)
    planes = np.frombuffer(pa.decompress(raw[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).ravel()


def sorted_squeezed(values: np.ndarray) -> bytes:
    return squeezed(np.diff(values, prepend=values.dtype.type(0)))


def sorted_unsqueezed(raw: bytes, dtype: type) -> np.ndarray:
    return np.cumsum(unsqueezed(raw, dtype), dtype=dtype)


def token_hashes(raw: bytes, hashes: WordHashes) -> np.ndarray:
    words = raw.translate(LOWER).split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def gram_keys(words: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n up to ``order``, the key of the n-gram ending at each position.

    The begin mark stands before a text's first word; 0 where a text has no
    n-gram of that length yet.
    """
    keys = [words]
    for n in range(2, order + 1):
        before = np.empty_like(words)
        before[1:] = keys[-1][:-1]
        before[starts] = BEGIN if n == 2 else 0
        key = mix(before * STEP + words)
        key[before == 0] = 0
        keys.append(key)
    return keys


def blocks_of(docs: DataFrame, block_tokens: int) -> DataFrame:
    """One row a block: its documents and its tokens as places in a sorted list of word hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["block", "n_tokens", "n_train", "doc_ids", "held_out", "lengths", "places", "words"]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at = WordHashes(), TaskContext.get().partitionId() << 32
        ids, held, parts, total, id_type = [], [], [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal at, total
            words, places = np.unique(np.concatenate(parts), return_inverse=True)
            lengths = np.array([len(p) for p in parts], dtype=np.uint32)
            out = pa.RecordBatch.from_arrays(
                [pa.array([at]), pa.array([total]), pa.array([held.count(False)], pa.int64()), pa.array([list(ids)], pa.list_(id_type)), pa.array([list(held)], pa.list_(pa.bool_())), pa.array([squeezed(lengths)], pa.binary()), pa.array([squeezed(places.astype(np.uint32))], pa.binary()), pa.array([sorted_squeezed(words)], pa.binary())],
                names=fields,
            )
            at, total = at + 1, 0
            for x in (ids, held, parts):
                x.clear()
            return out

        for batch in rows:
            id_type = batch.schema.field("doc_id").type
            for doc, flag, raw in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                tokens = token_hashes(raw or b"", hashes)
                ids.append(doc)
                held.append(flag)
                parts.append(tokens)
                total += len(tokens)
                if total >= block_tokens:
                    yield flush()
        if parts:
            yield flush()

    schema = f"block long, n_tokens long, n_train long, doc_ids array<{kind}>, held_out array<boolean>, lengths binary, places binary, words binary"
    flag = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", flag.alias("held_out"), "text").mapInArrow(batches, schema)


def token_words(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word hashes, lengths and starts of a block's texts."""
    lengths = unsqueezed(row["lengths"], np.uint32).astype(np.int64)
    words = sorted_unsqueezed(row["words"], np.uint64)[unsqueezed(row["places"], np.uint32)]
    return words, lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def own_counts(row: dict, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n the sorted keys of a block's n-grams and its own training counts."""
    words, lengths, starts = token_words(row)
    train = np.repeat(~np.array(row["held_out"], dtype=bool), lengths).astype(np.uint64)
    for keys in gram_keys(words, starts, order):
        flagged = np.sort((keys >> np.uint64(64 - KEY_BITS)) << np.uint64(1) | train)
        every = flagged >> np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        unique, own = every[first], np.add.reduceat(flagged & np.uint64(1), first).astype(np.uint32)
        if unique[0] == 0:  # where there is no n-gram
            own[0] = 0
        yield unique, own


class Block:
    """A block's n-grams: for each n the sorted keys, their place at each position and a position of each."""

    def __init__(self, row: dict, order: int):
        words, self.lengths, self.starts = token_words(row)
        self.keys, self.at, self.somewhere = [], [], []
        for keys in gram_keys(words, self.starts, order):
            keys >>= np.uint64(64 - KEY_BITS)
            ranked = np.argsort(keys)
            keys = keys[ranked]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            at = np.empty(len(keys), np.int32)
            at[ranked] = np.cumsum(new, dtype=np.int32) - 1
            self.keys.append(keys[new])
            self.at.append(at)
            self.somewhere.append(ranked[new].astype(np.int32))


def cuts(keys: np.ndarray, level: int, part: int) -> np.ndarray:
    """Where the pieces of a list of a level and part begin and end."""
    low = KEY_BITS - FAN_BITS * level
    bounds = np.array([(part << low) + (k << (low - FAN_BITS)) for k in range(1, 1 << FAN_BITS)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


LIST = "n int, part long, list long, keys binary, own binary"
PIECE = "n int, part long, whole long, list long, keys binary, own binary"


def cut_up(n: int, part: int, name: int, level: int, keys: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    """The pieces of a list that are not empty: part is that of the piece, whole that of its list."""
    at = cuts(keys, level, part).tolist()
    held = [(k, a, b) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
    size = len(held)
    return pa.RecordBatch.from_arrays(
        [pa.array([n] * size, pa.int32()), pa.array([(part << FAN_BITS) + k for k, _, _ in held], pa.int64()), pa.array([part] * size, pa.int64()), pa.array([name] * size, pa.int64()), pa.array([sorted_squeezed(keys[a:b]) for _, a, b in held], pa.binary()), pa.array([squeezed(own[a:b]) for _, a, b in held], pa.binary())],
        names=["n", "part", "whole", "list", "keys", "own"],
    )


def pieces_of_blocks(blocks: DataFrame, order: int) -> DataFrame:
    """Each block's n-grams as lists, one for each n, cut up."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                for n, (keys, own) in enumerate(own_counts(row, order), start=1):
                    yield cut_up(n, 0, row["block"], 0, keys, own)

    return blocks.select("block", "held_out", "lengths", "places", "words").mapInArrow(batches, PIECE)


def pieces_of_lists(lists: DataFrame, level: int) -> DataFrame:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for n, part, name, keys, own in zip(*[batch.column(c).to_pylist() for c in ("n", "part", "list", "keys", "own")], strict=True):
                yield cut_up(n, part, name, level, sorted_unsqueezed(keys, np.uint64), unsqueezed(own, np.uint32))

    return lists.mapInArrow(batches, PIECE)


class Pieces:
    """Pieces of one part of several lists: all keys, their counts, and which distinct key each is."""

    def __init__(self, table: pa.Table):
        self.table = table.take(pa.array(np.argsort(table.column("list").to_numpy(), kind="stable")))
        keys = [sorted_unsqueezed(x, np.uint64) for x in self.table.column("keys").to_pylist()]
        self.lengths = [len(k) for k in keys]
        self.counts = np.concatenate([unsqueezed(x, np.uint32) for x in self.table.column("own").to_pylist()]).astype(np.int64)
        every = np.concatenate(keys)
        ranked = np.argsort(every)
        every = every[ranked]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        self.keys, self.sums = every[first], np.add.reduceat(self.counts[ranked], first)
        self.which = np.empty(len(every), np.int64)
        self.which[ranked] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(every))))


#: Counts may pass 32 bits only in sums over the corpus.
ANSWER = "n int, part long, list long, piece long, places binary, counts binary, tokens long, types long"


def answers(pieces: Pieces, more: np.ndarray, top: bool) -> pa.Table:
    """For each piece what others have counted of its keys, where that isn't 0; at the top one row more holds the part's totals.

    ``more``: what is counted of each distinct key outside these pieces.
    """
    others = (pieces.sums + more)[pieces.which] - pieces.counts
    places, found, at = [], [], 0
    for n in pieces.lengths:
        mine = others[at : at + n]
        hit = np.flatnonzero(mine)
        places.append(sorted_squeezed(hit.astype(np.uint32)))
        found.append(squeezed(mine[hit]))
        at += n
    table = pieces.table
    size, last = len(places), [None] if top else []
    n = table.column("n").to_pylist()
    return pa.table(
        [pa.array(n + n[:1] * len(last), pa.int32()), pa.array(table.column("whole").to_pylist() + last, pa.int64()), pa.array(table.column("list").to_pylist() + last, pa.int64()), pa.array(table.column("part").to_pylist() + last, pa.int64()), pa.array(places + last, pa.binary()), pa.array(found + last, pa.binary()), pa.array([None] * size + [int(pieces.sums.sum())] * len(last), pa.int64()), pa.array([None] * size + [int((pieces.sums > 0).sum())] * len(last), pa.int64())],
        names=["n", "part", "list", "piece", "places", "counts", "tokens", "types"],
    )


def answer_top(table: pa.Table) -> pa.Table:
    pieces = Pieces(table)
    return answers(pieces, np.zeros(len(pieces.keys), np.int64), True)


def merged_list(table: pa.Table) -> pa.Table:
    """The list of a group of lists in one part."""
    pieces = Pieces(table)
    first = table.slice(0, 1).to_pylist()[0]
    return pa.table([pa.array([first["n"]], pa.int32()), pa.array([first["part"]], pa.int64()), pa.array([first["group"]], pa.int64()), pa.array([sorted_squeezed(pieces.keys)], pa.binary()), pa.array([squeezed(pieces.sums.astype(np.uint32))], pa.binary())], names=["n", "part", "list", "keys", "own"])


def added(keys: np.ndarray, level: int, part: int, found: list[dict]) -> np.ndarray:
    """The counts that answers bring for the keys of a list."""
    out, at = np.zeros(len(keys), np.int64), cuts(keys, level, part)
    for r in found:
        begin = at[r["piece"] - (part << FAN_BITS)]
        out[begin + sorted_unsqueezed(r["places"], np.uint32).astype(np.int64)] += unsqueezed(r["counts"], np.int64)
    return out


def exchanged(pieces: DataFrame, count: int, level: int = 0, *, fan: int = 1 << FAN_BITS) -> DataFrame:
    """ANSWER rows for the pieces of ``count`` lists of a level: a row for each piece, and the totals of each part, without a list."""
    if count <= fan:
        # With few lists a task takes several ranges, so that it has about the keys of one list.
        wide = max(0, FAN_BITS - max(4, count.bit_length()))
        return pieces.groupBy("n", F.shiftright("part", wide)).applyInArrow(answer_top, ANSWER)
    groups = -(-count // fan)
    pieces = written(pieces.withColumn("group", F.pmod(F.xxhash64("list"), F.lit(groups))), "pieces")
    merged = written(pieces.groupBy("n", "part", "group").applyInArrow(merged_list, LIST), "merged")
    above = exchanged(pieces_of_lists(merged, level + 1), groups, level + 1, fan=fan)

    def hand_down(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # totals
            return right.select(["n", "part", "list", "piece", "places", "counts", "tokens", "types"])
        pieces = Pieces(left)
        return answers(pieces, added(pieces.keys, level + 1, key[1].as_py(), right.to_pylist()), False)

    return pieces.groupBy("n", "part", "group").cogroup(above.withColumn("group", F.col("list")).groupBy("n", "part", "group")).applyInArrow(hand_down, ANSWER)


ROOT, BEGINNING = 0, 1


class Automaton:
    """The states and arcs of a block's n-grams.

    State 0 is the root, state 1 the beginning of a text, then come the
    n-grams of each n below the order. Arcs are numbered n by n likewise.
    """

    def __init__(self, block: Block, sums: list[np.ndarray], begins: int, tokens: int, types: int, weights: tuple[float, ...]):
        order, ks = len(weights) + 1, (*weights, 0.0)
        sizes = [len(s) for s in sums]
        arc_base = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        state_base = [2 + b for b in arc_base]
        before = [np.concatenate([[-1], at[:-1]]) for at in block.at]  # the n-gram that ends one position earlier
        first = np.zeros(len(block.at[0]), dtype=bool)
        first[block.starts] = True
        lower = np.log10(sums[0] + 1.0) - np.log10(tokens + types + 1.0)
        self.root = lower
        weight, target = [lower], [np.where(sums[0] > 0, state_base[0] + np.arange(sizes[0]), ROOT)]
        fail, cost, depth = [[ROOT, ROOT]], [[0.0, np.log10(ks[0] / (begins + ks[0]))]], [[0, 1]]
        for n in range(order):
            if n:
                at = block.somewhere[n]
                suffix = block.at[n - 1][at]
                context = np.where(first[at], begins, sums[n - 1][before[n - 1][at]]) if n == 1 else sums[n - 1][before[n - 1][at]]
                lower = np.log10((sums[n] + ks[n - 1] * 10.0 ** lower[suffix]) / (context + ks[n - 1]))
                weight.append(lower)
                target.append(state_base[n] + np.arange(sizes[n]) if n < order - 1 else state_base[n - 1] + suffix)
            if n < order - 1:
                fail.append(state_base[n - 1] + suffix if n else np.zeros(sizes[0], np.int64))
                cost.append(np.log10(ks[n] / (sums[n] + ks[n])))
                depth.append(np.full(sizes[n], n + 1))
        joined = lambda parts, kind: array(kind, np.concatenate(parts).astype({"d": np.float64, "i": np.int32}[kind]).tobytes())
        self.weight, self.target = joined(weight, "d"), joined(target, "i")
        self.fail, self.cost, self.depth = joined(fail, "i"), joined(cost, "d"), joined(depth, "i")
        #: For each length of a state that may precede a position, the arc on the word there, or -1: arcs by state and word.
        self.arcs = [np.where(sums[n][block.at[n]] > 0, arc_base[n] + block.at[n], -1) if n else block.at[0] for n in range(order)]

    def traverse(self, begin: int, end: int) -> float:
        """log10 probability of the text from one position to another."""
        weight, target, fail, cost, depth = self.weight, self.target, self.fail, self.cost, self.depth
        state, total = BEGINNING, 0.0
        for at in range(begin, end, 65_536):
            for found in zip(*[a[at : min(end, at + 65_536)].tolist() for a in self.arcs], strict=True):
                arc = found[depth[state]]
                while arc < 0:
                    total += cost[state]
                    state = fail[state]
                    arc = found[depth[state]]
                total += weight[arc]
                state = target[arc]
        return total


def score_corpus(docs: DataFrame, *, weights: tuple[float, ...] = (1000.0, 10.0), block_tokens: int = 1_000_000, fan: int = 1 << FAN_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    ``weights`` holds K for bigrams, trigrams and so on; their number sets the
    order of the model.
    """
    order = len(weights) + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = written(blocks_of(docs, block_tokens), "blocks")
    count, begins = blocks.agg(F.count("*"), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    answered = written(exchanged(pieces_of_blocks(blocks, order), int(count), fan=fan), "answers")
    tokens, types = answered.where("n = 1 AND list IS NULL").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1).to_pylist()[0]
        block = Block(row, order)
        found = right.to_pylist()
        sums = [own.astype(np.int64) + added(keys, 0, 0, [r for r in found if r["n"] == n]) for n, (keys, own) in enumerate(own_counts(row, order), start=1)]
        del found
        for n in range(1, order):  # where there is no n-gram
            if len(block.keys[n]) and block.keys[n][0] == 0:
                sums[n][0] = 0
        machine = Automaton(block, sums, int(begins), int(tokens), int(types), weights)
        ends = (block.starts + block.lengths).tolist()
        scores = [machine.traverse(a, b) for a, b in zip(block.starts.tolist(), ends, strict=True)]
        per = lambda x: np.add.reduceat(x[block.at[0]], block.starts)
        return pa.table(
            [left.column("doc_ids").combine_chunks().flatten(), pa.array(row["held_out"], pa.bool_()), pa.array(block.lengths), pa.array(per((sums[0] > 0).astype(np.int64))), pa.array(np.full(len(block.lengths), int(tokens))), pa.array(per(machine.root)), pa.array(scores, pa.float64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    mine = blocks.drop("n_tokens", "n_train").withColumnRenamed("block", "list").groupBy("list")
    theirs = answered.where(F.col("list").isNotNull()).select("list", "n", "piece", "places", "counts").groupBy("list")
    return mine.cogroup(theirs).applyInArrow(score, out)
