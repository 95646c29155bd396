"""Filter interaction audit: what each of five filters removes, in every order, and its fair share.

A document's failures are a mask of five bits, and everything reported follows
from the counts of masks in a part (a language). With filter i applied with
probability x_i, the expected number of removed documents is the removal
polynomial, the multilinear extension of the set function "removed by these
filters". Its values at the corners of the cube are the documents removed by a
set of filters, hence the survivors of every step of every order. The integral of its partial
derivative along the diagonal is the Shapley value of a filter: the mean over
all 120 orders of what it removes. Integrals are exact rationals; 120 times
such a mean is an integer.

Texts are judged where they are read, in Arrow batches; only identifiers,
128-bit digests and masks are shuffled. The first of equal texts is found by
aggregates: counts of a digest are combined before the shuffle and one row for
each language and label goes on, so a text with a third of all rows is no hot key.

Results: 600 rows for each part. A null text is empty, a null language the
part ''. A document of null doc_id is no smaller and no larger than others: it never
fails E and makes no other fail it; the same holds for rows of one doc_id among each other.
Rows of one doc_id are documents each. Of several labels of a document any 1
counts; labels without a document count nowhere. Other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of the filters, in the order of their bits.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOL = re.compile(rb"[#$%&*|]")
SPACE = re.compile(rb"[\x20\x09-\x0d]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes that begin no code point.
INNER = bytes(range(0x80, 0xC0))
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def word_counts(raw: bytes, block: int = 1 << 20) -> tuple[int, int]:
    """Words and distinct words of a text, listed for one block of it at a time."""
    total, seen, at = 0, set(), 0
    while at < len(raw):
        cut = SPACE.search(raw, at + block)
        end = cut.start() if cut else len(raw)
        words = raw[at:end].split()
        total += len(words)
        seen.update(words)
        at = end
    return total, len(seen)


def text_failures(raw: bytes) -> int:
    """The bits of the filters A to D that a text fails."""
    n, distinct = word_counts(raw)
    points = len(raw.translate(None, INNER))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    failed = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * points, SYMBOL.search(raw) is not None)
    return sum(1 << i for i, f in enumerate(failed) if f)


class RemovalPolynomial:
    """Expected removals as a multilinear polynomial; ``counts``: documents by mask of failures."""

    def __init__(self, counts: dict[int, int]):
        self.coefficients: dict[int, int] = {}
        for mask, n in counts.items():
            # n (1 - product of (1 - x_i) over the mask): each non-empty subset is a monomial, its sign by its size.
            monomial = mask
            while monomial:
                self.coefficients[monomial] = self.coefficients.get(monomial, 0) + (n if monomial.bit_count() % 2 else -n)
                monomial = (monomial - 1) & mask

    def at(self, corner: int) -> int:
        """Documents removed by the filters of ``corner``: the value where their x are 1 and the others 0."""
        return sum(c for monomial, c in self.coefficients.items() if not monomial & ~corner)

    def diagonal_derivative(self, i: int) -> dict[int, int]:
        """The partial derivative by x_i where all x equal t, as coefficients by power of t."""
        powers: dict[int, int] = {}
        for monomial, c in self.coefficients.items():
            if monomial >> i & 1:
                power = monomial.bit_count() - 1
                powers[power] = powers.get(power, 0) + c
        return powers

    def shapley(self, i: int) -> Fraction:
        """The Shapley value of filter i: the integral of its diagonal derivative from 0 to 1."""
        return sum((Fraction(c, power + 1) for power, c in self.diagonal_derivative(i).items()), Fraction(0))


def audit_rows(total: int, all_docs: dict[int, int], good: dict[int, int], toxic: dict[int, int]) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of a part."""
    r, g, t = (RemovalPolynomial(x) for x in (all_docs, good, toxic))
    corners = [(r.at(c), g.at(c), t.at(c)) for c in range(1 << len(FILTERS))]
    every = len(corners) - 1
    shares = [r.shapley(i) * len(ORDERS) for i in range(len(FILTERS))]
    out = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            i = FILTERS.index(letter)
            after = before | 1 << i
            removed, good_lost, toxic_lost = (x - y for x, y in zip(corners[after], corners[before], strict=True))
            unique = corners[every][0] - corners[every & ~(1 << i)][0]
            out.append((order, step, total - corners[after][0], removed, corners[1 << i][0] - removed, unique, good_lost, toxic_lost, int(shares[i])))
            before = after
    return out


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and mask of A to D of every row of ``docs`` (doc_id, text, lang)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            digests, masks = [], []
            for cell in batch.column("text").cast(pa.binary()):
                raw = cell.as_py() or b""
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
                masks.append(text_failures(raw))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], names=["doc_id", "part", "digest", "mask"])

    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(batches, f"doc_id {kind}, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of all five filters, and n, good and toxic: its documents, and those labelled so."""
    keys = ["part", "digest", "mask", "good", "toxic"]
    rows = judged(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    flag = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0)).alias(c)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality"), flag("toxic")).select("doc_id", F.lit(0).cast("long").alias("spread"), F.col("quality").alias("good"), "toxic")
    # Rows without an identifier match no label; they are dealt by their text.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    marked = rows.withColumn("spread", spread).join(marks, ["doc_id", "spread"], "left").fillna(0, ["good", "toxic"])
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    loose = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("loose")
    held = marked.groupBy(keys).agg(F.sum("n").alias("n"), loose, least)
    firsts = held.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    found = held.join(firsts, "digest")
    kept = F.col("loose") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    copy = 1 << FILTERS.index("E")
    sides = F.array(F.struct(F.col("mask"), kept.alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - kept).alias("n")))
    split = found.select("part", "good", "toxic", F.explode(sides).alias("side")).select("part", "good", "toxic", "side.mask", "side.n")
    of = lambda c: F.sum(F.col("n") * F.col(c)).alias(c)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part's kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, by filter_order and step.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic.
    """
    numbers = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                by = [{c["mask"]: c[k] for c in cells} for k in ("n", "good", "toxic")]
                out = list(zip(*audit_rows(sum(by[0].values()), *by), strict=True))
                columns = [pa.array([part] * len(out[0])), pa.array(out[0]), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:]]]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *numbers])

    parts = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(batches, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in numbers))


AUDIT_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copied
    FROM documents
), marks AS (
    SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id
), judged AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
           + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body))::INT
           + 8 * regexp_matches(body, '[#$%&*|]')::INT + 16 * copied::INT AS mask
    FROM texts LEFT JOIN marks USING (doc_id)
), counts AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT [a, b, c, d, e] AS o FROM
        (SELECT l AS a FROM letters), (SELECT l AS b FROM letters), (SELECT l AS c FROM letters), (SELECT l AS d FROM letters), (SELECT l AS e FROM letters)
    WHERE len(list_distinct([a, b, c, d, e])) = 5
), steps AS (
    SELECT array_to_string(o, '') AS filter_order, step::INT AS step, o[step] AS letter,
           (SELECT coalesce(sum(bit), 0) FROM letters WHERE list_contains(o[1:step - 1], l))::INT AS earlier
    FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step)
), cells AS (
    SELECT part, filter_order, step, letter,
           sum(n) FILTER (mask & (earlier | bit) = 0) AS kept,
           sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0) AS removed,
           sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0) AS redundant,
           sum(n) FILTER (mask = bit) AS unique_fails,
           sum(good) FILTER (mask & bit > 0 AND mask & earlier = 0) AS good_lost,
           sum(toxic) FILTER (mask & bit > 0 AND mask & earlier = 0) AS toxic_lost
    FROM counts, steps JOIN letters ON l = letter GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM cells
"""
