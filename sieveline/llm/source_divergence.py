"""Source divergence audit: how far the sources of a language are from each other, and by which terms.

Tasks count the terms of their documents by language and source, the counts
are hashed into shards by language and term, and each shard is aggregated by
vectorised SQL in an embedded DuckDB. There are two passes over shards. The
first sums the counts, keeps terms that enough documents of the language hold
and writes them. Totals of groups and languages are sums of that table; every
shard of the second pass gets them as rows beside its terms, so nothing is broadcast.
It returns partial sums for pairs of sources and the best terms of each group,
which Spark sums and ranks.

A probability is an integer in billionths, so all sums are exact. Most terms
are missing from most sources, where a source has its base b, the value of
count 0. The distance of sources s and t is therefore summed as V |b_s - b_t|,
plus |p_s - b_t| - |b_s - b_t| for each term of s, likewise for t, plus a
correction for each term of both: the work follows the counts above 0 and not V times pairs.
Pairs are pairs of sources, which the result lists, never of documents.

Every task sends a term once for each source at most, however frequent it is, and a
shard sums what it gets in blocks, so frequent terms and large sources are no hot keys.

Results: null text, language and source are ''. A group without terms has its
pairs and no terms. Repeated rows and rows of equal or null doc_id are
documents each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import contextlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import salted_join, written

#: Bytes of texts with A-Z lowered and all but letters and bytes beyond ASCII made spaces.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE, SMOOTH = 1_000_000_000, 5
BLOCK = 1 << 20
#: Bytes of text that a shard of the first pass stands for, and kept counts in one of the second: a fraction of a shard's memory.
SHARD_BYTES, SHARD_ROWS = 16 << 20, 500_000


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, listed for one block of it at a time."""
    flat, at = raw.translate(TERM_BYTES), 0
    while at < len(flat):
        end = flat.find(b" ", at + BLOCK)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def term_counts(docs: DataFrame, *, held: int = 400_000) -> DataFrame:
    """Partial counts (lang, source, term, n, docs), each task combining up to ``held`` of them at a time."""
    names = ["lang", "source", "term", "n", "docs"]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in found.items():
                terms = list(n)
                for at in range(0, len(terms), 50_000):
                    some = terms[at : at + 50_000]
                    columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
            found.clear()

        size = 0
        for batch in rows:
            for lang, source, cell in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                group = found.get((lang, source))
                if group is None:
                    group = found[lang, source] = (Counter(), Counter())
                before, seen = len(group[0]), set()
                for terms in terms_of(cell.as_py() or b""):
                    group[0].update(terms)
                    seen.update(terms)
                group[1].update(seen)
                size += len(group[0]) - before
                if size > held:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    return rows.mapInArrow(batches, "lang string, source string, term string, n long, docs long")


@contextlib.contextmanager
def shard_database() -> Iterator:
    """An embedded database in memory, of one thread, without files."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "memory_limit": "1GB", "preserve_insertion_order": False})
    try:
        yield con
    finally:
        con.close()


def shards(spark, size: int, most: int) -> int:
    """How many shards hold ``size`` with ``most`` in each: they grow with the data, and are as many as Spark's shuffles have partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // most))


def kept_terms(counts: DataFrame, *, least_docs: int, block_rows: int = 1_000_000, parts: int | None = None) -> DataFrame:
    """(lang, term, source, n) of the terms that ``least_docs`` documents of the language hold; source null: the language. ``parts`` shards, by default as many as shuffles have partitions."""
    sums = "SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM {} GROUP BY lang, term, source"
    # Sums of all sources stand beside those of each one.
    kept = """
        SELECT lang, term, source, sum(n)::BIGINT AS n FROM
            (SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS held FROM summed) WHERE held >= ?
        GROUP BY GROUPING SETS ((lang, term, source), (lang, term))
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with shard_database() as con:
            con.execute("CREATE TABLE summed (lang VARCHAR, term VARCHAR, source VARCHAR, n BIGINT, docs BIGINT)")
            size, most = 0, block_rows
            for part in rows:
                con.register("part", pa.Table.from_batches([part]))
                con.execute("INSERT INTO summed SELECT lang, term, source, n, docs FROM part")
                con.unregister("part")
                size += part.num_rows
                if size > most:
                    con.execute(f"CREATE TABLE less AS {sums.format('summed')}")
                    con.execute("DROP TABLE summed")
                    con.execute("ALTER TABLE less RENAME TO summed")
                    # Read to its end: a result left open forbids the next block.
                    size = con.execute("SELECT count(*) FROM summed").fetchall()[0][0]
                    most = 2 * size + block_rows
            con.execute(f"CREATE TABLE less AS {sums.format('summed')}")
            con.execute("DROP TABLE summed")
            con.execute("ALTER TABLE less RENAME TO summed")
            yield from con.execute(kept, [least_docs]).to_arrow_reader(50_000)

    dealt = counts.repartition(parts or shards(counts.sparkSession, 0, 1), "lang", "term")
    return dealt.mapInArrow(batches, "lang string, term string, source string, n long")


#: Of a shard's tables held (lang, term, source, n; null source: the language) and
#: totals (lang, source, total, kept): p of what occurs, and the base of each group.
SHARD_SQL = f"""
CREATE TABLE bases AS SELECT lang, source, total::HUGEINT + {SMOOTH} * kept::HUGEINT AS d, (1 + {SCALE * SMOOTH}::HUGEINT // greatest(d, 1))::BIGINT AS b FROM totals;
CREATE TABLE shares AS SELECT h.lang, h.term, h.source, (1 + ({SCALE}::HUGEINT * (h.n + {SMOOTH})) // t.d)::BIGINT AS p, t.b
FROM held h JOIN bases t ON h.lang = t.lang AND h.source IS NOT DISTINCT FROM t.source;
CREATE TABLE sums AS
SELECT lang, source, item, sum(value)::BIGINT AS value FROM (
    SELECT x.lang, x.source, y.source AS item, abs(x.p - y.b) - abs(x.b - y.b) AS value
    FROM shares x JOIN bases y ON x.lang = y.lang AND x.source <> y.source
    UNION ALL
    SELECT x.lang, x.source, y.source, abs(x.p - y.p) - abs(x.p - y.b) - abs(x.b - y.p) + abs(x.b - y.b)
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source < y.source
) GROUP BY lang, source, item;
"""
PAIR_SQL = """
SELECT lang, source, 'pair' AS part, item, sum(value)::BIGINT AS value FROM
    (SELECT lang, least(source, item) AS source, greatest(source, item) AS item, value FROM sums) GROUP BY lang, source, item
"""
TERM_SQL = """
SELECT x.lang, x.source, 'term' AS part, x.term AS item, x.p - y.p AS value
FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND y.source IS NULL
WHERE x.source IS NOT NULL AND x.p > y.p
QUALIFY row_number() OVER (PARTITION BY x.lang, x.source ORDER BY x.p - y.p DESC, x.term) <= ?
"""


def shard_sums(kept: DataFrame, totals: DataFrame, n: int, *, top: int) -> DataFrame:
    """(lang, source, part, item, value): each of ``n`` shards' partial sums of pairs (source < item) and best terms."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with shard_database() as con:
            con.execute("CREATE TABLE held (lang VARCHAR, term VARCHAR, source VARCHAR, n BIGINT)")
            con.execute("CREATE TABLE totals (lang VARCHAR, source VARCHAR, total BIGINT, kept BIGINT)")
            for part in rows:
                con.register("part", pa.Table.from_batches([part]))
                con.execute("INSERT INTO held SELECT lang, term, source, n FROM part WHERE term IS NOT NULL")
                con.execute("INSERT INTO totals SELECT lang, source, n, kept FROM part WHERE term IS NULL")
                con.unregister("part")
            con.execute(SHARD_SQL)
            yield from con.execute(PAIR_SQL).to_arrow_reader(50_000)
            yield from con.execute(TERM_SQL, [top]).to_arrow_reader(50_000)

    own = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(n)).cast("int").alias("shard"), "lang", "term", "source", "n", F.lit(0).cast("long").alias("kept"))
    beside = totals.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"), "lang", F.lit(None).cast("string").alias("term"), "source", F.col("total").alias("n"), "kept")
    return own.unionByName(beside).repartitionById(n, "shard").mapInArrow(batches, "lang string, source string, part string, item string, value long")


def source_divergence(docs: DataFrame, *, least_docs: int = 30, top: int = 50, shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """lang, source, part, item, value and rank for every group (lang, source) of ``docs`` (text, lang, source).

    Part ``pair`` has each other source of the language with its distance,
    part ``term`` the ``top`` terms that the group has more of than its language.
    A shard stands for ``shard_bytes`` of text, then for ``shard_rows`` kept counts.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kept = written(kept_terms(term_counts(docs), least_docs=least_docs, parts=shards(spark, size, shard_bytes)), "terms")
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = written(named, "groups")
    by_source = kept.where("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = kept.where("source IS NULL").groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kept"))
    langs = groups.select("lang").distinct().join(by_lang, "lang", "left").select("lang", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    sized = groups.join(by_source, ["lang", "source"], "left").join(langs.select("lang", "kept"), "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "kept")
    totals = written(sized.unionByName(langs.select("lang", F.lit(None).cast("string").alias("source"), "total", "kept")), "totals")
    partial = written(shard_sums(kept, totals, shards(spark, kept.count(), shard_rows), top=top), "shards")
    # All pairs of sources of a language: the result's own rows.
    base = (F.lit(1) + F.expr(f"{SCALE * SMOOTH}L div greatest(total + {SMOOTH} * kept, 1)")).alias("b")
    sides = totals.where("source IS NOT NULL").select("lang", "source", "kept", base)
    others = sides.select("lang", F.col("source").alias("item"), F.col("b").alias("other"))
    summed = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("more"))
    half = salted_join(sides, others, ["lang"], ["source"]).where("source < item").join(summed, ["lang", "source", "item"], "left")
    half = half.select("lang", "source", "item", (F.col("kept") * F.abs(F.col("b") - F.col("other")) + F.coalesce("more", F.lit(0))).alias("value"))
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).withColumn("part", F.lit("pair"))
    found = both.unionByName(partial.where("part = 'term'"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = found.withColumn("rank", place)
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


DIVERGENCE_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents
), words AS (
    SELECT d, lang, source, unnest(words) AS term FROM docs
), kept AS (
    SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), dense AS (
    SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), shares AS (
    SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w)::HUGEINT AS p FROM dense WINDOW w AS (PARTITION BY lang, source)
), whole AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w)::HUGEINT AS p
    FROM (SELECT lang, term, sum(n)::BIGINT AS n FROM counts GROUP BY lang, term) WINDOW w AS (PARTITION BY lang)
), apart AS (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), pairs AS (
    SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN apart a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
), terms AS (
    SELECT s.lang, s.source, 'term' AS part, s.term AS item, (s.p - w.p)::BIGINT AS value FROM shares s JOIN whole w ON s.lang = w.lang AND s.term = w.term WHERE s.n > 0 AND s.p > w.p
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= 50
"""
