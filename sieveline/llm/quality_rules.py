"""Quality rules: a table of thresholds compiled into one Spark projection.

A rule names a measure of a text, a lower and an upper bound. Measures are
built-in expressions over the words and lines of a row; no user functions
run, and nothing is shuffled. A text is kept if it passes the base limits and
every rule.

Results: a null or empty text has no words, fails the base limit and is not
kept; ratios over nothing are 0; repeated rows give repeated results; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, once, word_list

# Common short words of English, French, German and Spanish.
STOP_WORDS = {
    "en": "the of and to in a is that it for on was as with be at by this from or an are".split(),
    "fr": "le la les de des du et en un une que qui dans pour par sur au aux est pas ce".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "el la los las de que y a en un una se no por con para su al lo del es".split(),
}


@dataclass(frozen=True)
class Rule:
    """Keep texts whose measure lies within [low, high]; None: no bound."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The production table.
RULES = (
    Rule("words", "n_words", low=10),
    Rule("mean_word_length", "mean_word_chars", low=2, high=20),
    Rule("symbols", "symbols_per_word", high=0.3),
    Rule("exclamations", "exclamations_per_word", high=0.5),
    Rule("upper_case", "upper_share", high=0.6),
    Rule("repeated_lines", "dup_line_share", high=0.5),
    Rule("distinct_words", "distinct_word_share", low=0.1),
    Rule("stop_words", "stop_word_share", low=0.005),
    Rule("ellipsis_lines", "ellipsis_line_share", high=0.3),
    Rule("bullet_lines", "bullet_line_share", high=0.9),
)

#: Base limits: fewest words, and most words in repeated windows in percent.
LEAST_WORDS, MOST_REPEATED = 10, 20


def repeated_words(words: Column, size: int) -> Column:
    """How many words lie in ``size``-word windows found twice or more.

    Windows are compared by 64-bit hashes. Sorting (hash, position) is left
    to texts in which some hash repeats.
    """
    none = F.lit(0).cast("long")

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(rows: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(rows, i)["h"] == F.get(rows, j)["h"], F.lit(False))
            twice = F.filter(rows, lambda r, k: same(k, k - 1) | same(k, k + 1))
            return F.sort_array(F.transform(twice, lambda r: r["i"]))

        def total(at: Column) -> Column:
            step = lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(size)), F.lit(size))
            return F.aggregate(F.transform(at, step), none, lambda a, b: a + b)

        return let(let(ordered, positions), total)

    starts = F.sequence(F.lit(0), F.size(words) - size)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    repeated = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(none))
    return F.when(F.size(words) > size, repeated).otherwise(none)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measured(docs: DataFrame, window: int = 5) -> DataFrame:
    """doc_id and every measure that rules can name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    base = docs.select("doc_id", text.alias("__text"), once(word_list(F.col("text"))).alias("__words"), F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("__lines"))
    words, lines = F.col("__words"), F.col("__lines")
    counted = base.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(words, window).alias("n_repeat_words"),
        F.size(lines).alias("n_lines"),
        F.size(F.array_distinct(words)).alias("n_distinct_words"),
        F.regexp_count("__text", F.lit("!")).alias("n_exclamations"),
        F.regexp_count("__text", F.lit("\\p{Lu}")).alias("n_upper"),
        F.regexp_count("__text", F.lit("\\p{L}")).alias("n_letters"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).alias("n_stop_words"),
        F.size(F.filter(lines, lambda line: line.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))).alias("n_ellipsis_lines"),
        F.size(F.filter(lines, lambda line: line.rlike("^[\\x20\\x09-\\x0D]*[-*•][\\x20\\x09-\\x0D]"))).alias("n_bullet_lines"),
    )
    n, n_lines = F.col("n_words"), F.col("n_lines")
    return counted.select(
        "*",
        share(F.col("word_chars"), n).alias("mean_word_chars"),
        share(F.col("n_symbols"), n).alias("symbols_per_word"),
        share(F.col("n_exclamations"), n).alias("exclamations_per_word"),
        share(F.col("n_upper"), F.col("n_letters")).alias("upper_share"),
        share(F.col("n_dup_lines"), n_lines).alias("dup_line_share"),
        share(F.col("n_distinct_words"), n).alias("distinct_word_share"),
        share(F.col("n_stop_words"), n).alias("stop_word_share"),
        share(F.col("n_ellipsis_lines"), n_lines).alias("ellipsis_line_share"),
        share(F.col("n_bullet_lines"), n_lines).alias("bullet_line_share"),
    )


def passes(rule: Rule) -> Column:
    value, ok = F.col(rule.measure), F.lit(True)
    if rule.low is not None:
        ok = ok & (value >= rule.low)
    if rule.high is not None:
        ok = ok & (value <= rule.high)
    return ok


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures of every row of ``docs`` (doc_id, text), the verdict and the names of failed rules."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    return (
        measured(docs)
        .select("*", failed.alias("base_failed"), broken.alias("failed_rules"))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"))
    )


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same table compiled into DuckDB SQL over ``documents``."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    bounds = {r.name: " AND ".join([f"{r.measure} >= {r.low}"] * (r.low is not None) + [f"{r.measure} <= {r.high}"] * (r.high is not None)) or "true" for r in rules}
    broken = ", ".join(f"CASE WHEN NOT ({b}) THEN '{n}' END" for n, b in bounds.items())
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM d),
g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, p) AS c
  FROM (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS p FROM w, unnest(range(1, len(ws) - 3)) AS u(i))),
rep AS (
  SELECT r, count(DISTINCT j) AS n FROM g, unnest(range(i, i + 5)) AS v(j) WHERE c > 1 GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_distinct(ws)) AS n_distinct_words,
    len(regexp_extract_all(t, '!')) AS n_exclamations, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper,
    len(regexp_extract_all(t, '\p{{L}}')) AS n_letters,
    len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ 	-
]*$'))) AS n_ellipsis_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[ 	-
]*[-*•][ 	-
]'))) AS n_bullet_lines
  FROM w LEFT JOIN rep USING (r)),
s AS (
  SELECT *, {ratio("word_chars", "n_words")} AS mean_word_chars, {ratio("n_symbols", "n_words")} AS symbols_per_word,
    {ratio("n_exclamations", "n_words")} AS exclamations_per_word, {ratio("n_upper", "n_letters")} AS upper_share,
    {ratio("n_dup_lines", "n_lines")} AS dup_line_share, {ratio("n_distinct_words", "n_words")} AS distinct_word_share,
    {ratio("n_stop_words", "n_words")} AS stop_word_share, {ratio("n_ellipsis_lines", "n_lines")} AS ellipsis_line_share,
    {ratio("n_bullet_lines", "n_lines")} AS bullet_line_share FROM m),
f AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
    array_to_string(list_filter([{broken}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f
"""
