"""Secret scans: fixed patterns, and character Markov models compared by likelihood.

Base kinds are found by patterns. Further spans are tokens of 16 or more key-like
characters whose log-likelihood ratio under two first-order character models,
one of random strings and one of ordinary identifiers, is above a threshold; the
ratio is a sum over characters, so a longer token brings more evidence, and
nothing else decides. There are two models for each make-up of a token (digits only, letters of
one case, of both cases, either with digits), trained from labelled samples by counts of character
pairs with add-one smoothing over a fixed set of characters, so the trained table
has a fixed size and becomes a literal of the projection.

Samples come from the documents and from generators. Random: what the patterns
match, and strings drawn from hashes in the alphabets that keys come in.
Ordinary: the other words of the documents, alone and joined as in program
text, names made of common parts, with numbers too, UUIDs, dates and long numbers. A fold of the samples is
not trained on: the threshold of a make-up lies above nearly all ratios of its ordinary
samples; another fold is left for measuring (``measured``). Documents and
samples are chosen by the order of their hashes, so the models don't depend on
the layout of files.

Only built-in functions run; nothing but samples and pair counts is shuffled.

Results: null and empty texts have no spans; spans are in code points, end
exclusive; Markov spans lie in no base span, but may reach beyond one; equal ratios are treated alike
(the threshold itself is not above the threshold); repeated rows give repeated
results; other columns are ignored; an empty table gives no rows. Without documents
the generated samples alone are learned from; a make-up without samples of both labels gets no spans.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

#: Base kinds in their order: pattern, group that is measured, least length.
BASE = {
    "assign": ("((?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 2, 8),
    "access": ("(AKIA[A-Z0-9]+)", 1, 16),
    # Runs are maximal, so a bound in the pattern drops the same matches.
    "hex": ("([0-9a-f]{32,})", 1, 32),
}
KIND = "markov"
#: Characters of the models; the start of a string is one more state.
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_-"
TOKEN = "([A-Za-z0-9+/_-]{16,}={0,2})"
#: Folds of samples: the threshold is set on one and measured on another.
FOLDS, SETTING, MEASURING = 5, 3, 4
START = len(ALPHABET)


def placed(text: Column, pattern: str, measured: int, least: int, kind: str, order: int) -> Column:
    """Spans (start, end, kind, order) of the leftmost non-overlapping matches, in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(measured))
    gaps = F.split(text, pattern, -1)

    def spans(found: Column, group: Column, between: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

        def step(acc: Column, m: Column) -> Column:
            begin = acc["at"] + F.length(F.get(between, acc["i"]))
            return F.struct((begin + F.length(m)).alias("at"), (acc["i"] + 1).alias("i"), F.concat(acc["starts"], F.array(begin)).alias("starts"))

        begins = F.aggregate(found, start, step)["starts"]
        made = let(begins, lambda at: F.transform(found, lambda m, i: F.struct(F.get(at, i).cast("long").alias("start"), (F.get(at, i) + F.length(m)).cast("long").alias("end"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), F.get(group, i).alias("value"))))
        return F.filter(made, lambda s: F.length(s["value"]) >= least)

    return F.when(text.rlike(pattern), let(matches, lambda a: let(inner, lambda b: let(gaps, lambda c: spans(a, b, c))))).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start: bigint, end: bigint, order: int, kind: string, value: string>>"


def code(char: Column) -> Column:
    """Number of a character in ALPHABET, from 0."""
    return F.instr(F.lit(ALPHABET), char) - 1


#: Parts of names in program text.
PARTS = "get set make new load save read write user name value index count total list item page file path line text data date time type size key map row column table query order price code state status error event message request response client server session config option default first last next".split()


def generated(spark, bound: int) -> DataFrame:
    """``bound`` samples (value, random) of each label, from hashes of numbers."""
    n = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample-"), n.cast("string")), 256)
    packed = F.translate(F.base64(F.unhex(digest)), "=", "")
    letters = F.translate(packed, "+/0123456789", "qzjxvkwyhpbg")
    forms = (
        F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 32)), F.upper(F.translate(packed, "+/0189", "XYABCD")), F.translate(packed, "+/", "_-"),
        packed, F.translate(packed, "+/", "x7"), F.lower(F.translate(packed, "+/", "x7")), F.lower(letters), F.upper(letters),
    )
    length = F.pmod(F.xxhash64(n), F.lit(25)) + 16
    random = F.substring(F.get(F.array(*forms), F.pmod(n, F.lit(len(forms))).cast("int")), F.lit(1), length.cast("int"))
    dash = lambda *cuts: F.concat_ws("-", *[F.substring(digest, a, b) for a, b in cuts])
    uuid = dash((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    number = F.translate(digest, "abcdef", "135790")
    date = F.concat(F.lit("20"), F.substring(number, 1, 2), F.lit("-0"), F.substring(number, 3, 1), F.lit("-1"), F.substring(number, 4, 1), F.lit("T1"), F.substring(number, 5, 1), F.lit("-"), F.substring(number, 6, 2), F.lit("-"), F.substring(number, 8, 2))
    listed = F.array(*[F.lit(w) for w in PARTS])
    parts = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.get(listed, F.pmod(F.xxhash64(n, i), F.lit(len(PARTS))).cast("int")))
    camel = F.array_join(F.transform(parts, lambda p, i: F.when((i == 0) & (F.pmod(n, F.lit(2)) == 0), p).otherwise(F.initcap(p))), "")
    names = (camel, F.concat(camel, F.substring(number, 1, 2)), F.array_join(parts, "_"), F.concat(F.array_join(parts, "-"), F.lit("-v"), F.substring(number, 3, 1)), F.upper(F.array_join(parts, "_")), F.concat(F.array_join(parts, "/"), F.substring(number, 4, 3)))
    forms = (uuid, F.upper(uuid), F.substring(number, F.lit(1), (F.pmod(n, F.lit(5)) + 16).cast("int")), date, *names)
    plain = F.get(F.array(*forms), F.pmod(F.xxhash64(n, F.lit(5)), F.lit(len(forms))).cast("int"))
    ids = spark.range(bound)
    return ids.select(random.alias("value"), F.lit(True).alias("random")).unionByName(ids.select(plain.alias("value"), F.lit(False).alias("random")))


def labelled_strings(docs: DataFrame, *, bound: int = 20_000) -> DataFrame:
    """Labelled samples (value, random), from at most ``bound`` documents: at most 2 x ``bound`` of each label."""
    least = F.xxhash64("doc_id", F.lit(3))
    total = docs.count()
    # A cut by hash that more than the bound pass, then exactly the bound.
    share = min(1.0, (bound + 6 * bound**0.5 + 50) / max(total, 1))
    near = docs.where(F.col("text").isNotNull() & (F.pmod(least, F.lit(1 << 30)) < int(share * (1 << 30))))
    keys = F.concat(*[F.filter(F.regexp_extract_all("text", F.lit(p), F.lit(group)), lambda v: F.length(v) >= 16) for p, group, _ in BASE.values()])
    rest = F.col("text")
    for pattern, _, _ in BASE.values():
        rest = F.regexp_replace(rest, pattern, " ")
    words = F.slice(F.filter(F.regexp_extract_all(rest, F.lit("([A-Za-z0-9][A-Za-z0-9_/+-]{2,})"), F.lit(1)), lambda w: F.length(w) <= 40), 1, 24)
    chosen = near.select("doc_id", least.alias("h"), F.slice(keys, 1, 4).alias("k"), words.alias("w")).orderBy(F.pmod("h", F.lit(1 << 30)), "doc_id", "w", "k").limit(bound)
    lower = F.transform(F.slice("w", 1, 6), F.lower)
    digits = F.pmod("h", F.lit(10_000)).cast("string")
    joins = F.array(
        F.array_join(F.slice(lower, 1, 3), "_"), F.array_join(F.transform(F.slice("w", 1, 4), F.initcap), ""), F.array_join(F.slice(lower, 2, 3), "-"), F.array_join(F.slice(lower, 1, 4), "/"),
        F.upper(F.array_join(F.slice(lower, 3, 3), "_")), F.concat(F.array_join(F.slice(lower, 2, 3), "_"), digits), F.concat(F.array_join(F.transform(F.slice("w", 3, 3), F.initcap), ""), digits), F.array_join(F.slice(lower, 1, 2), ""),
    )
    made = F.concat(F.array(F.get(joins, F.pmod("h", F.lit(8)).cast("int"))), F.filter("w", lambda w: F.length(w) >= 14), F.slice("w", 5, 1))
    real = chosen.select(F.explode("k").alias("value"), F.lit(True).alias("random"))
    ordinary = chosen.where(F.size("w") >= 4).select(F.explode(F.slice(made, 1, 2)).alias("value"), F.lit(False).alias("random"))
    return real.unionByName(ordinary).unionByName(generated(docs.sparkSession, bound))


def fold(value: Column) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(11)), F.lit(FOLDS))


#: Make-ups of tokens, by number.
MAKEUPS = ("digits", "one case", "both cases", "one case, digits", "both cases, digits")


def makeup(value: Column) -> Column:
    lower, upper, digit = value.rlike("[a-z]"), value.rlike("[A-Z]"), value.rlike("[0-9]")
    return F.when(~lower & ~upper, 0).otherwise(1 + (lower & upper).cast("int") + 2 * digit.cast("int"))


def pair_tables(samples: DataFrame) -> list[list[float] | None]:
    """For each make-up the log ratios log P_random(c | previous) - log P_ordinary(c | previous), previous-major.

    A table has (characters + 1) x characters entries, whatever the samples.
    """
    chars = F.transform(F.split("value", ""), code)
    coded = samples.where(F.col("value").isNotNull() & (F.length("value") > 0)).select(makeup(F.col("value")).alias("makeup"), "random", F.filter(chars, lambda c: c >= 0).alias("c"))
    pairs = coded.select("makeup", "random", F.explode(F.transform("c", lambda c, i: F.coalesce(F.get("c", i - 1), F.lit(START)) * F.lit(len(ALPHABET)) + c)).alias("pair"))
    counts = {(r["makeup"], r["random"], r["pair"]): r["n"] for r in pairs.groupBy("makeup", "random", "pair").agg(F.count("*").alias("n")).collect()}
    width = len(ALPHABET)

    def logs(which: int, random: bool) -> list[float]:
        out = []
        for prev in range(width + 1):
            row = [counts.get((which, random, prev * width + c), 0) + 1 for c in range(width)]
            out += [math.log(n / sum(row)) for n in row]
        return out

    known = {(m, random) for m, random, _ in counts}
    return [[round(a - b, 4) for a, b in zip(logs(m, True), logs(m, False), strict=True)] if {(m, True), (m, False)} <= known else None for m in range(len(MAKEUPS))]


def constants(values: list[float]) -> Column:
    """An array of numbers as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<double>")


def likelihood_ratio(value: Column, tables: list[list[float] | None]) -> Column:
    """Log-likelihood ratio of a string under the models of its make-up; characters outside ALPHABET count nothing."""
    size = (START + 1) * len(ALPHABET)
    ratios = constants([x for t in tables for x in (t or [0.0] * size)])

    def total(codes: Column) -> Column:
        each = F.transform(codes, lambda c, i: F.get(ratios, makeup(value) * F.lit(size) + F.coalesce(F.get(codes, i - 1), F.lit(START)) * F.lit(len(ALPHABET)) + c))
        return F.aggregate(each, F.lit(0.0), lambda a, b: a + b)

    return let(F.filter(F.transform(F.split(value, ""), code), lambda c: c >= 0), total)


@dataclass(frozen=True)
class Model:
    """Tables and thresholds by make-up."""

    tables: list[list[float] | None]
    thresholds: list[float]

    def is_random(self, value: Column) -> Column:
        return likelihood_ratio(value, self.tables) > F.get(constants(self.thresholds), makeup(value))


def train(docs: DataFrame, *, bound: int = 20_000, quiet: float = 0.999, missed: float = 0.01) -> Model:
    """The models' tables, and for each make-up the threshold.

    A share ``quiet`` of ordinary samples stays at or below it; where the
    samples are further apart, it leaves a share ``missed`` of random ones.
    """
    samples = written(labelled_strings(docs, bound=bound), "samples")
    tables = pair_tables(samples.where(~fold(F.col("value")).isin(SETTING, MEASURING)))
    setting = samples.where((fold(F.col("value")) == SETTING) & (F.length("value") >= 16)).select(makeup(F.col("value")).alias("makeup"), "random", likelihood_ratio(F.col("value"), tables).alias("ratio"))
    cuts: dict[int, float] = {}
    for r in setting.groupBy("makeup", "random").agg(F.percentile("ratio", F.lit(missed)).alias("low"), F.percentile("ratio", F.lit(quiet)).alias("high")).collect():
        cuts[r["makeup"]] = max(cuts.get(r["makeup"], -1e300), r["low"] if r["random"] else r["high"])
    return Model(tables, [round(cuts.get(m, 0.0), 6) if tables[m] else 1e300 for m in range(len(MAKEUPS))])


def measured(docs: DataFrame, model: Model, *, bound: int = 20_000) -> dict[str, float]:
    """Precision and recall on the fold of samples (16 characters or more) that neither models nor threshold were learned from."""
    samples = labelled_strings(docs, bound=bound).where((fold(F.col("value")) == MEASURING) & (F.length("value") >= 16))
    found = model.is_random(F.col("value")).alias("found")
    n = {(r["random"], r["found"]): r["n"] for r in samples.select("random", found).groupBy("random", "found").agg(F.count("*").alias("n")).collect()}
    true, false, missed = n.get((True, True), 0), n.get((False, True), 0), n.get((True, False), 0)
    return {"precision": true / max(true + false, 1), "recall": true / max(true + missed, 1), "false_positive_rate": false / max(false + n.get((False, False), 0), 1)}


def scan_secrets(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, base (spans of patterns) and spans (all) of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("__text")).select("doc_id", "__text", *[placed(F.col("__text"), p, group, least, kind, k).alias(f"__{kind}") for k, (kind, (p, group, least)) in enumerate(BASE.items())])
    base = F.concat(*[F.col(f"__{kind}") for kind in BASE])
    found = found.select("doc_id", "__text", base.alias("base"))
    if model is None:
        return found.select("doc_id", "base", F.array_sort("base").alias("spans"))
    tokens = placed(F.col("__text"), TOKEN, 1, 16, KIND, len(BASE))
    inside = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    added = F.filter("__tokens", lambda s: ~inside(s) & model.is_random(s["value"]))
    found = found.select("doc_id", "base", tokens.alias("__tokens"))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", F.when(F.size("__tokens") > 0, added).otherwise(F.array().cast(SPANS)))).alias("spans"))


def written_spans(spans: Column) -> Column:
    """kind:start:end of the spans by start, then kind, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["order"], s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, *, bound: int = 20_000) -> DataFrame:
    """Counts per base kind, their digest and all spans, per document."""
    docs = docs.select("doc_id", "text")
    found = scan_secrets(docs, train(docs, bound=bound))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"))
