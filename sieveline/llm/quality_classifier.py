"""Quality classifier: Bradley-Terry ranking learned from preference pairs.

A document of label 1 is preferred to one of label 0. Scores are linear in
text features; the chance that one document beats another is the logistic
function of the difference of their scores, so weights are learned by logistic
loss on feature differences. The threshold is the quantile of the scores of
all labelled documents that may be learned from, at the share of label 0; the
reported score maps it to ``cut``.

Weights are learned from a bounded sample: the ``max_labelled`` rows of each
label with the least hashes. The quantile is that of a mergeable sketch, the
midpoint of those ``MARGIN`` of the ranks below and above, over all labelled
rows. Features are built-in expressions over whole texts, computed once for
each document; only labels and scores are shuffled.

Results: null and empty texts have features 0 and are scored like any other;
without labels of both kinds every score is ``cut`` and nothing is rejected;
repeated rows get equal scores; other columns are ignored or pass through, whatever their names;
labels of unknown documents, null labels and labels other than 0 and 1 are ignored, and of
several labels of a document the least counts. Of several texts of a labelled
doc_id the weights are learned from one, the threshold from all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fold_of, let, once, rowed, unrowed, word_list, written

#: Fold of doc_id that labels are never learned from.
FOLDS, HELD_OUT = 4, 2
#: The threshold lies between the quantiles this far below and above its rank; the sketch's error is a tenth of it.
MARGIN = 0.001


def features(text: Column, words: Column) -> dict[str, Column]:
    """Features of a text and its words; none looks at anything but the text."""
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    letters = F.greatest(F.regexp_count(text, F.lit("\\p{L}")), F.lit(1)).cast("double")
    again = F.filter(words, lambda w, i: F.lower(w) == F.lower(F.coalesce(F.get(words, i - 1), F.lit(""))))
    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "distinct_share": F.size(F.array_distinct(words)) / n,
        "again_share": F.size(again) / n,
        "word_chars": F.least(F.length(F.array_join(words, "")) / n, F.lit(30.0)),
        "upper_share": F.regexp_count(text, F.lit("\\p{Lu}")) / letters,
        "digit_share": F.regexp_count(text, F.lit("[0-9]")) / chars,
        "symbol_share": F.regexp_count(text, F.lit("[^\\p{L}\\p{N}\\p{M}\\s.,;:!?'\"()-]")) / n,
        "point_share": F.regexp_count(text, F.lit("[.,;:](?=\\s|$)")) / n,
        "mark_share": F.regexp_count(text, F.lit("[!?]")) / n,
        "line_share": F.regexp_count(text, F.lit("\\n")) / n,
    }


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and the vector of features as columns f0, f1, ..."""
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__text"), once(word_list(F.col("text"))).alias("__words"))
    return base.select("doc_id", *[c.cast("double").alias(f"f{i}") for i, c in enumerate(features(F.col("__text"), F.col("__words")).values())])


def linear(values: list[Column], weights: tuple[float, ...]) -> Column:
    total = F.lit(0.0)
    for w, value in zip(weights, values, strict=True):
        total = total + F.lit(w) * value
    return total


def as_score(raw: Column, threshold: float, cut: float) -> Column:
    """The score of a raw sum, 0 to 1, ``cut`` at the threshold."""
    total = raw + F.lit(float(np.log(cut / (1 - cut)) - threshold))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(total, F.lit(500.0)), F.lit(-500.0))))


def bradley_terry(better: np.ndarray, worse: np.ndarray, *, pairs_each: int, ridge: float, seed: int) -> np.ndarray:
    """Weights by Newton steps on the logistic loss of feature differences."""
    rng = np.random.default_rng(seed)
    most, least = (better, worse) if len(better) > len(worse) else (worse, better)
    own = np.repeat(np.arange(len(most)), pairs_each)
    other = rng.integers(0, len(least), len(own))
    diff = most[own] - least[other] if most is better else least[other] - most[own]
    w = np.zeros(diff.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))
        slope = -(diff.T @ p) / len(diff) + ridge * w
        curve = (diff.T * (p * (1 - p))) @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def usable(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labels that may be learned from, one for each document."""
    kept = F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    return labels.select("doc_id", "quality").where(kept).groupBy("doc_id").agg(F.min("quality").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 10_000, pairs_each: int = 4, ridge: float = 1e-3, seed: int = 7) -> tuple[float, ...] | None:
    """Weights learned from ``labels`` (doc_id, quality) of documents that are not held out; None without both labels.

    The features of at most ``max_labelled`` rows of each label reach the driver.
    """
    width = len(features(F.lit(""), F.array(F.lit(""))))
    labelled = usable(labels)
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    counts = {r["quality"]: r["n"] for r in labelled.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    # A cut by hash that more than enough rows pass, then exactly the least.
    share = {q: min(1.0, (max_labelled + 6 * max_labelled**0.5 + 50) / n) for q, n in counts.items()}
    near = lambda q: labelled.where((F.col("quality") == q) & (hashed < int(share[q] * (1 << 30))))
    sample = checkpoint(near(0).orderBy(hashed, "doc_id").limit(max_labelled).unionByName(near(1).orderBy(hashed, "doc_id").limit(max_labelled)))
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    names = [f"f{i}" for i in range(width)]
    one = featured(chosen).groupBy("doc_id").agg(F.min(F.struct(*names)).alias("f"))
    found = one.join(F.broadcast(sample), "doc_id").orderBy("doc_id").select("quality", "f.*").toArrow()
    y = found.column("quality").to_numpy()
    x = np.column_stack([found.column(c).to_numpy() for c in names]) if len(y) else np.zeros((0, width))
    if not (y == 0).any() or not (y == 1).any():
        return None
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = (x - mean) / spread
    w = bradley_terry(z[y == 1], z[y == 0], pairs_each=pairs_each, ridge=ridge, seed=seed)
    return tuple(float(v) for v in w / spread)


def threshold_of(scored: DataFrame, labels: DataFrame) -> float:
    """The score quantile at the share of label 0, over the labelled rows of ``scored`` (doc_id, raw)."""
    met = scored.join(usable(labels), "doc_id")
    bad = met.agg(F.avg((F.col("quality") == 0).cast("double"))).first()[0]
    if bad is None:
        return 0.0
    ranks = [max(0.0, bad - MARGIN), min(1.0, bad + MARGIN)]
    low, high = met.agg(F.percentile_approx("raw", ranks, int(10 / MARGIN))).first()[0]
    return (low + high) / 2


def raw_score(text: Column, weights: tuple[float, ...]) -> Column:
    """The raw score of a text as one expression, its words bound once."""
    shown = F.coalesce(text, F.lit(""))
    return let(word_list(text), lambda words: linear([c.cast("double") for c in features(shown, words).values()], weights))


def score_documents(docs: DataFrame, labels: DataFrame, *, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    weights = train(docs, labels)
    if weights is None:
        return docs.select("doc_id", held_out, F.lit(cut).alias("score"), F.lit(1).alias("predicted"))
    scored = written(featured(docs).select("doc_id", linear([F.col(f"f{i}") for i in range(len(weights))], weights).alias("raw")), "scores")
    threshold = threshold_of(scored, labels)
    score = as_score(F.col("raw"), threshold, cut)
    return scored.select("doc_id", held_out, score.alias("score"), (score >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, cut: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier doesn't reject."""
    weights = train(docs, labels)
    if weights is None:
        return docs
    scored = written(docs.select(rowed(docs), "text", raw_score(F.col("text"), weights).alias("raw")), "scored")
    threshold = threshold_of(scored.select("row.doc_id", "raw"), labels)
    return scored.where(as_score(F.col("raw"), threshold, cut) >= cut).select(*unrowed(docs))
