"""Operator 10: toxicity by non-negative positive-unlabelled learning.

A linear model over a document's distinct words and word beginnings is trained
in numpy from confirmed toxic documents and unlabelled text. The risk estimator
is corrected by the class prior: the negative risk of the unlabelled text less
that of the positives, kept from falling below zero (the step then goes the
other way), after Kiryo et al. 2017. Then the intercept is set so that the mean score
of the unlabelled documents is the prior, which keeps documents without a
telling feature under it however few the labels are.

The class prior is the share of positives among labelled documents. Where only
positives are labelled it is estimated: unlabelled documents hold a feature at
least as often as the prior times its share of the positives, so the prior is at
most the least ratio of the two shares, taken over features of many positives
with a standard error for caution. A caller may also give it. It never exceeds
``MOST_PRIOR``.

The training sample is bounded: at most about ``POSITIVES`` toxic and
``UNLABELLED`` unlabelled documents, chosen by a hash of the id. Its features'
document counts are summed by Spark; only features whose documents are surely toxic more
often than the prior says (a confidence bound) are kept, the ``FEATURES`` most
frequent of them at most (the model's size, a bound like the sample's), so that what
reaches the driver is a few indices a document. Every document is scored.

Cases: null or empty text scores the model's intercept; without a positive
label all scores are 0; a document labelled more than once is toxic if any
label says so; null labels and labels without id are ignored; repeated rows and
rows without id are scored like any other; ids and further columns never leave
the JVM; more columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, docs, free, held_out, portable, store

POSITIVES, UNLABELLED = 4_000, 16_000
FEATURES = 20_000
PREFIXES = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.3
#: Largest class prior, and the share of positives that a feature needs to bound it.
MOST_PRIOR, COMMON = 0.9, 0.02
SURE = 0.4
EPOCHS, RATE, RIDGE = 300, 0.1, 4e-4
#: Words whose features are kept at hand, and features counted before they are sent on.
CACHE, HOLD = 100_000, 150_000

WORDS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """A word's own feature and its beginnings."""
    return [f"{word}$", *(word[:k] for k in PREFIXES if len(word) >= k)]


def distinct_words(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, features: set[str]) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(features))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


class Finder:
    """The model's features in a text; words seen before are looked up."""

    def __init__(self, features) -> None:
        self.features, self.seen = features, {}

    def __call__(self, text: str | None) -> set[str]:
        found: set[str] = set()
        if len(self.seen) > CACHE:
            self.seen.clear()
        for word in distinct_words(text):
            own = self.seen.get(word)
            if own is None:
                own = self.seen[word] = tuple(f for f in word_features(word) if f in self.features)
            if own:
                found.update(own)
        return found


def _counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def rows() -> pd.DataFrame:
        found = [(k, f, n) for k, c in counts.items() for f, n in c.items()]
        for c in counts.values():
            c.clear()
        return pd.DataFrame(found, columns=["positive", "feature", "n"])

    for part in parts:
        for positive, text in zip(part["positive"], part["text"], strict=True):
            counts[bool(positive)].update({f for w in distinct_words(text) for f in word_features(w)})
            if sum(map(len, counts.values())) > HOLD:
                yield rows()
    yield rows()


def sample(table: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[DataFrame, float | None]:
    """(positive, text) rows to learn from, and the class prior among the labelled:
    0 without positives, None where nothing else is labelled."""
    marks = (
        labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("positive"))
    )
    n, n_pos = marks.agg(F.count("*"), F.count(F.when(F.col("positive"), 1))).first()
    if not n_pos:
        return table.select(F.lit(True).alias("positive"), "text").limit(0), 0.0

    def part(share: float):
        return F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))

    # At most about `positives` ids, so the broadcast has a fixed bound.
    chosen = F.broadcast(marks.filter("positive").filter(part(positives / n_pos)).select("doc_id"))
    learn = table.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    toxic = learn.join(chosen, "doc_id", "left_semi").select(F.lit(True).alias("positive"), "text")
    rest = learn.filter(part(unlabelled / max(1, table.count()))).select(F.lit(False).alias("positive"), "text")
    return toxic.unionByName(rest), n_pos / n if n_pos < n else None


def fit(rows: list[tuple[bool, list[int]]], features: list[str], prior: float) -> Model:
    """Full-batch Adam on the non-negative PU risk with the logistic loss."""
    y = np.array([r[0] for r in rows], bool)
    sizes = np.array([len(r[1]) for r in rows])
    idx = np.concatenate([np.asarray(r[1], np.int64) for r in rows if r[1]]) if sizes.sum() else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    w, m, v = (np.zeros(len(features) + 1) for _ in range(3))
    n_pos, n_unl = max(1, y.sum()), max(1, (~y).sum())
    w[-1] = np.log(prior / (1 - prior)) if prior < 1 else 3.0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for t in range(1, EPOCHS + 1):
        z = np.bincount(row, weights=w[idx], minlength=len(rows)) + w[-1]
        lose_neg = np.logaddexp(0, z)  # loss if the answer should be "clean"
        negative = lose_neg[~y].sum() / n_unl - prior * lose_neg[y].sum() / n_pos
        p = sig(z)
        up = np.where(y, prior * (p - 1) / n_pos, 0.0)
        down = np.where(y, -prior * p / n_pos, p / n_unl)
        g = up + down if negative >= 0 else -down
        grad = np.append(np.bincount(idx, weights=g[row], minlength=len(features)), g.sum()) + RIDGE * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    # The intercept is set so that the unlabelled documents' mean score is the prior.
    z = (np.bincount(row, weights=w[idx], minlength=len(rows)))[~y]
    low, high = -30.0, 30.0
    for _ in range(60 if len(z) else 0):
        w[-1] = (low + high) / 2
        low, high = (w[-1], high) if sig(z + w[-1]).mean() < prior else (low, w[-1])
    return Model({f: float(x) for f, x in zip(features, w[:-1], strict=True) if abs(x) > 1e-3}, float(w[-1]))


def least_ratio(df: DataFrame, n_pos: int, n_unl: int) -> float:
    """The class prior's estimate from (p, u), a feature's positives and unlabelled."""
    share_p = (F.col("p") - F.sqrt("p")) / n_pos
    share_u = (F.col("u") + F.sqrt("u") + 1) / max(1, n_unl)
    bound = df.filter(F.col("p") >= max(10.0, COMMON * n_pos)).agg(F.min(share_u / share_p)).first()[0]
    return MOST_PRIOR if bound is None else float(bound)


def train(
    table: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None
) -> Model | None:
    """A model, or None without positives. ``prior`` is the share of toxic
    documents among the unlabelled ones, if known."""
    rows, among = sample(table, labels, positives, unlabelled)
    if among == 0:
        return None
    rows = store(rows, "toxicity-sample")
    n_pos = rows.filter("positive").count()
    n_unl = rows.filter("not positive").count()
    if not n_pos:
        return None
    df = (
        rows.mapInPandas(_counts, "positive boolean, feature string, n long").groupBy("feature")
        .agg(F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("positive"), F.col("n")).otherwise(0)).alias("u"))
    )
    if prior is None:
        prior = least_ratio(df, n_pos, n_unl) if among is None else among
    prior = min(prior, MOST_PRIOR)
    # Cautious share of toxic documents among those with the feature, a
    # standard error off either count.
    sure = prior * (F.col("p") - F.sqrt("p")) / n_pos / ((F.col("u") + F.sqrt("u") + 1) / max(1, n_unl))
    kept = df.filter((F.col("p") >= 3) & (sure >= SURE)).orderBy(F.desc("p"), "feature").limit(FEATURES)
    features = [r[0] for r in kept.select("feature").collect()]
    at = {f: i for i, f in enumerate(features)}

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Finder(at)
        for part in parts:
            yield pd.DataFrame({"positive": part["positive"], "ids": [sorted(at[f] for f in find(x)) for x in part["text"]]})

    encoded = rows.mapInPandas(encode, "positive boolean, ids array<int>").collect()
    return fit([(r[0], list(r[1])) for r in encoded], features, prior)


def _scores(table: DataFrame, model: Model | None, out: str = "_out") -> DataFrame:
    """``table`` with its texts' scores in ``out``, a struct of one field."""
    shared = table.sparkSession.sparkContext.broadcast((model.weights, model.bias) if model else None)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value) if shared.value else None
        find = Finder(model.weights if model else {})
        for part in parts:
            yield pd.DataFrame({"score": [model.score(find(x)) if model else 0.0 for x in part]}, dtype=float)

    return by_text(table, run, "score double", out)


def score(table: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, text)."""
    asked = _scores(table.select("doc_id", "text"), model)
    out = asked.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_out.score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(table: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``table`` that the model doesn't reject, all columns as they are."""
    out = free(table, "_out")
    return _scores(table, train(table, labels), out).filter(F.col(out)["score"] < THRESHOLD).select(*[F.col(f"`{c}`") for c in table.columns])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(docs(spark, sf_dir), train(docs(spark, sf_dir), docs(spark, sf_dir, "labels")))


portable(__name__)
