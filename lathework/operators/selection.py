"""Choosing features by their scores, and scores of pairs of features.

Score tables have a row a feature. What is chosen is decided on the driver (a
list as long as the features), as it names columns; the rows stay in Spark."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scores as S
from .ordered import quantiles

#: Filters by short id: (frame, features, target) to (feature, score).
FILTERS: dict[str, Callable[[DataFrame, Sequence[str], str], DataFrame]] = {
    "variance": lambda df, features, target: S.variance(df, features),
    "correlation": S.pearson,
    "f_regression": S.f_regression,
    "anova": S.anova,
    "chi2": S.chi_squared,
    "info_gain": lambda df, features, target: S.information(S.binned(df, features, target)).select("feature", F.col("info_gain").alias("score")),
    "gain_ratio": lambda df, features, target: S.information(S.binned(df, features, target)).select("feature", F.col("gain_ratio").alias("score")),
    "sym_uncertainty": lambda df, features, target: S.information(S.binned(df, features, target)).select("feature", F.col("sym_uncertainty").alias("score")),
}
FOR_CLASSES = ("anova", "chi2", "info_gain", "gain_ratio", "sym_uncertainty")
FOR_NUMBERS = ("variance", "correlation", "f_regression")


def create_filter(name: str, numeric_target: bool = False):
    """The filter of a short id; ``auto`` is F by classes, or of a regression."""
    name = ("f_regression" if numeric_target else "anova") if name == "auto" else name
    if name not in FILTERS:
        raise ValueError(f"no filter {name}; known: {', '.join(sorted(FILTERS))}")
    return FILTERS[name]


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best scores, ties by name."""
    return scores.orderBy(F.desc("score"), "feature").limit(k)


def threshold(scores: DataFrame, least: float) -> DataFrame:
    return scores.filter(F.col("score") >= least)


def percentile(scores: DataFrame, percent: float) -> DataFrame:
    """Scores from the given percentile (linear) of all scores up."""
    q = quantiles(scores, "score", [percent / 100]).select(F.get("_q", F.lit(0)).alias("_least"))
    return scores.crossJoin(F.broadcast(q)).filter(F.col("score") >= F.col("_least")).drop("_least")  # one row


def ranks(scores: DataFrame, most: int | None = None) -> DataFrame:
    """Adds ``rank`` from 1, best first, ties by name; up to ``most`` of them."""
    out = scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "feature")))  # a row a feature
    return out if most is None else out.filter(F.col("rank") <= most)


def select(df: DataFrame, features: Sequence[str], chosen: DataFrame) -> DataFrame:
    """``df`` without the features that ``chosen`` lacks; columns stay in their order."""
    names = {r["feature"] for r in chosen.select("feature").collect()}
    return df.select(*[c for c in df.columns if c not in features or c in names])


def filter_columns(df: DataFrame, features: Sequence[str], target: str, method: str = "auto", k: int | None = None, least: float | None = None, percent: float | None = None, numeric_target: bool = False) -> DataFrame:
    """``df`` with the features that a filter chooses: k of them, those with a score,
    those from a percentile, or the better half if nothing is said."""
    scored = create_filter(method, numeric_target)(df, features, target)
    if k is not None:
        return select(df, features, top_k(scored, k))
    if least is not None:
        return select(df, features, threshold(scored, least))
    if percent is not None:
        return select(df, features, percentile(scored, percent))
    return select(df, features, top_k(scored, max(1, len(features) // 2)))


def cumulative_ranking(df: DataFrame, features: Sequence[str], target: str, filters: Sequence[str] = FOR_CLASSES) -> DataFrame:
    """(feature, mean_rank, score): average ranks over filters, score p + 1 - rank."""
    every = None
    for name in filters:
        one = create_filter(name)(df, features, target).select("feature", F.lit(name).alias("filter"), F.col("score").cast("double").alias("score"))
        every = one if every is None else every.unionByName(one)
    per = S.ranked(every).groupBy("feature").agg(F.avg("rank").alias("mean_rank"))
    return per.withColumn("score", F.lit(len(features) + 1) - F.col("mean_rank"))


def quick_selection(df: DataFrame, features: Sequence[str], target: str, n: int = 30, filters: Sequence[str] = FOR_CLASSES) -> DataFrame:
    return top_k(cumulative_ranking(df, features, target, filters), n)


# pairs of features


#: Criteria that ``greedy`` knows.
JOINT = ("jmi", "jmim", "cmim", "disr", "mifs")


def bin_codes(df: DataFrame, features: Sequence[str], label: str, n: int = 10) -> DataFrame:
    """(features as codes of equal-width bins, label)."""
    box = df.agg(*[F.min(f).cast("double").alias(f"_lo_{f}") for f in features], *[F.max(f).cast("double").alias(f"_hi_{f}") for f in features])
    both = df.select(*features, label).crossJoin(F.broadcast(box))  # one row
    code = lambda f: F.size(F.filter(F.array(*[F.col(f"_lo_{f}") + (F.col(f"_hi_{f}") - F.col(f"_lo_{f}")) * F.lit(i / n) for i in range(1, n)]), lambda e: e <= F.col(f)))
    return both.select(*[code(f).alias(f) for f in features], F.col(label).alias("label"))


def pair_information(df: DataFrame, features: Sequence[str], label: str, n: int = 10) -> DataFrame:
    """(a, b, joint, redundancy, h) in bits: what two features tell of the label
    together, what they tell of each other, and their joint entropy with it. Codes are
    counted once; every pair's counts are sums of those."""
    codes = bin_codes(df, features, label, n).groupBy(*features, "label").agg(F.count("*").alias("k"))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs]))
    rows = codes.select(each.alias("p"), "label", "k").groupBy("p.a", "p.b", "p.x", "p.y", "label").agg(F.sum("k").alias("k"))
    total = rows.groupBy("a", "b").agg(F.sum("k").alias("t"))

    def entropy(keys: Sequence[str], name: str) -> DataFrame:
        c = rows.groupBy("a", "b", *keys).agg(F.sum("k").alias("c")).join(F.broadcast(total), ["a", "b"])  # a row a pair
        return c.groupBy("a", "b").agg((-F.sum(F.col("c") / F.col("t") * F.log2(F.col("c") / F.col("t")))).alias(name))

    out = entropy(["x"], "hx")
    for keys, name in ((["y"], "hy"), (["label"], "hl"), (["x", "y"], "hxy"), (["x", "y", "label"], "h")):
        out = out.join(entropy(keys, name), ["a", "b"])
    return out.select("a", "b", (F.col("hxy") + F.col("hl") - F.col("h")).alias("joint"), (F.col("hx") + F.col("hy") - F.col("hxy")).alias("redundancy"), "h")


def greedy(relevance: dict[str, float], pairs: dict[frozenset, dict[str, float]], k: int, method: str) -> list[str]:
    """Features in the order a criterion picks them, ties by name; both tables are as
    small as the features. ``jmi`` takes the mean joint information with those picked,
    ``jmim`` the least, ``cmim`` the least that a feature adds to a picked one, ``disr`` the
    mean share of the joint entropy, ``mifs`` relevance less mean redundancy."""
    picked: list[str] = []
    left = dict(relevance)

    def worth(f: str) -> float:
        of = [pairs[frozenset((f, c))] for c in picked]
        if not of:
            return relevance[f]
        if method == "jmi":
            return sum(p["joint"] for p in of) / len(of)
        if method == "jmim":
            return min(p["joint"] for p in of)
        if method == "cmim":
            return min([relevance[f], *(p["joint"] - relevance[c] for p, c in zip(of, picked, strict=True))])
        if method == "disr":
            return sum(p["joint"] / p["h"] if p["h"] else 0.0 for p in of) / len(of)
        return relevance[f] - sum(p["redundancy"] for p in of) / len(of)

    while left and len(picked) < k:
        best = min(left, key=lambda f: (-round(worth(f), 12), f))
        picked.append(best)
        del left[best]
    return picked


def joint_tables(df: DataFrame, features: Sequence[str], label: str, n: int = 10) -> tuple[dict[str, float], dict[frozenset, dict[str, float]]]:
    """What ``greedy`` takes: each feature's information on the label and each pair's, on equal-width bins."""
    relevance = {r["feature"]: r["info_gain"] for r in S.information(S.binned(df, features, label, n)).collect()}
    pairs = {frozenset((r["a"], r["b"])): r.asDict() for r in pair_information(df, features, label, n).collect()}
    return relevance, pairs


def joint_selection(df: DataFrame, features: Sequence[str], label: str, k: int, method: str = "jmim", n: int = 10) -> list[str]:
    """CMIM, JMI, JMIM, DISR or MIFS on equal-width bins."""
    if method not in JOINT:
        raise ValueError(f"no criterion {method}")
    return greedy(*joint_tables(df, features, label, n), k, method)


def jaccard(chosen: DataFrame, by: str = "iter", item: str = "feature") -> DataFrame:
    """Mean Jaccard similarity over pairs of selections, (by, item) rows; a list a selection is as long as the features."""
    sets = chosen.groupBy(by).agg(F.collect_set(item).alias("s"))
    other = sets.select(F.col(by).alias("_b"), F.col("s").alias("t"))
    both = sets.join(other, F.col(by) < F.col("_b"))  # a row a selection
    return both.agg(F.count("*").alias("pairs"), F.avg(F.size(F.array_intersect("s", "t")) / F.size(F.array_union("s", "t"))).alias("jaccard"))
