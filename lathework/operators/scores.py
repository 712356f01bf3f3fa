"""Feature scores: (feature, score) tables from one aggregate over the features,
unpivoted to (feature, target, value) rows where a score needs ranks or bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import rows_per_column


def unpivot(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, feature, value): a row a feature and row."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "_p.value")


def variance(df: DataFrame, features: Sequence[str], population: bool = False, normalize: bool = False) -> DataFrame:
    """Variance, divided by the mean's size if ``normalize``."""
    var = F.var_pop if population else F.var_samp
    score = lambda c: F.try_divide(var(c), F.abs(F.avg(c))) if normalize else var(c)
    return rows_per_column(df, features, score=score).withColumnRenamed("column", "feature")


def pearson(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Absolute correlation with the target; 0 where undefined."""
    score = lambda c: F.coalesce(F.abs(F.corr(c, target)), F.lit(0.0))
    return rows_per_column(df, features, score=score).withColumnRenamed("column", "feature")


def f_regression(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    r2 = lambda c: F.pow(F.corr(c, target), F.lit(2))
    score = lambda c: F.coalesce(F.try_divide(r2(c) * (F.count("*") - 2), 1 - r2(c)), F.lit(0.0))
    return rows_per_column(df, features, score=score).withColumnRenamed("column", "feature")


def anova(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One-way F of each feature over the classes; values are centred first, so
    that no digits cancel. 0 where undefined."""
    rows = unpivot(df, features, [label]).filter("value is not null")
    centre = rows.groupBy("feature").agg(F.avg("value").alias("_c"))
    rows = rows.join(F.broadcast(centre), "feature").withColumn("v", F.col("value") - F.col("_c"))  # a row a feature
    g = rows.groupBy("feature", label).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    t = g.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b")
    )
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b")
    score = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(within, F.col("n") - F.col("k")))
    return t.select("feature", F.coalesce(score, F.lit(0.0)).alias("score"))


def chi_squared(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Chi-square of each feature's sums per class against its total split by class sizes; negatives count as 0."""
    rows = unpivot(df, features, [label]).withColumn("v", F.greatest("value", F.lit(0.0)))
    o = rows.groupBy("feature", label).agg(F.sum("v").alias("o"), F.count("*").alias("n"))
    t = o.groupBy("feature").agg(F.sum("o").alias("t"), F.sum("n").alias("_n"))
    e = F.col("t") * F.col("n") / F.col("_n")
    return o.join(F.broadcast(t), "feature").groupBy("feature").agg(F.coalesce(F.sum(F.try_divide(F.pow(F.col("o") - e, F.lit(2)), e)), F.lit(0.0)).alias("score"))  # a row a feature


def binned(df: DataFrame, features: Sequence[str], label: str, n: int = 10, strategy: str = "uniform") -> DataFrame:
    """(feature, bin, label, k): joint counts after cutting each feature into left-closed bins."""
    rows = unpivot(df, features, [label]).filter("value is not null")
    if strategy == "uniform":
        lo, hi = F.min("value"), F.max("value")
        edges = rows.groupBy("feature").agg(F.array(*[lo + (hi - lo) * F.lit(i / n) for i in range(1, n)]).alias("_e"))
    else:
        edges = rows.groupBy("feature").agg(F.percentile("value", F.array(*[F.lit(i / n) for i in range(1, n)])).alias("_e"))
    rows = rows.join(F.broadcast(edges), "feature")  # a row a feature
    return rows.groupBy("feature", F.size(F.filter("_e", lambda e: e <= F.col("value"))).alias("bin"), F.col(label).alias("label")).agg(F.count("*").alias("k"))


def information(counts: DataFrame) -> DataFrame:
    """(feature, info_gain, gain_ratio, sym_uncertainty) in bits, from joint counts."""
    k = counts.withColumn("n", F.sum("k").over(Window.partitionBy("feature")))  # a row a bin and class
    entropy = lambda c: -F.sum(F.col(c) / F.col("n") * F.log2(F.col(c) / F.col("n")))
    hx = k.groupBy("feature", "bin", "n").agg(F.sum("k").alias("x")).groupBy("feature").agg(entropy("x").alias("hx"))
    hy = k.groupBy("feature", "label", "n").agg(F.sum("k").alias("y")).groupBy("feature").agg(entropy("y").alias("hy"))
    hxy = k.groupBy("feature").agg(entropy("k").alias("hxy"))
    gain = F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - F.col("hxy"))
    return hx.join(hy, "feature").join(hxy, "feature").select(
        "feature", gain.alias("info_gain"), (gain / F.greatest("hx", F.lit(0.01))).alias("gain_ratio"),
        F.least(F.lit(1.0), F.coalesce(F.try_divide(2 * gain, F.col("hx") + F.col("hy")), F.lit(0.0))).alias("sym_uncertainty"),
    )


def prune_correlated(correlations: DataFrame, scores: DataFrame, features: Sequence[str], limit: float = 0.95) -> list[str]:
    """Features left after dropping, in column order, the less important one of
    each pair over ``limit``; ties keep the first. Both tables are small."""
    score = {r["feature"]: r["score"] or 0.0 for r in scores.select("feature", "score").collect()}
    high = {frozenset((r["x"], r["y"])) for r in correlations.filter(F.abs("corr") > limit).collect()}
    dropped: set[str] = set()
    for i, a in enumerate(features):
        for b in features[i + 1 :]:
            if a not in dropped and b not in dropped and frozenset((a, b)) in high:
                dropped.add(b if score.get(a, 0.0) >= score.get(b, 0.0) else a)
    return [f for f in features if f not in dropped]


def mrmr(relevance: DataFrame, correlations: DataFrame, k: int) -> list[str]:
    """Greedy choice by relevance less mean absolute correlation with those chosen; both tables are small."""
    rel = {r["feature"]: r["score"] for r in relevance.collect()}
    cor = {frozenset((r["x"], r["y"])): abs(r["corr"] or 0.0) for r in correlations.collect()}
    chosen: list[str] = []
    while rel and len(chosen) < k:
        worth = lambda f: rel[f] - (sum(cor.get(frozenset((f, c)), 0.0) for c in chosen) / len(chosen) if chosen else 0.0)
        best = min(rel, key=lambda f: (-worth(f), f))
        chosen.append(best)
        del rel[best]
    return chosen


# rankings of a (feature, filter, score) table


def ranked(scores: DataFrame, by: str = "filter", item: str = "feature", minimize: bool = False) -> DataFrame:
    """Adds min-max ``norm`` (0.5 if constant) and the average ``rank`` inside each filter, best first."""
    w = Window.partitionBy(by)  # a row an item
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    norm = F.coalesce(F.try_divide(F.col("score") - lo, hi - lo), F.lit(0.5))
    order = F.asc("score") if minimize else F.desc("score")
    tie = F.count("*").over(Window.partitionBy(by, "score"))
    return scores.withColumn("norm", norm).withColumn("rank", F.rank().over(w.orderBy(order)) + (tie - 1) / F.lit(2.0))


def ensemble(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(feature, mean, median, mean_rank, borda, weighted): how the filters agree on each feature."""
    r = ranked(scores)
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("filter")], F.lit(0.0)) if weights else F.lit(1.0)
    n = scores.select(F.count_distinct("feature").alias("_p"))
    return r.crossJoin(F.broadcast(n)).groupBy("feature").agg(  # one row
        F.avg("norm").alias("mean"), F.percentile("norm", F.lit(0.5)).alias("median"), F.avg("rank").alias("mean_rank"), F.sum(F.col("_p") - F.col("rank")).alias("borda"),
        F.try_divide(F.sum(F.col("norm") * w), F.sum(w)).alias("weighted"),
    )


def rank_learners(scores: DataFrame, minimize: bool = False) -> DataFrame:
    """(learner, mean_rank, final_rank) from (task, learner, score): average ranks by task, ties by name."""
    r = ranked(scores, "task", "learner", minimize).groupBy("learner").agg(F.round(F.avg("rank"), 3).alias("mean_rank"))
    return r.withColumn("final_rank", F.row_number().over(Window.orderBy("mean_rank", "learner")))  # a row a learner


def friedman(scores: DataFrame) -> DataFrame:
    """Friedman's statistic with the tie correction, n tasks and k learners."""
    r = ranked(scores, "task", "learner")
    ties = r.groupBy("task", "score").agg(F.count("*").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("_ties"))
    sums = r.groupBy("learner").agg(F.sum("rank").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("_s2"), F.count("*").alias("k"))
    n = r.agg(F.count_distinct("task").alias("n"))
    both = sums.crossJoin(n).crossJoin(ties)  # one row each
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    stat = 12 / (n * k * (k + 1)) * F.col("_s2") - 3 * n * (k + 1)
    return both.select("n", "k", F.try_divide(stat, 1 - F.col("_ties") / (n * k * (k * k - 1))).alias("statistic"))


def aggregate_scores(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """mean, std_samp (0 for one), std_pop, min, max and median of scores that are numbers."""
    ok = scores.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return ok.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std_samp"), F.stddev_pop("score").alias("std_pop"), F.min("score").alias("min"), F.max("score").alias("max"), F.percentile("score", F.lit(0.5)).alias("median")
    )


def kruskal(scores: DataFrame) -> DataFrame:
    """Kruskal-Wallis H of learners' scores over all tasks together, with the tie correction."""
    r = ranked(scores.withColumn("_all", F.lit(1)), "_all", "learner")  # a row a task and learner
    n = r.agg(F.count("*").cast("double").alias("n"))
    ties = r.groupBy("score").agg(F.count("*").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("_ties"))
    sums = r.groupBy("learner").agg((F.pow(F.sum("rank"), F.lit(2)) / F.count("*")).alias("q")).agg(F.sum("q").alias("_q"), F.count("*").alias("k"))
    both = sums.crossJoin(n).crossJoin(ties)  # one row each
    h = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("_q") - 3 * (F.col("n") + 1)
    return both.select(F.col("n").cast("long").alias("n"), "k", F.try_divide(h, 1 - F.col("_ties") / (F.pow("n", F.lit(3)) - F.col("n"))).alias("statistic"))


def one_way(scores: DataFrame) -> DataFrame:
    """One-way F of learners' scores."""
    out = anova(scores.withColumnRenamed("score", "_x"), ["_x"], "learner")
    return out.select(F.col("score").alias("statistic"))


#: Studentised range at 5 % over the square root of two, by number of learners from two.
NEMENYI = (1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164)


def nemenyi(scores: DataFrame) -> DataFrame:
    """(a, b, difference, critical, differs): average ranks of two learners against the
    critical difference at 5 %, for two to ten learners."""
    r = ranked(scores, "task", "learner").groupBy("learner").agg(F.avg("rank").alias("r"), F.count("*").alias("n"))
    k = r.agg(F.count("*").alias("k"))
    critical = F.get(F.array(*map(F.lit, NEMENYI)), F.col("k") - 2) * F.sqrt(F.col("k") * (F.col("k") + 1) / (6 * F.col("n")))
    pairs = r.select(F.col("learner").alias("a"), F.col("r").alias("_a"), "n").join(r.select(F.col("learner").alias("b"), F.col("r").alias("_b")), F.col("a") < F.col("b"))  # a row a learner
    out = pairs.crossJoin(F.broadcast(k)).withColumn("difference", F.abs(F.col("_a") - F.col("_b"))).withColumn("critical", critical)  # one row
    return out.select("a", "b", "difference", "critical", (F.col("difference") > F.col("critical")).alias("differs"))
