"""Models that are aggregates: fit is a group-by, prediction a join and a projection."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .nearest import nearest
from .ordered import with_quantiles
from .scores import unpivot

#: Test rows of one block of nearest neighbours, which is broadcast as one row.
BLOCK = 20_000


def featureless_classif(train: DataFrame, label: str) -> DataFrame:
    """(label, prior, is_mode): class shares; the mode, the least label on a tie."""
    k = train.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = k.agg(F.sum("n").alias("_t"), F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("_m"))
    return k.crossJoin(F.broadcast(total)).select("label", (F.col("n") / F.col("_t")).alias("prior"), (F.col("label") == F.col("_m")).alias("is_mode"))  # one row


def featureless_regr(train: DataFrame, target: str) -> DataFrame:
    """One row: mean, median and standard error of the mean."""
    out = train.agg(F.avg(target).alias("mean"), (F.stddev_samp(target) / F.sqrt(F.count(target))).alias("se"))
    return with_quantiles(out, target, {"median": 0.5}, of=train)


def gaussian_nb(train: DataFrame, test: DataFrame, row_id: str, features: Sequence[str], label: str, smoothing: float = 1e-9) -> DataFrame:
    """(row_id, response, log_lik): naive Bayes with population variances plus
    ``smoothing`` times the largest one; ties go to the least label."""
    rows = unpivot(train, features, [label])
    stats = rows.groupBy(label, "feature").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count("*").alias("n"))
    most = stats.agg(F.max("v").alias("_mv"))
    total = train.agg(F.count("*").alias("_n"))
    model = stats.crossJoin(F.broadcast(most)).crossJoin(F.broadcast(total))  # one row each
    model = model.select(label, "feature", "m", (F.col("v") + smoothing * F.col("_mv")).alias("v"), F.ln(F.col("n") / F.col("_n")).alias("prior"))
    scored = unpivot(test, features, [row_id]).join(F.broadcast(model), "feature")  # a row a class and feature
    log = -0.5 * (F.ln(2 * F.lit(pi) * F.col("v")) + F.pow(F.col("value") - F.col("m"), F.lit(2)) / F.col("v"))
    per = scored.groupBy(row_id, label).agg((F.sum(log) + F.max("prior")).alias("log_lik"))
    return per.groupBy(row_id).agg(F.min_by(F.col(label), F.struct(-F.col("log_lik"), F.col(label))).alias("response"), F.max("log_lik").alias("log_lik"))


def linear_fit(train: DataFrame, features: Sequence[str], target: str, ridge: float = 0.0) -> dict[str, float]:
    """Coefficients by the normal equations: one aggregate of products, solved on
    the driver (a matrix as wide as the features). The intercept isn't penalised."""
    import numpy as np

    names = ["_one", *features]
    df = train.withColumn("_one", F.lit(1.0))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"g{i}") for i, (a, b) in enumerate(pairs)], *[F.sum(F.col(a) * F.col(target)).alias(f"y{i}") for i, a in enumerate(names)]).first()
    g = np.zeros((len(names), len(names)))
    for i, (a, b) in enumerate(pairs):
        g[names.index(a), names.index(b)] = g[names.index(b), names.index(a)] = row[f"g{i}"]
    g += ridge * np.diag([0.0] + [1.0] * len(features))
    w = np.linalg.lstsq(g, np.array([row[f"y{i}"] for i in range(len(names))]), rcond=None)[0]
    return dict(zip(["intercept", *features], map(float, w), strict=True))


def simple_linear(train: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """slope, intercept and r2 of one feature, by group."""
    return train.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def knn(train: DataFrame, test: DataFrame, row_id: str, features: Sequence[str], target: str, k: int = 5, classify: bool = True, metric: str = "euclidean", weights: str = "uniform") -> DataFrame:
    """k nearest training rows by euclidean or manhattan distance, ties by id: the
    majority label (least on a tie) or the mean, each neighbour counting once or, with
    ``weights`` distance, by the reciprocal of its distance (1e10 at none). ``test`` goes in blocks of about ``BLOCK`` rows
    by hash, each compared with the chunks of training rows that can hold a neighbour (see ``nearest``).

    Training rows with a null or NaN feature, or without target, are nobody's neighbours;
    a row of ``test`` with such a feature has no neighbours and a null response."""
    nan = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
    names = [f"_x{i}" for i in range(len(features))]
    at = [nan(f).alias(x) for f, x in zip(features, names, strict=True)]
    rows = train.select(F.col(row_id).alias("_id"), F.col(target).alias("_y"), *at).filter("_y is not null").dropna(subset=names)
    asked = test.select(F.col(row_id).alias("_q"), *at)
    best = nearest(rows, asked.dropna(subset=names), names, k, metric, BLOCK)
    weight = F.when(F.col("_d") > 0, 1 / F.col("_d")).otherwise(1e10) if weights == "distance" else F.lit(1.0)
    if not classify:
        found = best.groupBy("_q").agg((F.sum(F.col("_y") * weight) / F.sum(weight)).alias("response"))
    else:
        votes = best.groupBy("_q", F.col("_y").alias("_l")).agg(F.sum(weight).alias("_n"))
        found = votes.groupBy("_q").agg(F.min_by("_l", F.struct(-F.col("_n"), F.col("_l"))).alias("response"))
    every = asked.select("_q", F.lit(None).cast(found.schema["response"].dataType).alias("response")).unionByName(found)
    return every.groupBy(F.col("_q").alias(row_id)).agg(F.max("response").alias("response"))  # null where there is no neighbour


def vote(predictions: Sequence[DataFrame], row_id: str, weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted majority of (row_id, response) tables; the least response on a tie."""
    weights = weights or [1.0] * len(predictions)
    both = None
    for df, w in zip(predictions, weights, strict=True):
        one = df.select(row_id, "response", F.lit(float(w)).alias("_w"))
        both = one if both is None else both.unionByName(one)
    sums = both.groupBy(row_id, "response").agg(F.sum("_w").alias("_w"))
    return sums.groupBy(row_id).agg(F.min_by("response", F.struct(-F.col("_w"), F.col("response"))).alias("response"))
