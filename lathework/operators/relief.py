"""Relief scores: how far a feature's values lie from those of near rows of another
class, against near rows of the same class.

The near rows are searched for a bounded set of rows, those with the least md5 of seed
and id (at most ``MAX_SAMPLES``, sent to every task); every row of the table is a candidate. A task
keeps the k nearest of either kind for each of them while its rows stream by, and
what tasks keep is merged in two steps, so that a sampled row's list is never one task's
alone. Distances are summed feature by feature; ties go to the smaller id.

Rows with a null id, label or feature take no part. Where a row has no near rows of a kind, that
kind's difference is 0; with fewer than k all there are count."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SAMPLES = 2000
SALTS = 32


def _sampled(rows: DataFrame, samples: int, seed: int) -> DataFrame:
    if not 1 <= samples <= MAX_SAMPLES:
        raise ValueError(f"between 1 and {MAX_SAMPLES} rows can be sampled")
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), "id").limit(samples)


def normalised(df: DataFrame, key: str, features: Sequence[str], label: str, scale: str) -> DataFrame:
    """(id, label, x): features moved to [0, 1] (``minmax``) or to mean 0 and deviation 1
    (``standard``); a constant feature becomes 0."""
    kept = df.select(F.col(key).alias("id"), F.col(label).alias("label"), *[F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f"_x{i}") for i, f in enumerate(features)]).dropna()
    low, wide = (F.min, lambda c: F.max(c) - F.min(c)) if scale == "minmax" else (F.avg, F.stddev_pop)
    at = kept.agg(*[low(f"_x{i}") for i in range(len(features))], *[wide(f"_x{i}") for i in range(len(features))]).first()
    base, span = at[: len(features)], at[len(features) :]
    span = [(s or 1.0) if scale == "minmax" else (s or 0.0) + 1e-10 for s in span]
    return kept.select("id", "label", F.array(*[(F.col(f"_x{i}") - F.lit(base[i])) / F.lit(span[i]) for i in range(len(features))]).alias("x"))


def near_rows(rows: DataFrame, own: DataFrame, k: int, by_class: bool = True) -> DataFrame:
    """(own, same, place, d, id, label, x, at, own_label): for each row of ``own`` its k nearest
    others of the same label and of other labels (or of all, ``same`` being true). ``d`` is the squared distance."""
    spark = rows.sparkSession
    held = own.collect()  # at most MAX_SAMPLES rows
    asked = spark.sparkContext.broadcast(([r["id"] for r in held], [str(r["label"]) for r in held], np.array([r["x"] for r in held], float)))

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, points = asked.value
        labels, best = np.array(labels, object), {}
        for part in parts:
            if not len(part):
                continue
            x, other, kind = np.stack(part["x"].to_numpy()), part["id"].to_numpy(), part["label"].to_numpy()
            d = np.zeros((len(ids), len(x)))
            for j in range(points.shape[1]):
                d += (points[:, j, None] - x[None, :, j]) ** 2
            for i, own_id in enumerate(ids):
                alike = kind == labels[i] if by_class else np.ones(len(x), bool)
                for same in (True, False):
                    at = np.flatnonzero((alike == same) & (other != own_id))
                    if len(at) > k:
                        last = np.partition(d[i, at], k - 1)[k - 1]
                        at = at[d[i, at] <= last]
                    found = best.get((i, same), []) + [(d[i, r], other[r], kind[r], x[r]) for r in at]
                    best[i, same] = sorted(found, key=lambda f: f[:2])[:k]
        out = [(ids[i], same, d, o, label, x.tolist()) for (i, same), found in best.items() for d, o, label, x in found]
        yield pd.DataFrame(out, columns=["own", "same", "d", "id", "label", "x"])

    kept = rows.select("id", F.col("label").cast("string").alias("label"), "x").mapInPandas(keep, f"own {rows.schema['id'].dataType.simpleString()}, same boolean, d double, id {rows.schema['id'].dataType.simpleString()}, label string, x array<double>")
    kept = kept.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    some = Window.partitionBy("own", "same", "_salt").orderBy("d", "id")
    all_ = Window.partitionBy("own", "same").orderBy("d", "id")
    kept = kept.withColumn("_r", F.row_number().over(some)).filter(F.col("_r") <= k).withColumn("place", F.row_number().over(all_)).filter(F.col("place") <= k)
    sampled = F.broadcast(own.select(F.col("id").alias("own"), F.col("x").alias("at"), F.col("label").cast("string").alias("own_label")))
    return kept.drop("_r", "_salt").join(sampled, "own")


def _scores(per_feature: DataFrame, names: Sequence[str], value: Column, total: int) -> DataFrame:
    """(feature, score): ``value`` (of a row's mean differences hit and miss) averaged over rows."""
    named = F.get(F.array(*map(F.lit, names)), F.col("j")).alias("feature")
    return per_feature.groupBy("j").agg((F.sum(value) / total).alias("score")).select(named, "score")


def _differences(near: DataFrame, *more: Column) -> DataFrame:
    """A row a near row and feature, with the absolute difference as v."""
    gaps = F.zip_with("at", "x", lambda a, b: F.abs(a - b))
    return near.select("own", "same", *more, F.posexplode(gaps).alias("j", "v"))


def relief(df: DataFrame, key: str, features: Sequence[str], label: str, k: int = 10, samples: int = 500, seed: int = 0, scale: str = "minmax") -> DataFrame:
    """(feature, score): mean difference to the k nearest misses less that to the k nearest hits."""
    rows = normalised(df, key, features, label, scale)
    own = _sampled(rows, samples, seed)
    diffs = _differences(near_rows(rows, own, k))
    per = diffs.groupBy("own", "j").agg(F.avg(F.when(F.col("same"), F.col("v"))).alias("hit"), F.avg(F.when(~F.col("same"), F.col("v"))).alias("miss"))
    zero = F.lit(0.0)
    return _scores(per, features, F.coalesce("miss", zero) - F.coalesce("hit", zero), own.count())


def filter_relief(df: DataFrame, key: str, features: Sequence[str], target: str, k: int = 10, samples: int = 500, seed: int = 0, classify: bool = True) -> DataFrame:
    """(feature, score), moved so that the least is 0. Features are standardised. Classes: as
    ``relief``, over rows with both hits and misses. Numbers: the mean of a near row's difference times its
    target's, taken off."""
    rows = normalised(df, key, features, target, "standard")
    own = _sampled(rows, samples, seed)
    near = near_rows(rows, own, k, classify)
    if classify:
        per = _differences(near).groupBy("own", "j").agg(F.avg(F.when(F.col("same"), F.col("v"))).alias("hit"), F.avg(F.when(~F.col("same"), F.col("v"))).alias("miss"))
        value = F.coalesce(F.col("miss") - F.col("hit"), F.lit(0.0))
    else:
        moved = F.abs(F.col("own_label").cast("double") - F.col("label").cast("double")).alias("t")
        per = _differences(near, moved).groupBy("own", "j").agg(F.avg(F.col("v") * F.col("t")).alias("vt"))
        value = -F.col("vt")
    out = _scores(per, features, value, own.count())
    least = out.agg(F.min("score").alias("_least"))
    return out.crossJoin(F.broadcast(least)).select("feature", (F.col("score") - F.col("_least")).alias("score"))  # one row


def relief_f(df: DataFrame, key: str, features: Sequence[str], label: str, k: int = 10, samples: int = 500, seed: int = 0, weight_by_distance: bool = True) -> DataFrame:
    """(feature, score): over the k nearest rows of any class, each weighing the reciprocal of its
    distance (or all alike), the difference to other classes, times their share of all rows, less that
    to the own class."""
    rows = normalised(df, key, features, label, "minmax")
    own = _sampled(rows, samples, seed)
    near = near_rows(rows, own, k)
    nearest = Window.partitionBy("own").orderBy("d", "id")
    near = near.withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") <= k)
    w = 1 / (F.sqrt("d") + 1e-10) if weight_by_distance else F.lit(1.0)
    near = near.withColumn("_w", w).withColumn("_w", F.col("_w") / F.sum("_w").over(Window.partitionBy("own")))
    shares = rows.groupBy(F.col("label").cast("string").alias("label")).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_all"))
    near = near.join(shares, "label").crossJoin(F.broadcast(total))  # one row
    diffs = _differences(near, "_w", (F.col("_n") / F.col("_all")).alias("_p"))
    part = F.col("_w") * F.col("v")
    per = diffs.groupBy("own", "j").agg(F.sum(F.when(F.col("same"), -part).otherwise(part * F.col("_p"))).alias("gain"))
    return _scores(per, features, F.col("gain"), own.count())
