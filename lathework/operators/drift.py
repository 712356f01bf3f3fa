"""Drift statistics between a reference and a current sample of one column.

A frame holds the values and a boolean column that is true for the reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import cumulative, quantiles, with_quantiles

EPS = 1e-10


def bin_counts(df: DataFrame, x: str, ref: str, by: Sequence[str] = (), bins: int = 10, equal_width: bool = False) -> DataFrame:
    """(by, bin, r, c): counts per bin of the reference's quantiles, or of equal
    widths of its range; left-closed, the outer bins open."""
    own = df.filter(F.col(ref) & F.col(x).isNotNull()).groupBy(*by)
    if equal_width:
        edges = own.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        edge = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / F.lit(float(bins)))
        edges = edges.select(*by, edge.alias("_edges"))
    else:
        edges = quantiles(df.filter(F.col(ref)), x, [i / bins for i in range(1, bins)], by, "_edges")
    rows = df.filter(F.col(x).isNotNull())
    if by:  # null is a group like any other
        edges = edges.withColumnsRenamed({k: f"_k_{k}" for k in by})
        rows = rows.join(edges, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by]).drop(*[f"_k_{k}" for k in by])
    else:
        rows = rows.crossJoin(F.broadcast(edges))  # one row
    bin_ = F.size(F.filter("_edges", lambda e: e <= F.col(x)))
    return rows.groupBy(*by, bin_.alias("bin")).agg(F.count_if(ref).alias("r"), F.count_if(~F.col(ref)).alias("c"))


def psi(df: DataFrame, x: str, ref: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Population stability index over the reference's quantile bins, with its band."""
    counts = bin_counts(df, x, ref, by, bins)
    total = counts.groupBy(*by).agg(F.sum("r").alias("_r"), F.sum("c").alias("_c"))
    if by:
        total = total.withColumnsRenamed({k: f"_k_{k}" for k in by})
        both = counts.join(total, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by]).drop(*[f"_k_{k}" for k in by])
    else:
        both = counts.crossJoin(F.broadcast(total))  # one row
    p, q = F.try_divide("r", "_r"), F.try_divide("c", "_c")
    out = both.groupBy(*by).agg(F.sum((q - p) * F.ln((q + EPS) / (p + EPS))).alias("psi"), F.max("_r").alias("n_reference"), F.max("_c").alias("n_current"))
    return out.withColumn("band", F.when(F.col("psi") < 0.1, "none").when(F.col("psi") < 0.25, "moderate").otherwise("large"))


def psi_smoothed(df: DataFrame, x: str, ref: str, bins: int = 10, eps: float = EPS) -> DataFrame:
    """The index with ``eps`` added to the counts of equal-width bins, which are then normalised."""
    return divergences(bin_counts(df, x, ref, (), bins, equal_width=True), "r", "c", eps).select("psi")


def divergences(counts: DataFrame, p: str, q: str, eps: float = EPS) -> DataFrame:
    """psi, kl, js, hellinger, total_variation and chi2 of two columns of counts or shares (one row a bin)."""
    total = counts.agg(F.sum(F.col(p) + eps).alias("_p"), F.sum(F.col(q) + eps).alias("_q"))
    both = counts.crossJoin(F.broadcast(total))  # one row
    a, b = (F.col(p) + eps) / F.col("_p"), (F.col(q) + eps) / F.col("_q")
    m = (a + b) / 2
    return both.agg(
        F.sum((b - a) * F.ln(b / a)).alias("psi"), F.sum(a * F.ln(a / b)).alias("kl"), F.sum(a * F.ln(a / m) / 2 + b * F.ln(b / m) / 2).alias("js"),
        F.sqrt(F.greatest(F.lit(0.0), 1 - F.sum(F.sqrt(a * b)))).alias("hellinger"), (F.sum(F.abs(a - b)) / 2).alias("total_variation"),
        F.sum(F.pow(F.col(q) - F.col(p), F.lit(2)) / (F.col(p) + eps)).alias("chi2"),
    )


def cdf_gaps(df: DataFrame, x: str, ref: str) -> DataFrame:
    """(v, r, c, n_r, n_c, f, g, following): a row a distinct value with both cumulative shares."""
    values = df.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("v")).agg(F.count_if(ref).alias("r"), F.count_if(~F.col(ref)).alias("c"))
    total = values.agg(F.sum("r").alias("n_r"), F.sum("c").alias("n_c"))
    run = cumulative(values, "v", {"_f": "r", "_g": "c"}, following="following").crossJoin(F.broadcast(total))  # one row
    return run.withColumn("f", F.try_divide("_f", "n_r")).withColumn("g", F.try_divide("_g", "n_c")).drop("_f", "_g")


def two_sample(df: DataFrame, x: str, ref: str) -> DataFrame:
    """ks, wasserstein and cramer_von_mises of the two samples, from one pass over the values."""
    gap = F.col("f") - F.col("g")
    out = cdf_gaps(df, x, ref).agg(
        F.max(F.abs(gap)).alias("ks"), F.sum(F.abs(gap) * (F.coalesce("following", "v") - F.col("v"))).alias("wasserstein"),
        F.sum(gap * gap * (F.col("r") + F.col("c"))).alias("_s"), F.max("n_r").alias("n_reference"), F.max("n_c").alias("n_current"),
    )
    n, m = F.col("n_reference").cast("double"), F.col("n_current").cast("double")
    return out.withColumn("cramer_von_mises", F.try_divide(F.col("_s") * n * m, (n + m) * (n + m))).drop("_s")


def anderson_darling(df: DataFrame, x: str, ref: str) -> DataFrame:
    """One row: the squared gap of the two step functions' steps, weighted towards the tails
    by 1 / (i (N - i + 1)) at the i-th place of both samples together, times n m / N. A sample
    without a value steps by nothing there; equal values share the first one's place."""
    n, m = F.col("n_r").cast("double"), F.col("n_c").cast("double")
    at = F.round(F.col("f") * n + F.col("g") * m) - F.col("r") - F.col("c") + 1
    gap = F.when(F.col("r") > 0, F.col("f")).otherwise(0.0) - F.when(F.col("c") > 0, F.col("g")).otherwise(0.0)
    out = cdf_gaps(df, x, ref).agg(F.sum(gap * gap / (at * (n + m - at + 1))).alias("_s"), F.max("n_r").alias("n_reference"), F.max("n_c").alias("n_current"))
    n, m = F.col("n_reference").cast("double"), F.col("n_current").cast("double")
    return out.select("n_reference", "n_current", F.try_divide(F.col("_s") * n * m, n + m).alias("anderson_darling"))


def ks_p_value(ks: float, n: int, m: int, terms: int = 100) -> float:
    """Asymptotic two-sample p-value by Kolmogorov's series."""
    import math

    if not n or not m:
        return float("nan")
    t = ks * math.sqrt(n * m / (n + m))
    if t < 1e-3:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, terms + 1))))


def chi2_categories(df: DataFrame, x: str, ref: str) -> DataFrame:
    """Chi-square of the current counts per category against the reference's counts as
    they are plus ``EPS``, so that a category the reference lacks is drift; null is a
    category of its own."""
    counts = df.groupBy(x).agg(F.count_if(ref).alias("r"), F.count_if(~F.col(ref)).alias("c"))
    return counts.agg(
        F.sum(F.pow(F.col("c") - F.col("r") - EPS, F.lit(2)) / (F.col("r") + EPS)).alias("chi2"), (F.count("*") - 1).alias("df")
    )


def quality_alerts(df: DataFrame, columns: Sequence[str], missing_limit: float = 0.1, z_limit: float = 3.0, rate_limit: float = 0.01) -> DataFrame:
    """(column, missing_rate, outlier_rate, missing_alert, outlier_alert)."""
    from .profile import missing_counts, zscore_outliers

    n = df.agg(F.count("*").alias("_n"))
    missing = missing_counts(df, columns).crossJoin(F.broadcast(n)).select("column", F.try_divide("missing", "_n").alias("missing_rate"))
    out = missing.join(zscore_outliers(df, columns, z_limit).select("column", "outlier_rate"), "column")
    return out.withColumn("missing_alert", F.col("missing_rate") > missing_limit).withColumn("outlier_alert", F.col("outlier_rate") > rate_limit)


def ab_test(df: DataFrame, variant: str, value: str, control: str, treatment: str) -> DataFrame:
    """Pooled-variance t statistic and lift in percent of ``treatment`` over ``control``."""
    s = df.filter(F.col(variant).isin(control, treatment)).groupBy(variant).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    pick = lambda name, c: F.max(F.when(F.col(variant) == name, F.col(c)))
    one = s.agg(*[pick(v, c).alias(f"{c}{i}") for i, v in ((0, control), (1, treatment)) for c in ("n", "m", "v")])
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2)
    t = (F.col("m1") - F.col("m0")) / F.sqrt(pooled * (F.lit(1.0) / F.col("n0") + F.lit(1.0) / F.col("n1")))
    return one.select(
        F.col("n0").alias("n_control"), F.col("n1").alias("n_treatment"), F.col("m0").alias("mean_control"), F.col("m1").alias("mean_treatment"),
        t.alias("t_statistic"), (F.lit(100.0) * (F.col("m1") - F.col("m0")) / F.abs("m0")).alias("lift_percent"),
    )


def variant_summary(df: DataFrame, variant: str, value: str, failed: str) -> DataFrame:
    """(variant, requests, errors, success_rate, mean, std_pop, min, max, median)."""
    out = df.groupBy(F.col(variant).alias("variant")).agg(
        F.count("*").alias("requests"), F.count_if(failed).alias("errors"), (1 - F.count_if(failed) / F.count("*")).alias("success_rate"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std_pop"), F.min(value).alias("min"), F.max(value).alias("max"),
    )
    return with_quantiles(out, value, {"median": 0.5}, ["variant"], df.withColumn("variant", F.col(variant)))


def allocate(df: DataFrame, key: str, weights: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds ``variant``: each key always gets the same one, in proportion to ``weights``,
    by 32 bits of the md5 of seed:key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10)
    u = (bits.cast("long").cast("double") + 0.5) / float(1 << 32)
    total, upto, names = sum(weights.values()), 0.0, list(weights)
    variant = F
    for name in names[:-1]:
        upto += weights[name] / total
        variant = variant.when(u < upto, name)
    return df.withColumn("variant", variant.otherwise(names[-1]) if len(names) > 1 else F.lit(names[0]))
