"""Time-ordered features: lags, trailing row windows, splits and regularity.

With a series key a window is a series; without one the whole table is one
ordered sequence, which is what the functions do only if asked (``series`` None)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import positions, positions_within, with_quantiles

ROLLING = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count}


def _window(series: Sequence[str] | str | None, order: Sequence[str]):
    keys = [series] if isinstance(series, str) else list(series or ())
    return Window.partitionBy(*keys).orderBy(*order)


def lags(df: DataFrame, columns: Sequence[str], ks: Sequence[int], order: Sequence[str], series=None, drop_null: bool = True) -> DataFrame:
    """Adds <c>_lag_<k>; rows that lack one are dropped if ``drop_null``."""
    w = _window(series, order)
    new = {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in ks}
    out = df.withColumns(new)
    return out.dropna(subset=list(new)) if drop_null else out


def rolling(df: DataFrame, columns: Sequence[str], size: int, functions: Sequence[str], order: Sequence[str], series=None, leak_free: bool = False, full: bool = False) -> DataFrame:
    """Adds <c>_rolling_<f>_<size> over the last ``size`` rows, the current one
    included unless ``leak_free``; ``full`` leaves null until the window is full."""
    frame = (-size, -1) if leak_free else (1 - size, 0)
    w = _window(series, order).rowsBetween(*frame)
    value = lambda f, c: F.when(F.count(c).over(w) >= size, ROLLING[f](c).over(w)) if full else ROLLING[f](c).over(w)
    return df.withColumns({f"{c}_rolling_{f}_{size}": value(f, c) for c in columns for f in functions})


def supervised(df: DataFrame, target: str, order: Sequence[str], series=None, n_lags: int = 5, windows: Sequence[int] = (3, 7, 14), leak_free: bool = False) -> DataFrame:
    """Lags 1 to ``n_lags`` and rolling mean and deviation; rows that lack any are dropped."""
    out = lags(df, [target], range(1, n_lags + 1), order, series, drop_null=False)
    for size in windows:
        out = rolling(out, [target], size, ["mean", "std"], order, series, leak_free)
    return out.dropna(subset=[c for c in out.columns if c not in df.columns])


def temporal_split(df: DataFrame, order: str, train: float = 0.8, test: float | None = None, gap: int = 0) -> DataFrame:
    """Adds ``split``: train, test, or null for rows in the gap or beyond. ``order``
    has distinct numbers; shares are cut down to whole rows."""
    placed = positions(df, order, "_at").crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))  # one row
    n_train = F.floor(F.col("_n") * F.lit(train))
    n_test = F.floor(F.col("_n") * F.lit(test)) if test is not None else F.col("_n") - n_train - gap
    at = F.col("_at")
    split = F.when(at < n_train, "train").when((at >= n_train + gap) & (at < n_train + gap + n_test), "test")
    return placed.withColumn("split", split).drop("_at", "_n")


def regularity(df: DataFrame, time: str, series: Sequence[str]) -> DataFrame:
    """A row a series: n, mean and deviation of the steps in seconds, whether their
    ratio is under 0.1, and the most common step in whole minutes (the least on a tie)."""
    at = F.unix_micros(F.col(time).cast("timestamp")) / F.lit(1e6)
    steps = df.withColumn("_d", at - F.lag(at).over(_window(series, [time]))).filter("_d is not null")
    stats = steps.groupBy(*series).agg((F.count("*") + 1).alias("n"), F.avg("_d").alias("mean_step"), F.stddev_samp("_d").alias("std_step"))
    common = steps.groupBy(*series, F.floor(F.col("_d") / 60).alias("_m")).agg(F.count("*").alias("_k"))
    common = common.groupBy(*series).agg(F.min_by("_m", F.struct(-F.col("_k"), F.col("_m"))).alias("common_minutes"))
    return stats.join(common, list(series)).withColumn("regular", F.coalesce(F.try_divide("std_step", "mean_step") < 0.1, F.lit(False)))


def series_features(df: DataFrame, column: str, series: Sequence[str]) -> DataFrame:
    """A row a series: mean, std, min, max, median, quartiles and the sample-adjusted skewness and kurtosis."""
    n, g1, g2 = F.count(column), F.skewness(column), F.kurtosis(column)
    skew = F.when(n > 2, g1 * F.sqrt((n * (n - 1)).cast("double")) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    out = df.groupBy(*series).agg(
        n.alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), skew.alias("skew"), kurt.alias("kurt")
    )
    return with_quantiles(out, column, {"median": 0.5, "q25": 0.25, "q75": 0.75}, series, df)


def recent(df: DataFrame, group: str, order: Sequence[str | Column], value: str, size: int = 100) -> DataFrame:
    """A row a group: the mean of its last ``size`` values and the last one."""
    w = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    last = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= size)
    return last.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("window_mean"), F.min_by(value, "_r").alias("last"))


def trend(df: DataFrame, group: str, order: Sequence[str], value: str, flat: float = 0.001) -> DataFrame:
    """A row a group: slope of the value on its position, and its direction. Positions
    are found by cells, so that a hot group isn't sorted in one task."""
    rows = positions_within(df, [group], order, "_at").withColumn("_x", F.col("_at").cast("double"))
    out = rows.groupBy(group).agg(F.regr_slope(F.col(value), F.col("_x")).alias("slope"))
    return out.withColumn("trend", F.when(F.abs("slope") < flat, "stable").when(F.col("slope") > 0, "up").otherwise("down"))


def smooth(df: DataFrame, series: Sequence[str], order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """A row a series: simple exponential smoothing's last level, from the first value on;
    equal times go by value.

    The level is a weighted sum: a value with j after it weighs alpha (1 - alpha)^j, the
    first one (1 - alpha)^j. Partial sums are combined; no series is gathered in a row."""
    rows = df.filter(F.col(value).isNotNull()).select(*series, order, F.col(value).cast("double").alias("_v"))
    rows = positions_within(rows, list(series), [order, "_v"], "_after", descending=True)
    keep = F.lit(1 - float(alpha))
    out = rows.groupBy(*series).agg(
        F.count("*").alias("n"), F.sum(alpha * F.pow(keep, F.col("_after")) * F.col("_v")).alias("_sum"), F.max_by("_v", "_after").alias("_first")
    )
    return out.select(*series, "n", (F.col("_sum") + F.pow(keep, F.col("n")) * F.col("_first")).alias("level"))
