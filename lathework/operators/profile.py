"""Column profiles and data checks: one aggregate over all columns, then a row a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_missing(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.isNull()


def rows_per_column(df: DataFrame, columns: Sequence[str], **stats) -> DataFrame:
    """One row a column: name and each statistic, a function of the column's name."""
    packed = F.array(*[F.struct(F.lit(c).alias("column"), *[f(c).alias(k) for k, f in stats.items()]) for c in columns])
    return df.agg(packed.alias("_all")).select(F.explode("_all").alias("_one")).select("_one.*")


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return rows_per_column(df, columns or df.columns, missing=lambda c: F.count_if(is_missing(df, c)))


def col_info(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, distinct_values)."""
    return rows_per_column(
        df, columns or df.columns, missing=lambda c: F.count_if(is_missing(df, c)), distinct_values=lambda c: F.count_distinct(F.col(f"`{c}`"))
    )


def distinct_per_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): the distinct values that are not null, as strings; a row each,
    so that no list of them has to fit one task."""
    one = [df.select(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    out = one[0]
    for more in one[1:]:
        out = out.unionByName(more)
    return out.filter("value is not null").distinct()


def distinct_tuples(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, std, min, max, median, missing, distinct_values)."""
    from .ordered import with_quantiles
    from .scores import unpivot

    v = lambda c: F.col(f"`{c}`").cast("double")
    out = rows_per_column(
        df, columns, mean=lambda c: F.avg(v(c)), std=lambda c: F.stddev_samp(v(c)), min=lambda c: F.min(v(c)), max=lambda c: F.max(v(c)),
        missing=lambda c: F.count_if(is_missing(df, c)), distinct_values=lambda c: F.count_distinct(v(c)),
    )
    values = unpivot(df, columns, []).withColumnRenamed("feature", "column")
    return with_quantiles(out, "value", {"median": 0.5}, ["column"], values)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of the values that are not null, most frequent first, ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_total")).alias("share"))  # one row


def true_ratio(df: DataFrame, flag: Column) -> DataFrame:
    """Shares of true and false over all rows, nulls included."""
    return df.agg(F.count("*").alias("n"), F.count_if(flag).alias("_t"), F.count_if(~flag).alias("_f")).select(
        "n", F.try_divide("_t", "n").alias("true_ratio"), F.try_divide("_f", "n").alias("false_ratio")
    )


def duplicate_ratio(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct rows, and the share of rows that repeat an earlier one."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("n"))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"))
    return total.withColumn("duplicate_ratio", F.try_divide(F.col("n_rows") - F.col("n_distinct"), F.col("n_rows")))


def iqr_outliers(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Quartiles (linear) and how many values lie beyond ``factor`` ranges of them."""
    from .ordered import quantiles

    q = quantiles(df, column, [0.25, 0.75]).select(F.get("_q", F.lit(0)).alias("q1"), F.get("_q", F.lit(1)).alias("q3"))
    both = df.select(F.col(column).alias("_x")).crossJoin(F.broadcast(q))  # one row
    low, high = F.col("q1") - factor * (F.col("q3") - F.col("q1")), F.col("q3") + factor * (F.col("q3") - F.col("q1"))
    return both.groupBy("q1", "q3").agg(F.count_if((F.col("_x") < low) | (F.col("_x") > high)).alias("outliers"), F.count("_x").alias("n"))


def zscore_outliers(df: DataFrame, columns: Sequence[str], limit: float = 3.0, population: bool = False) -> DataFrame:
    """(column, n, outliers, outlier_rate): values over ``limit`` deviations off the mean."""
    std = F.stddev_pop if population else F.stddev_samp
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[std(c).alias(f"_s_{c}") for c in columns])
    both = df.select(*columns).crossJoin(F.broadcast(stats))  # one row
    far = lambda c: F.count_if(F.abs(F.col(c) - F.col(f"_m_{c}")) > limit * F.col(f"_s_{c}"))
    out = rows_per_column(both, columns, n=lambda c: F.count(c), outliers=far)
    return out.withColumn("outlier_rate", F.try_divide("outliers", "n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, corr) of every pair, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    packed = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.corr(a, b).alias("corr")) for a, b in pairs])
    return df.agg(packed.alias("_all")).select(F.explode("_all").alias("_one")).select("_one.*")


def task_type(df: DataFrame, columns: Sequence[str], limit: int = 20) -> DataFrame:
    """(column, distinct_values, task_type): classification up to ``limit`` values."""
    out = rows_per_column(df, columns, distinct_values=lambda c: F.count_distinct(c))
    return out.withColumn("task_type", F.when(F.col("distinct_values") <= limit, "classif").otherwise("regr"))


def validate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing_ratio, missing_band, constant, high_cardinality)."""
    n = F.count("*")
    out = rows_per_column(df, columns, n_rows=lambda c: n, missing=lambda c: F.count_if(is_missing(df, c)), distinct_values=lambda c: F.count_distinct(c))
    ratio = F.try_divide("missing", "n_rows")
    band = F.when(ratio > 0.5, "severe").when(ratio > 0.2, "high").when(ratio > 0, "some").otherwise("none")
    return out.select(
        "column", ratio.alias("missing_ratio"), band.alias("missing_band"), (F.col("distinct_values") <= 1).alias("constant"),
        (F.col("distinct_values") > F.col("n_rows") / 10).alias("high_cardinality"),
    )


def class_imbalance(df: DataFrame, column: str) -> DataFrame:
    """Most and least frequent class counts, their ratio and the entropy as a share of the largest possible."""
    c = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("_t"))
    p = F.col("n") / F.col("_t")
    both = c.crossJoin(F.broadcast(total))  # one row
    return both.agg(
        F.max("n").alias("most"), F.min("n").alias("least"), (F.max("n") / F.min("n")).alias("imbalance"),
        F.try_divide(-F.sum(p * F.ln(p)), F.ln(F.nullif(F.count("*"), F.lit(1)))).alias("entropy"),
    )
