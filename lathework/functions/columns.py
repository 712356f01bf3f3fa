"""Joins by range and time, and aggregates of one's own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with every range [low, high) that their value is in. Both sides meet on
    cells of ``width``: a value is in one, a range goes to each that it touches, so that
    the join is one of keys and no row is compared with all ranges."""
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    each = ranges.filter(F.col(low) < F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    rows = left.withColumn("_cell", cell(value))
    return rows.join(each, "_cell").filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_cell")


def count_within(left: DataFrame, right: DataFrame, row_id: str, key: str, time: str, right_time: str, seconds: int, out: str) -> DataFrame:
    """(row_id, out): how many rows of ``right`` with the same key lie in the
    ``seconds`` before a left row. Both sides are stacked and counted by a range window,
    so that no pairs are made."""
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a = left.select(key, F.col(row_id).alias("_id"), at(time).alias("_at"), F.lit(0).alias("_one"))
    b = right.select(key, F.lit(None).cast(left.schema[row_id].dataType).alias("_id"), at(right_time).alias("_at"), F.lit(1).alias("_one"))
    before = Window.partitionBy(key).orderBy("_at").rangeBetween(-seconds * 1_000_000, -1)
    both = a.unionByName(b).withColumn(out, F.coalesce(F.sum("_one").over(before), F.lit(0)).cast("long"))
    return both.filter("_id is not null").select(F.col("_id").alias(row_id), out)


def custom_mean(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """An aggregate of one's own, geometric means: batches give (sum of logarithms,
    count) by group in Arrow, which Spark then adds up, so that no group meets in one task. Values below
    zero do not count; a group without others is null."""
    import numpy as np

    def partial(parts):
        for part in parts:
            logs = np.log(part["_v"].to_numpy())
            sums = pd.DataFrame({"_g": part["_g"], "_s": logs}).groupby("_g", dropna=False)["_s"].agg(["sum", "count"]).reset_index()
            yield sums.rename(columns={"sum": "_s", "count": "_n"})[["_g", "_s", "_n"]]

    kind = df.schema[group].dataType.simpleString()
    sums = df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).filter("_v is not null").mapInPandas(partial, f"_g {kind}, _s double, _n long")
    return sums.groupBy(F.col("_g").alias(group)).agg(F.exp(F.try_divide(F.sum("_s"), F.sum("_n"))).alias(out))
