"""Feature groups: snapshots of (entity, features) with a time stamp."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(group: DataFrame, at: str | None = None, stamp: str = "_timestamp") -> DataFrame:
    """The rows of a group's last snapshot not after ``at``; partition pruning
    keeps the other snapshots unread where the stamp is the partition."""
    seen = group.filter(F.col(stamp) <= F.lit(at).cast("timestamp")) if at else group
    last = seen.agg(F.max(stamp)).first()[0]
    return group.filter(F.col(stamp) == F.lit(last)) if last is not None else group.limit(0)


def get_features(groups: dict[str, tuple[DataFrame, Sequence[str]]], entity: str, ids: DataFrame | None = None, at: str | None = None) -> DataFrame:
    """Full outer join by entity of each group's last snapshot; ``ids`` keeps those entities."""
    parts = []
    for df, features in groups.values():
        one = latest(df, at).select(entity, *features)
        parts.append(one.join(ids.select(entity).distinct(), entity, "left_semi") if ids is not None else one)
    return reduce(lambda a, b: a.join(b, entity, "full_outer"), parts)


def history(groups: Sequence[DataFrame], start: str, end: str, stamp: str = "_timestamp") -> DataFrame:
    """All snapshots from ``start`` to ``end``, one below the other; missing columns are null."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)
    return both.filter(F.col(stamp).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def view(groups: Sequence[DataFrame], entity: str) -> DataFrame:
    """Full outer join of groups; a column that several have is the left one's."""
    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.select(entity, *[c for c in b.columns if c not in a.columns]), entity, "full_outer")

    return reduce(join, groups)


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: Sequence[str], right_time: str) -> DataFrame:
    """Each left row with the values of the last right row of its key that is not
    later. One shuffle by key: both sides are stacked and the last value carried on."""
    n = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
    a = left.withColumn("_side", F.lit(1)).withColumn("_t", F.col(time)).select(*left.columns, "_side", "_t", F.lit(None).cast("struct<x:int>").alias("_skip"), *n).drop("_skip")
    b = right.select(*[(F.col(key) if c == key else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in left.columns], F.lit(0).alias("_side"), F.col(right_time).alias("_t"), *values)
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct(*values)), ignorenulls=True).over(w)
    out = a.unionByName(b).withColumn("_v", last).filter("_side = 1")
    return out.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def lineage(edges: DataFrame, name: str, depth: int = 10) -> DataFrame:
    """(feature, level) of everything ``name`` depends on; edges are (feature, depends_on)."""
    found = edges.filter(F.col("feature") == name).select(F.col("depends_on").alias("feature"), F.lit(1).alias("level")).distinct()
    now = found
    for level in range(2, depth + 1):
        now = edges.join(now.select("feature"), "feature").select(F.col("depends_on").alias("feature"), F.lit(level).alias("level")).distinct()
        now = now.join(found, "feature", "left_anti")
        if now.isEmpty():
            break
        found = found.unionByName(now)
    return found
