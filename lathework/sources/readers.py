"""Readers, writers and the load policy: NaN becomes null, rows get ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"csv": "csv", "json": "json", "parquet": "parquet", "orc": "orc", "txt": "text"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing, as Spark would otherwise sort it as the largest value."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(*[F.nanvl(F.col(f"`{f.name}`"), F.lit(None)).alias(f.name) if isinstance(f.dataType, floats) else F.col(f"`{f.name}`") for f in df.schema])


def read(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """Any number of files or folders of one format, told by the suffix of the
    first; columns that some lack are null there."""
    suffix = paths[0].rstrip("/").rpartition(".")[2].lower()
    if suffix not in FORMATS:
        raise ValueError(f"no reader for .{suffix}; known: {', '.join(sorted(FORMATS))}")
    defaults = {"csv": {"header": True, "inferSchema": True}, "json": {"multiLine": True}, "parquet": {"mergeSchema": True}}
    reader = spark.read.format(FORMATS[suffix]).options(**(defaults.get(suffix, {}) | options))
    return nan_to_null(reader.load(list(paths)))


def unique_key(df: DataFrame, key: str) -> bool:
    """True if no two rows share ``key`` and none lacks it."""
    return df.groupBy(key).count().filter(f"count > 1 or `{key}` is null").isEmpty()


def with_row_id(df: DataFrame, order: Sequence[str | Column], name: str = "_row_id") -> DataFrame:
    """Numbers rows from 0 in ``order``.

    Range partitions are numbered by their counts, so that no task sees all
    rows: ids are the rank inside a partition plus the rows of those before."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    counts = parts.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    out = parts.withColumn("_at", inside).join(F.broadcast(counts.select("_part", "_before")), "_part")  # a row a partition
    return out.withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col("_at")).cast("long")).drop("_part", "_before", "_at")


def write_features(df: DataFrame, path: str, stamp: str) -> None:
    """Appends a snapshot, partitioned by its time stamp."""
    df.withColumn("_timestamp", F.lit(stamp).cast("timestamp")).write.mode("append").partitionBy("_timestamp").parquet(path)


def write(df: DataFrame, path: str, **options) -> None:
    """Writes in the format of the suffix."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in FORMATS:
        raise ValueError(f"no writer for .{suffix}; known: {', '.join(sorted(FORMATS))}")
    df.write.format(FORMATS[suffix]).options(**options).save(path)
