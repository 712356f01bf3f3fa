"""Structured Streaming forms of the windowed statistics: an extension, as the
batch operators define the results. Each takes and returns a streaming frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = (
    T.StructType().add("event_id", T.LongType()).add("ts", T.TimestampNTZType()).add("user_id", T.LongType())
    .add("event_type", T.StringType()).add("value", T.DoubleType()).add("props", T.StringType())
)


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of events as they arrive; ``ts`` as an instant, which watermarks need."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", by: Sequence[str] = ("event_type",)) -> DataFrame:
    """(start, by, n, total): tumbling windows, or sliding ones; events later than ``late`` are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no longer gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drift_against(reference: DataFrame, column: str, sink: Callable[[int, DataFrame], None]):
    """A foreachBatch function: each batch's PSI row against a frozen reference goes to ``sink``."""
    from ..operators.drift import psi

    frozen = reference.select(F.col(column), F.lit(True).alias("_ref"))

    def each(batch: DataFrame, number: int) -> None:
        sink(number, psi(frozen.unionByName(batch.select(F.col(column), F.lit(False).alias("_ref"))), column, "_ref"))

    return each


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, into a table in memory (for tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything new since the last run, appended as Parquet exactly once."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
