from __future__ import annotations

from pyspark.sql import functions as F

from lathework.streaming import events as E


def make(spark, folder, parts):
    for rows in parts:
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)


def test_windows_leave_late_events_out(spark, tmp_path):
    folder, check = str(tmp_path / "in"), str(tmp_path / "c1")
    row = lambda i, t: (i, f"2024-01-{t}", 1, "view", 1.0, "{}")
    out = str(tmp_path / "out")

    def counts():
        E.append_available(E.window_counts(E.read_events(spark, folder), "1 hour", late="1 hour"), out, check)
        return sorted((r["start"].day, r["n"]) for r in spark.read.parquet(out).collect())

    make(spark, folder, [[row(1, "01 00:10:00"), row(2, "01 00:20:00")], [row(3, "02 00:00:00")]])
    assert counts() == [(1, 2)]  # closed by the watermark of the second day
    make(spark, folder, [[row(4, "01 00:30:00"), row(5, "03 00:00:00")]])
    assert counts() == [(1, 2), (2, 1)]  # the late one is gone


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(i, f"2024-01-01 {i % 24:02d}:{i % 60:02d}:00", i % 3, "view" if i % 2 else "click", float(i), "{}") for i in range(200)]
    make(spark, folder, [rows[:100], rows[100:]])
    late = "3 days"
    out = E.run_available(E.window_counts(E.read_events(spark, folder, 10), "2 hours", late=late), "w2", str(tmp_path / "c2"), "complete")
    batch = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    want = batch.groupBy(F.window("ts", "2 hours")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_duplicates_and_drift(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(i % 50, f"2024-01-01 00:{i % 50:02d}:00", 1, "view", float(i % 50), "{}") for i in range(100)]
    make(spark, folder, [rows])
    once = E.run_available(E.deduplicated(E.read_events(spark, folder)), "w3", str(tmp_path / "c3"))
    assert once.count() == 50
    seen = []
    reference = spark.range(50).select(F.col("id").cast("double").alias("value"))
    each = E.drift_against(reference, "value", lambda n, df: seen.append(df.first()["psi"]))
    q = E.read_events(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 1 and abs(seen[0]) < 1e-9
