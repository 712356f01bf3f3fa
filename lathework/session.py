"""Session builder with the settings that queries assume, and the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lathework", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds settings."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session. A local session without one gets a temporary folder (tests); a
    cluster without one is an error, as each executor would write to its own disk."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-lathework-"))
        conf = context.getCheckpointDir()
    return conf.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and read from the shared folder from then on: a reliable
    checkpoint, which outlives executors, for iterative jobs."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
