"""Helpers shared by the corpus operators: shared working tables, skew-safe
small joins and the word pattern of the contract."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir

#: A word: a run of characters other than space, tab, line feed, vertical tab,
#: form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Largest number of rows a table may have to be broadcast without a size hint.
BROADCAST_ROWS = 20_000

#: Rows of one key that a task of a salted join takes.
HOT = 10_000


#: Folders written inside the open ``scratch`` block of this thread or task.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def store(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and the reread
    table has real size statistics and prunes columns. Inside ``scratch`` the
    table is removed when the block ends, unless it is ``lasting``."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/lathework-{uuid.uuid4().hex}"
    if (held := _scratch.get()) is not None and not lasting:
        held.append(folder)
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that were stored inside the block, for jobs whose
    result is a ``lasting`` table."""
    held: list[str] = []
    before = _scratch.set(held)
    try:
        yield
    finally:
        _scratch.reset(before)
        for folder in held:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def salted(many: DataFrame, few: DataFrame, key: str | list[str], counts: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """Join on ``key``, of which ``few`` has one row a value, without sending a
    frequent value's rows to one task.

    ``counts`` is a stored table of (key, _n), rows of ``many`` by value. A value
    with more than ``HOT`` rows has a row of ``few`` for each ``HOT`` of them, and its
    rows are dealt over these by a hash of ``spread``; there are at most rows / HOT
    such values."""
    keys = [key] if isinstance(key, str) else key
    hot = counts.filter(F.col("_n") > HOT).select(*keys, F.ceil(F.col("_n") / HOT).cast("int").alias("_salts"))
    n_hot = hot.count()
    if not n_hot:
        return many.join(few, keys, how)
    salts = F.coalesce("_salts", F.lit(1))
    left = many.join(small(hot, n_hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    right = few.join(small(hot, n_hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Stores ``df`` with ``pos``, a row's place from 0 in its group (null is a group)
    by ``order``, nulls first, and ``n``, the group's rows.

    Rows are dealt by ranges of (group, order), so that a hot group fills many tasks;
    rows alike in both are told apart by where they were read, and fill many, too. A
    row is numbered in its task and starts from its group's count in the tasks before,
    a table of a row a group and task."""
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    rows = store(rows.withColumns({"_at": F.monotonically_increasing_id(), "_task": F.spark_partition_id()}), name)
    per = rows.groupBy(*group, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_k"))
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = own.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"_start": F.coalesce(F.sum("_k").over(before), F.lit(0)), "n": F.sum("_k").over(own)})
    per = per.drop("_k").withColumnsRenamed({g: f"_g_{g}" for g in group}).withColumnRenamed("_task", "_g_task")
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group] + [F.col("_task") == F.col("_g_task")]
    out = rows.join(per, on).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_start"))
    return out.select(*df.columns, "pos", "n")


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of ``df`` only if its counted ``rows`` are within
    ``limit``; beyond it the planner's shuffle join (with skew splitting) runs."""
    return F.broadcast(df) if rows <= limit else df


def crc32_mod4(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4 (null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(4)


def held_out(doc_id: Column) -> Column:
    """True for documents kept for testing: remainder 2."""
    return crc32_mod4(doc_id) == F.lit(2)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free(table: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``table`` has."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def by_text(table: DataFrame, run: Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]], schema: str, out: str = "_out") -> DataFrame:
    """Adds the struct ``out`` that ``run`` gives for batches of texts. Only texts
    reach Python: every other column stays in the JVM as it is."""
    return table.withColumn(out, F.pandas_udf(run, schema)("text"))


def docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def portable(module: str) -> None:
    """Send a module's functions to the workers by value, so that executors
    need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
