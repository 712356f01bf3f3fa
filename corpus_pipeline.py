"""From raw documents to packed training sequences: the corpus operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read again as the next one's documents. SQL can't express trained
stages, so there is no ORACLE_SQL; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lathework.llm import mixing, nearcopies, packing, private, toxicity
from lathework.llm.common import docs as read
from lathework.llm.common import scratch, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return nearcopies.keep_first(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return private.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights ask for."""
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("private", redact_private),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. What a stage stored on its way is removed
    when its result is written."""
    docs = read(spark, sf_dir)
    for name, stage in STAGES:
        with scratch(spark):
            docs = store(stage(spark, docs, sf_dir), name, lasting=True)
    return docs
