"""All queries on the driver's tables, by name, and the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package that define QUERIES and ORACLE_SQL.
MODULES: tuple[str, ...] = ("profile_queries", "drift_queries", "measure_queries", "transform_queries", "timeseries_queries", "model_queries", "table_queries", "selection_queries", "relational_queries", "quality_queries", "neighbour_queries", "ensemble_queries", "outlier_queries", "spectral_queries", "tuning_queries", "store_queries")


def _modules():
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLE_SQL.items()}
