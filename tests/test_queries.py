from __future__ import annotations

import os

import pytest

from lathework.plans import registry

from .conftest import DATA
from .oracle import compare

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, DATA, QUERIES[name], SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_imports_without_the_corpus_package(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if "llm" in name or name == "corpus_pipeline" else real(name, *a))
    assert set(entry.queries()) == set(QUERIES)
