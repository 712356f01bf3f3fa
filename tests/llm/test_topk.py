"""Exact search by thresholds against all inner products."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lathework.llm import topk
from tests.conftest import DATA
from tests.oracle import compare

SCHEMA = "vec_id long, embedding array<double>, score string, q string, row string, v string, rank string, width int"


def brute(rows, k, step=20):
    """Rows are (id, vector)."""
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i % step == 0:
            asked[i] = min(v, asked.get(i, v))
    out = []
    for i, q in asked.items():
        scores = sorted((-max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in good if j != i and len(v) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, vectors, k=5, **sizes):
    df = spark.createDataFrame([(i, v, "x", "x", "x", "x", "x", 1) for i, v in vectors], SCHEMA)
    table = topk.store(topk.vectors(df), "vectors")
    queries = table.filter("vec_id % 20 = 0").groupBy(topk.F.col("vec_id").alias("query_id")).agg(topk.F.min("v").alias("q"))
    return sorted(map(tuple, topk.search(table, topk.store(queries, "queries"), k, **sizes).collect()))


@pytest.mark.parametrize("lists", [1, 2, 4])
def test_small_blocks_lose_nothing(spark, lists):
    rng = np.random.default_rng(lists)
    centres = rng.normal(size=(4, 8))
    rows = [(i, (centres[i % 4] + rng.normal(scale=0.3, size=8)).tolist()) for i in range(300)]
    assert found(spark, rows, lists=lists, rows=32, asked=4) == brute(rows, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, -0.5]), (None, [1.0, 1.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [-3.0, 2.0]), (20, [1e16, 1.0]),
        (7, [1e16, -1e16]), (8, [1e12, 3.0]), (40, [0.25]), (9, [0.5]), (60, []), (10, []), (80, [1.0, 2.0, 3.0]), (20, [2.0, 2.0]), (11, [7.5, 1e10]), (0, [0.5, 9.0]),
    ]
    assert found(spark, rows) == brute(rows, 5)


def test_ties_and_one_vector_everywhere(spark):
    rows = [(i, [0.5, 0.25, 1.0]) for i in range(400)] + [(3, [0.5, 0.25, 1.0])] * 50
    assert found(spark, rows, rows=16, asked=4) == brute(rows, 5)


def test_fewer_candidates_than_wanted_and_none(spark):
    rows = [(0, [1.0]), (1, [-2.0]), (20, [-1.0])]
    assert found(spark, rows) == brute(rows, 5)
    assert found(spark, [(0, [1.0])]) == [] and found(spark, []) == []


def test_threshold_leaves_rows_out():
    rng = np.random.default_rng(0)
    q, x = rng.integers(-30, 30, (4, 16)), rng.integers(-30, 30, (2000, 16))
    own = np.zeros((4, 2000), bool)
    asked, _, score = topk.gather(q, x, own, 5, 2)
    cutoff = np.array([np.sort(score[asked == i])[-5] for i in range(4)])
    asked, rows, score = topk.collect(q, x, own, cutoff, 2)
    true = q @ x.T
    assert (score == true[asked, rows]).all() and len(score) == (true >= cutoff[:, None]).sum()


@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.001", "0.01")])
def test_query_equals_sql(spark, folder):
    compare(spark, folder, topk.op11_topk, topk.OP11_SQL)
