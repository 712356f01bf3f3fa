"""Neighbour-based mutual information against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lathework.operators import information as I
from lathework.operators.information import UNIT, digamma, mutual_info_classif, mutual_info_regr


def psi(m):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(m)))


def held(x):
    x = np.asarray(x, float)
    return np.round(x / (x.std() or 1.0) * UNIT).astype(np.int64)


def brute_regr(x, y, k=3):
    x, y = held(x), held(y)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    r = np.maximum(np.sort(np.maximum(dx, dy), axis=1)[:, k] - 1, 0)
    nx, ny = (dx <= r[:, None]).sum(1), (dy <= r[:, None]).sum(1)
    return max(0.0, psi(len(x)) + psi(k) - np.mean([psi(a) + psi(b) for a, b in zip(nx, ny, strict=True)]))


def brute_classif(x, label, k=3):
    x, label = held(x), np.asarray(label)
    sizes = np.array([(label == c).sum() for c in label])
    x, label, sizes = x[sizes > 1], label[sizes > 1], sizes[sizes > 1]
    d, ks = np.abs(x[:, None] - x), np.minimum(k, sizes - 1)
    m = []
    for i, near in enumerate(ks):
        r = max(np.sort(d[i][label == label[i]])[near] - 1, 0)
        m.append((d[i] <= r).sum())
    return max(0.0, psi(len(x)) + np.mean([psi(v) for v in ks]) - np.mean([psi(v) for v in sizes]) - np.mean([psi(v) for v in m]))


@pytest.fixture
def data(spark, monkeypatch):
    monkeypatch.setattr(I, "BUCKET", 16)
    monkeypatch.setattr(I, "LEAF", 8)
    rng = np.random.default_rng(4)
    n = 500
    a = rng.normal(size=n)
    y = a**2 + 0.1 * rng.normal(size=n)
    columns = {"a": a, "noise": rng.normal(size=n), "whole": np.round(2 * a), "tail": np.exp(3 * rng.normal(size=n)), "same": np.full(n, 2.0)}
    label = np.where(a > 0.5, "high", np.where(a > -1, "mid", "low")).astype(object)
    label[0], label[1:3] = "lone", "two"
    rows = [(i, *[float(c[i]) for c in columns.values()], float(y[i]), str(label[i])) for i in range(n)]
    rows += [(n, None, 0.0, 0.0, 0.0, 2.0, 1.0, "mid"), (n + 1, 0.0, 0.0, 0.0, 0.0, 2.0, float("nan"), "mid"), (n + 2, float("nan"), 0.0, 0.0, 0.0, 2.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in columns) + ", y double, label string")
    return df.selectExpr("*", "'clash' as v", "'clash' as feature", "'clash' as p", "'clash' as n"), columns, y, label


def test_regression(data):
    df, columns, y, _ = data
    found = {r["feature"]: r["score"] for r in mutual_info_regr(df, "id", list(columns), "y").collect()}
    want = {c: brute_regr(x, y) for c, x in columns.items()}
    assert found == pytest.approx(want, abs=1e-9)
    assert found["a"] > 1 > 0.2 > found["noise"]


def test_classes(data):
    df, columns, _, label = data
    found = {r["feature"]: r["score"] for r in mutual_info_classif(df.filter("id < 500"), "id", list(columns), "label").collect()}
    want = {c: brute_classif(x, label) for c, x in columns.items()}
    assert found == pytest.approx(want, abs=1e-9)
    assert found["a"] > 0.7 > 0.1 > found["noise"]


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, "a"), (2, 1.0, 2.0, "a"), (3, 5.0, 0.0, "a")], "id long, x double, y double, label string")
    assert [tuple(r) for r in mutual_info_regr(df, "id", ["x"], "y").collect()] == [("x", None)]
    assert mutual_info_classif(df, "id", ["x"], "label").first()["score"] == pytest.approx(brute_classif([0, 1, 5], ["a"] * 3))
    assert mutual_info_regr(df.limit(0), "id", ["x"], "y").collect() == mutual_info_classif(df.limit(0), "id", ["x"], "label").collect() == []


def test_digamma(spark):
    found = [r[0] for r in spark.range(1, 40).select(digamma(I.F.col("id"))).collect()]
    assert found == pytest.approx([psi(m) for m in range(1, 40)], abs=1e-12)
    assert spark.range(1).select(digamma(I.F.lit(10**9))).first()[0] == pytest.approx(math.log(10**9) - 0.5e-9, abs=1e-12)
