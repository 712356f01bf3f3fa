"""Mean discrepancy against kernels over all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from lathework.operators.mmd import median_gamma, mmd


def exact(x, y, kernel):
    return kernel(x, x).mean() + kernel(y, y).mean() - 2 * kernel(x, y).mean()


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double").selectExpr("*", "'clash' as x", "'clash' as h", "'clash' as ref")


def sides(spark, shift, n=400):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(n, 2)), rng.normal(size=(n // 2, 2)) + [shift, 0]
    return x, y, table(spark, x), table(spark, y, 10_000)


@pytest.mark.parametrize("kernel,form", [("linear", lambda a, b: a @ b.T), ("polynomial", lambda a, b: (1 + a @ b.T) ** 3)])
def test_exact_kernels(spark, kernel, form):
    x, y, ref, cur = sides(spark, 0.7)
    row = mmd(ref, cur, "id", ["a", "b"], kernel, permutations=20).first()
    assert row["statistic"] == pytest.approx(exact(x, y, form)) and row["error"] == 0 and row["is_drift"]


@pytest.mark.parametrize("shift,drift", [(0.0, False), (0.6, True)])
def test_gaussian_kernel_within_its_error(spark, shift, drift):
    x, y, ref, cur = sides(spark, shift)
    gamma = median_gamma(ref, "id", ["a", "b"])
    d = ((x[:, None] - x) ** 2).sum(-1)
    assert gamma == pytest.approx(1 / np.median(d[d > 0]))
    row = mmd(ref, cur, "id", ["a", "b"], permutations=60).first()
    true = exact(x, y, lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(-1)))
    assert abs(row["statistic"] - true) <= 4 * row["error"]
    assert row["is_drift"] is drift and (row["n_reference"], row["n_current"]) == (400, 200)


def test_nulls_and_an_empty_side(spark):
    _, _, ref, cur = sides(spark, 0.0, 20)
    bad = spark.createDataFrame([(None, 1.0, 1.0), (7, None, 1.0), (8, float("nan"), 1.0)], "id long, a double, b double").selectExpr("*", "'' as x", "'' as h", "'' as ref")
    assert tuple(mmd(ref.union(bad), cur, "id", ["a", "b"], "linear", permutations=5).first()[4:]) == (20, 10)
    assert tuple(mmd(ref, cur.limit(0), "id", ["a", "b"], "linear").first()) == (None, None, None, None, 20, 0)
    with pytest.raises(ValueError):
        mmd(ref, cur, "id", ["a"], "other")
