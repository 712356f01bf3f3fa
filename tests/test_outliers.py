"""Outliers of whole rows against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.operators import outliers as O

NAN = float("nan")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) @ np.array([[1.0, 0.6], [0.0, 0.5]]) + 5
    x[:12] = rng.normal(size=(12, 2)) * 0.3 + np.array([12.0, -4.0])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(900, None, 1.0), (901, 1.0, NAN)]
    return spark.createDataFrame(rows, "id long, x double, y double").coalesce(3), x


def test_isolation_forest_walks_every_tree(points):
    df, x = points
    forest = O.isolation_forest(df, "id", ["x", "y"], trees=20, rows=64, seed=1)
    assert len(forest.trees) == 20 and forest.rows == 64

    def depth(t, row, at=0):
        if t.feature[at] < 0:
            return t.depth[at]
        return depth(t, row, t.left[at] if row[t.feature[at]] < t.cut[at] else t.right[at])

    got = {r["id"]: r[O.SCORE] for r in forest.score(df).collect()}
    assert got[900] is None and got[901] is None
    for i, row in enumerate(x):
        want = 2 ** (-sum(depth(t, row) for t in forest.trees) / 20 / O.average_path(64))
        assert got[i] == pytest.approx(want)
    flagged = {r["id"] for r in O.act(forest.score(df), ["x", "y"], 0.04).filter("is_outlier = 1").collect()}
    assert len(flagged & set(range(12))) >= 10
    again = {r["id"]: r[O.SCORE] for r in O.isolation_forest(df.repartition(5), "id", ["x", "y"], 20, 64, 1).score(df).collect()}
    assert again == got


def test_a_tree_is_bounded_and_splits_only_what_differs():
    t = O.grow([[1.0, float(i % 4)] for i in range(64)], "s")
    assert set(t.feature) <= {-1, 1} and len(t.feature) <= 2 * 4 - 1
    assert O.grow([[2.0]] * 9, "s").feature == [-1]
    assert O.average_path(2) == 1.0 and O.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_envelope_sees_through_the_outliers(points):
    df, x = points
    found = O.elliptic_envelope(df, ["x", "y"], 0.75, 20)
    assert found.centre == pytest.approx([x[12:, 0].mean(), x[12:, 1].mean()], abs=0.15)
    got = {r["id"]: r[O.SCORE] for r in found.score(df).collect()}
    inverse = np.array(found.inverse)
    for i, row in enumerate(x):
        gap = row - np.array(found.centre)
        assert got[i] == pytest.approx(gap @ inverse @ gap)
    assert np.median([got[i] for i in range(300)]) == pytest.approx(2 * math.log(2))
    assert got[900] is None and got[901] is None
    assert {r["id"] for r in O.act(found.score(df), ["x", "y"], 0.04).filter("is_outlier = 1").collect()} == set(range(12))


def test_one_step_is_the_closest_half(points):
    df, x = points
    mid = np.median(x, axis=0)
    d = (((x - mid) / np.median(abs(x - mid), axis=0)) ** 2).sum(1)
    half = x[d <= np.quantile(d, 0.5)]
    found = O.elliptic_envelope(df, ["x", "y"], 0.5, 1)
    assert found.centre == pytest.approx(list(half.mean(axis=0)))


@pytest.mark.parametrize("action", ["remove", "impute"])
def test_actions(points, action):
    df, x = points
    scored = O.Ellipse(["x", "y"], [5.0, 5.0], [[1.0, 0.0], [0.0, 1.0]]).score(df)
    out = {r["id"]: r for r in O.act(scored, ["x", "y"], 0.04, action).collect()}
    hit = set(range(12))
    assert set(out) == (set(range(300)) | {900, 901}) - (hit if action == "remove" else set())
    if action == "impute":
        known = [*x[:, 0], 1.0]
        assert all(out[i]["x"] == pytest.approx(float(np.median(known))) for i in hit)
        assert out[900]["x"] is None


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, x double")
    forest = O.isolation_forest(none, "id", ["x"])
    assert forest.score(none).count() == 0
    assert forest.score(spark.createDataFrame([(1, 2.0)], "id long, x double")).first()[O.SCORE] is not None
    with pytest.raises(ValueError, match="no row"):
        O.elliptic_envelope(none, ["x"])
    same = spark.createDataFrame([(i, 2.0) for i in range(5)], "id long, x double")
    assert O.elliptic_envelope(same, ["x"]).score(same).agg(F.max(O.SCORE)).first()[0] == 0.0
    with pytest.raises(ValueError, match="no action"):
        O.act(same.withColumn(O.SCORE, F.lit(1.0)), ["x"], 0.1, "hide")
