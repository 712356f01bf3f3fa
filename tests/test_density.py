"""Density clustering and components against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from lathework.operators.components import components
from lathework.operators.density import dbscan


def brute(rows, eps, least):
    """{key: (cluster, core)} over rows (key, features)."""
    good = [(k, x) for k, x in rows if all(v is not None and v == v for v in x)]
    pts = np.array([x for _, x in good], float)
    near = ((pts[:, None] - pts[None]) ** 2).sum(-1) <= eps * eps if len(pts) else np.zeros((0, 0), bool)
    core = near.sum(1) >= least
    label = {}
    for i in sorted(np.flatnonzero(core), key=lambda i: good[i][0]):
        if i in label:
            continue
        label[i], todo = good[i][0], [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & core):
                if j not in label:
                    label[j] = good[i][0]
                    todo.append(j)
    out = {k: (None, False) for k, _ in rows}
    for i, (k, _) in enumerate(good):
        reach = [label[j] for j in np.flatnonzero(near[i] & core)]
        out[k] = (label[i] if core[i] else min(reach, default=None), bool(core[i]))
    return out


def got(spark, rows, eps, least, dims):
    schema = "id long, " + ", ".join(f"f{i} double" for i in range(dims))
    df = spark.createDataFrame([(k, *x) for k, x in rows], schema).selectExpr("*", "'clash' as cluster", "'clash' as core", "'clash' as w", "'clash' as cell", "'clash' as k")
    found = dbscan(df, "id", [f"f{i}" for i in range(dims)], eps, least).collect()
    assert len(found) == len(rows)
    return {r["id"]: (r["cluster"], r["core"]) for r in found}


@pytest.mark.parametrize("dims,eps,least", [(1, 0.05, 4), (2, 0.3, 5), (3, 0.6, 6)])
def test_random_points(spark, dims, eps, least):
    rng = np.random.default_rng(dims)
    pts = np.concatenate([rng.normal(size=(150, dims)), rng.normal(3, 0.2, (150, dims)), rng.uniform(-6, 6, (60, dims))])
    rows = [(int(k), tuple(map(float, x))) for k, x in zip(rng.permutation(len(pts)), pts, strict=True)]
    want = brute(rows, eps, least)
    assert len({c for c, _ in want.values()}) > 3
    assert got(spark, rows, eps, least, dims) == want


def test_grid_ties_repeats_and_nulls(spark):
    rows = [(i, (float(i % 12), float(i // 12 % 6))) for i in range(150)]
    rows += [(1000 + i, (40.0, 40.0)) for i in range(300)] + [(2000 + i, (41.0, 40.0)) for i in range(2)]
    rows += [(3000, (None, 1.0)), (3001, (float("nan"), 1.0)), (3002, (-0.0, 0.0))]
    assert got(spark, rows, 1.0, 5, 2) == brute(rows, 1.0, 5)


@pytest.mark.parametrize("apart", [0.9999, 1.0001])
def test_dense_lines_on_either_side_of_eps(spark, apart):
    rows = [(i, (i / 2000, 0.0)) for i in range(400)] + [(1000 + i, (i / 2000, apart)) for i in range(400)]
    assert got(spark, rows, 1.0, 5, 2) == brute(rows, 1.0, 5)


def test_no_rows_and_no_core_rows(spark):
    assert got(spark, [], 1.0, 3, 2) == {}
    rows = [(1, (0.0, 0.0)), (2, (9.0, 9.0))]
    assert got(spark, rows, 1.0, 3, 2) == {1: (None, False), 2: (None, False)}
    with pytest.raises(ValueError):
        dbscan(spark.createDataFrame([(1, 0.0)], "id long, f double"), "id", ["f"] * 5, 1.0, 2)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(500, 500), (3, 600), (600, 601), (None, 4)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(7, 60), 7), 500: 500, 3: 3, 600: 3, 601: 3}
    assert found == want
