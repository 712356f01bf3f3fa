"""Spectral clustering against dense eigenvectors and planted groups."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from lathework.operators.spectral import affinity, eigenvectors, spectral


def _dense(x, width, gamma):
    cells = {}
    for row in x:
        cells.setdefault(tuple(np.floor(row / width).astype(int)), []).append(row)
    keys = sorted(cells)
    w = np.zeros((len(keys), len(keys)))
    for i, a in enumerate(keys):
        for j, b in enumerate(keys):
            if max(abs(p - q) for p, q in zip(a, b, strict=True)) <= 2:
                gap = np.mean(cells[a], 0) - np.mean(cells[b], 0)
                w[i, j] = len(cells[a]) * len(cells[b]) * np.exp(-gamma * gap @ gap)
    return keys, w


def test_graph_and_eigenvalues_equal_dense_ones(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(60, 2)) * 0.5, rng.normal(size=(40, 2)) * 0.5 + (2.5, 0)])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "x double, y double")
    nodes, edges = affinity(df, ["x", "y"], 0.6, 2.0)
    keys, w = _dense(x, 0.6, 2.0)
    assert {tuple(r["cell"]): pytest.approx(r["degree"]) for r in nodes.collect()} == dict(zip(keys, w.sum(1), strict=True))
    assert edges.count() == (w > 0).sum()
    vectors, values = eigenvectors(nodes, edges, 3)
    root = np.sqrt(w.sum(1))
    s = w / np.outer(root, root)
    assert values == pytest.approx(sorted(np.linalg.eigvalsh(s))[::-1][:3], abs=1e-6)
    u = np.array([r["u"] for r in sorted(vectors.collect(), key=lambda r: r["cell"])])
    assert u.T @ u == pytest.approx(np.eye(3), abs=1e-8)
    assert s @ u == pytest.approx(u * values, abs=1e-3)


def _groups():
    rng = np.random.default_rng(5)
    return [(rng.normal(size=(n, 2)) * 0.5 + c).tolist() for n, c in ((70, (0, 0)), (50, (4, 0)), (30, (2, 4)))]


@pytest.mark.parametrize("k", [3, None])
def test_planted_groups(spark, k):
    groups = _groups()
    rows = [(100 * g + i, *p) for g, some in enumerate(groups) for i, p in enumerate(some)]
    # A hot cell is one node; a lone row and rows with gaps are in no cluster.
    rows += [(1000 + i, 0.1, 0.1) for i in range(3000)] + [(9000, 50.0, 50.0), (9001, None, 1.0), (9002, 1.0, float("nan"))]
    got = spectral(spark.createDataFrame(rows, "id long, x double, y double"), "id", ["x", "y"], k, 1.0, gamma=0.5, least=2)
    found = {r["id"]: r["cluster"] for r in got.collect()}
    assert len(found) == len(rows) and {found[i] for i in (9000, 9001, 9002)} == {None}
    assert {found[1000 + i] for i in range(3000)} == {0}
    for g, some in enumerate(groups):
        counts = Counter(found[100 * g + i] for i in range(len(some)))
        assert counts[g] >= 0.95 * len(some), counts


def test_edges(spark):
    none = spark.createDataFrame([], "id long, x double")
    assert spectral(none, "id", ["x"], 2, 1.0).count() == 0
    gaps = spark.createDataFrame([(1, None)], "id long, x double")
    assert [tuple(r) for r in spectral(gaps, "id", ["x"], None, 1.0).collect()] == [(1, None)]
    # Fewer cells than clusters: one each, ties by the least cell; repeated rows share theirs.
    few = spark.createDataFrame([(1, 0.5), (2, 90.5), (3, 0.5), (4, 90.5)], "id long, x double")
    assert sorted(map(tuple, spectral(few, "id", ["x"], 5, 1.0).collect())) == [(1, 0), (2, 1), (3, 0), (4, 1)]
    with pytest.raises(ValueError, match="features"):
        spectral(none, "id", ["x"] * 5, 2, 1.0)
    with pytest.raises(ValueError, match="clusters"):
        spectral(none, "id", ["x"], 11, 1.0)
    with pytest.raises(ValueError, match="above zero"):
        spectral(none, "id", ["x"], 2, 0.0)
