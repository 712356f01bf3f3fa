"""Mean shift against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from lathework.operators import modes
from lathework.operators.modes import mean_shift


def brute(x, width):
    ends = {}
    for seed in np.unique(np.round(x / width) * width, axis=0):
        at = seed
        while True:
            near = x[((x - at) ** 2).sum(1) <= width * width]
            if not len(near):
                break
            new = near.mean(axis=0)
            if ((new - at) ** 2).sum() <= (1e-3 * width) ** 2:
                ends[tuple(new.round(9))] = len(near)
                break
            at = new
    kept = []
    for place, _ in sorted(ends.items(), key=lambda e: (-e[1], *(-v for v in e[0]))):
        if all(((np.array(place) - k) ** 2).sum() > width * width for k in kept):
            kept.append(np.array(place))
    return kept, [int(np.argmin([((p - k) ** 2).sum() for k in kept])) for p in x]


@pytest.mark.parametrize("few", [modes.FEW, 0])
def test_planted_groups(spark, monkeypatch, few):
    monkeypatch.setattr(modes, "FEW", few)
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(k, 2)) * 0.4 + c for k, c in ((60, (0, 0)), (40, (5, 1)), (25, (-3, 6)))] + [np.tile([[9.0, 9.0]], (30, 1)), [[40.0, 40.0]]])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(900, None, 1.0), (901, 1.0, float("nan"))]
    got, centres = mean_shift(spark.createDataFrame(rows, "id long, x double, y double"), "id", ["x", "y"], 1.5)
    found = {r["id"]: r["cluster"] for r in got.collect()}
    kept, labels = brute(x, 1.5)
    assert len(kept) == 5 and [found[i] for i in range(len(x))] == labels
    assert found[900] is None and found[901] is None
    for r in centres.collect():
        assert [r["x"], r["y"]] == pytest.approx(list(kept[r["cluster"]]))


def test_edges(spark):
    none = spark.createDataFrame([], "id long, x double")
    got, centres = mean_shift(none, "id", ["x"], 1.0)
    assert got.count() == 0 and centres.count() == 0
    got, centres = mean_shift(spark.createDataFrame([(1, None)], "id long, x double"), "id", ["x"], 1.0)
    assert got.first()["cluster"] is None
    with pytest.raises(ValueError, match="one to"):
        mean_shift(none, "id", ["x"] * 5, 1.0)
