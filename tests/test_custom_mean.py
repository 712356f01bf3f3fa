from __future__ import annotations

import pytest

from lathework.functions.columns import custom_mean


def test_groups_without_a_positive_value_are_null(spark):
    rows = [("a", 2.0), ("a", 8.0), ("a", -1.0), ("b", -3.0), ("c", 0.0), ("c", 5.0)]
    out = {r["g"]: r["m"] for r in custom_mean(spark.createDataFrame(rows, "g string, v double"), "g", "v", "m").collect()}
    assert out["a"] == pytest.approx(4.0) and out["b"] is None and out["c"] == 0.0
