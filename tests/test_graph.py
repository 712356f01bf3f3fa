"""Graphs of steps: branches, unions, and what they learn from."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lathework.plans import graph as G
from lathework.plans.pipeline import one_hot, scaler
from lathework.task import Task


@pytest.fixture
def task(spark):
    df = spark.range(60).selectExpr("id", "double(id % 10) x", "double(id % 7) z", "if(id % 2 = 0, 'u', 'v') c", "double(id % 10) + 2 * (id % 2) y", "'k' note")
    return Task(df, "id", {"y": "target", "note": "name"})


def test_branches_share_rows_and_need_no_join(task):
    graph = G.Graph(
        {"numbers": G.chosen("x", "z"), "scale": scaler, "raw": G.chosen("x", "z"), "codes": one_hot(), "only": G.chosen("c"), "all": G.passed},
        [("numbers", "scale"), ("only", "codes"), ("scale", "all"), ("raw", "all"), ("codes", "all")],
    )
    out = graph.fit(task).transform(task.df)
    assert {"scale_x", "scale_z", "raw_x", "raw_z"} <= set(out.features) and not {"c", "x", "z"} & set(out.features)
    assert out.target == "y" and "note" in out.df.columns
    row = out.df.filter("id = 13").first()
    assert row["raw_x"] == 3.0 and row["scale_x"] == pytest.approx((3 - 4.5) / 8.25**0.5)
    assert out.df.count() == 60 and "Join" not in out.df._jdf.queryExecution().optimizedPlan().toString()


def test_nothing_is_learnt_from_rows_to_predict(task):
    graph = G.Graph({"scale": scaler}).fit(task.where("id < 30 and x < 5").select(["x"]))
    far = graph.transform(task.df.filter("id = 59").select("id", "x", "y"))  # x is 9, the mean learnt is 2
    assert far.df.first()["x"] == pytest.approx((9 - 2) / 2**0.5)
    # New rows needn't have a target, and may have columns of their own.
    assert graph.transform(task.df.select("id", "x", F.lit(1).alias("more"))).df.count() == 60


def test_learner_and_folds(task):
    numbers = G.Graph({"code": one_hot(), "scale": scaler}, [("code", "scale")])
    found = G.resample(numbers, "regr.ridge", task.select(["x", "c"]), 3, 1, regParam=0.0)
    assert found.count() == 60 and found.filter("abs(truth - response) > 1e-3").count() == 0
    model = G.train(numbers, "regr.ridge", task.select(["x", "c"]), regParam=0.0)
    assert model.predict(task.df.drop("y", "z")).filter("truth is null and response is not null").count() == 60


def test_rows_dropped_are_gone_for_all(task):
    graph = G.Graph({"few": G.mapped(lambda df: df.filter("x < 3")), "raw": G.chosen("z"), "all": G.passed}, [("few", "all"), ("raw", "all")])
    out = graph.fit(task).transform(task.df)
    assert out.df.count() == 18 and {"few_z", "raw_z", "x", "c"} == set(out.features)


def test_edges(task, spark):
    for steps, edges, why in (
        ({"a": scaler}, [("a", "b")], "no steps"),
        ({"a": scaler, "b": scaler, "c": scaler}, [("a", "b"), ("b", "a")], "circle"),
        ({"a": scaler, "b": scaler}, [], "one step ends"),
        ({"a": scaler, "b": scaler}, [("a", "b"), ("a", "b")], "twice"),
    ):
        with pytest.raises(ValueError, match=why):
            G.Graph(steps, edges)
    with pytest.raises(ValueError, match="no features"):
        G.Graph({"a": G.chosen("what")}).fit(task)
    with pytest.raises(ValueError, match="leaves no feature"):
        G.Graph({"a": G.chosen()}).fit(task)
    with pytest.raises(ValueError, match="in use"):
        G.Graph({"a": scaler}).fit(Task(task.df.withColumn("_held_a", F.lit(1)), "id"))
    empty = Task(spark.createDataFrame([], "id long, x double"), "id")
    assert G.Graph({"a": G.passed}).fit(empty).transform(empty.df).df.count() == 0
