from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lathework.operators import learners, measures
from lathework.plans.pipeline import Pipeline, one_hot, scaler
from lathework.task import Task


@pytest.fixture
def task(spark):
    df = spark.range(120).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"), F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("c"))
    return Task(df.withColumn("y", F.when(F.col("x") > 4, "hi").otherwise("lo")), "id", {"y": "target"})


def test_roles(task, spark):
    assert (task.features, task.target, task.kind) == (["c", "x", "z"], "y", "classif")
    assert task.select(["x"]).features == ["x"]
    assert task.filter(spark.range(5)).df.count() == 5
    assert task.rename({"y": "t"}).target == "t"
    assert [r["id"] for r in task.head(2).collect()] == [0, 1]
    assert task.cbind(spark.range(120).withColumn("n", F.lit(1))).features == ["c", "n", "x", "z"]
    assert task.rbind(task.df).df.count() == 240
    with pytest.raises(ValueError):
        Task(task.df, "id", {"nope": "target"})


def test_pipeline_learns_from_training_rows_only(task):
    train, test = task.where("id < 60"), task.where("id >= 60")
    p = Pipeline([("scale", scaler), ("hot", one_hot())])
    p.fit(train)
    out = p.transform(test)
    assert out.features == ["c_u", "c_v", "x", "z"]
    m = train.df.agg(F.avg("x"), F.stddev_pop("x")).first()
    got = out.df.filter("id = 69").first()["x"]
    assert got == pytest.approx((9 - m[0]) / m[1])


def test_learners(task):
    own = task.select(["x", "z"])
    pred = learners.resample("classif.tree", own, 3)
    assert pred.count() == 120
    assert measures.accuracy(pred, "truth", "response").first()["acc"] > 0.95
    regr = Task(task.df.select("id", "x", "z", (2 * F.col("x") - F.col("z")).alias("y")), "id", {"y": "target"})
    fitted = learners.train("regr.lm", regr)
    assert measures.regression(fitted.predict(regr.df), "truth", "response").first()["rmse"] < 1e-6
    assert learners.train("cluster.kmeans", regr.with_df(regr.df.drop("y"))).predict(regr.df.drop("y")).select("response").distinct().count() == 3


def test_benchmark_isolates_errors(task):
    scores = learners.benchmark({"t": task.select(["x", "z"])}, {"classif.tree": {}, "classif.gbt": {"maxIter": -5}}, 2).collect()
    assert sorted(r["fold"] for r in scores if r["learner"] == "classif.tree") == [0, 1]
    bad = [r for r in scores if r["learner"] == "classif.gbt"]
    assert len(bad) == 1 and bad[0]["score"] is None and bad[0]["error"]


def test_pca_keeps_variance(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("a"), (2.0 * F.col("id") + F.col("id") % 3).alias("b"))
    out = learners.pca(df, ["a", "b"], 2)
    before = df.agg(F.var_samp("a") + F.var_samp("b")).first()[0]
    v1, v2 = out.agg(F.var_samp("PC1"), F.var_samp("PC2")).first()
    assert v1 + v2 == pytest.approx(before) and v1 > v2
    white = learners.pca(df, ["a", "b"], 2, whiten=True).agg(F.stddev_samp("PC1"), F.avg("PC1")).first()
    assert (white[0], white[1]) == (pytest.approx(1.0), pytest.approx(0.0, abs=1e-9))
