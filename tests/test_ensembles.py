"""Learners on rows with gaps, and ensembles, against what their stored predictions imply."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lathework.operators import ensembles as E
from lathework.operators import learners as L
from lathework.task import Task

NAN = float("nan")


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(i, float(i % 13), float(i * 7 % 11), 2.0 * (i % 13) - (i * 7 % 11) + (i % 3)) for i in range(120)]
    return Task(spark.createDataFrame(rows, "id long, x double, z double, y double").coalesce(2), "id", {"y": "target"})


@pytest.fixture(scope="module")
def classes(numbers):
    df = numbers.df.select("id", "x", "z", F.when(F.col("x") + F.col("z") > 11, "b").when(F.col("x") > 8, "c").otherwise("a").alias("c"))
    return Task(df, "id", {"c": "target"})


@pytest.mark.parametrize("learner", ["classif.logreg", "classif.tree", "classif.forest", "classif.nb", "regr.lm", "regr.lasso", "regr.elastic", "regr.forest", "regr.gbt", "cluster.kmeans", "cluster.gmm"])
def test_gaps_teach_nothing_and_get_no_response(spark, numbers, classes, learner):
    few = {"classif.forest": {"numTrees": 5}, "regr.forest": {"numTrees": 5}, "regr.gbt": {"maxIter": 3}, "regr.lasso": {"regParam": 0.01}, "regr.elastic": {"regParam": 0.01}}.get(learner, {})
    task = classes if learner.startswith("classif") else numbers
    if learner.startswith("cluster"):
        task = Task(numbers.df.drop("y"), "id")
    gaps = spark.createDataFrame([(900, None, 1.0), (901, 2.0, NAN), (902, None, None)], "id long, x double, z double")
    more = task.df.unionByName(gaps, allowMissingColumns=True)
    if task.target:
        more = more.unionByName(task.df.limit(1).withColumns({"id": F.lit(903).cast("long"), task.target: F.lit(None).cast(task.df.schema[task.target].dataType)}))
    plain = {r["id"]: r["response"] for r in L.train(learner, task, **few).predict(task.df).collect()}
    found = {r["id"]: r for r in L.train(learner, task.with_df(more), **few).predict(more).collect()}
    assert len(found) == more.count()
    assert all(found[i]["response"] is None for i in (900, 901, 902))
    assert all(r["score"] is None for i, r in found.items() if i in (900, 901, 902) and "score" in r)
    if learner in ("classif.tree", "classif.nb", "regr.lm"):
        assert {i: found[i]["response"] for i in plain} == pytest.approx(plain) if learner == "regr.lm" else {i: found[i]["response"] for i in plain} == plain
    if task.target:
        assert found[903]["response"] is not None


def test_text_features_are_an_error(classes):
    with pytest.raises(ValueError, match="aren't numbers"):
        L.train("classif.tree", Task(classes.df.withColumn("t", F.lit("a")), "id", {"c": "target"}))


def test_columns_with_working_names_stay(numbers):
    df = numbers.df.withColumns({"_known": F.lit("k"), "_features": F.lit("f"), "_response": F.lit("r"), "_row": F.lit("w")})
    out = L.train("regr.lm", numbers).add(df, "out").filter("id = 3").first()
    assert (out["_known"], out["_features"], out["_response"], out["_row"], out["x"]) == ("k", "f", "r", "w", 3.0)


def test_weights_are_repeats(spark, numbers):
    df = numbers.df.withColumn("w", (F.col("id") % 3).cast("double"))
    weighted = L.train("regr.lm", Task(df, "id", {"y": "target", "w": "weight"})).predict(df)
    twice = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.col("w").cast("int"), F.lit(1))))).filter("w > 0").drop("w", "k")
    plain = L.train("regr.lm", Task(twice, "id", {"y": "target"})).predict(df)
    both = {r["id"]: r["response"] for r in weighted.collect()}
    assert both == pytest.approx({r["id"]: r["response"] for r in plain.collect()})


def test_draws_have_the_mean_and_spread_of_a_count(spark):
    rows = spark.range(20000).select(E.draws("id", 1, 0.8, 4).alias("d"))
    mean, var, top = rows.agg(F.avg("d"), F.var_samp("d"), F.max("d")).first()
    assert mean == pytest.approx(0.8, abs=0.03) and var == pytest.approx(0.8, abs=0.05) and top < 12


def test_bayesian_numbers(numbers):
    gap = numbers.df.limit(1).withColumns({"id": F.lit(900).cast("long"), "x": F.lit(None).cast("double")})
    found = E.bayesian([("regr.lm", {}), ("regr.tree", {"maxDepth": 2}, ["x"])], numbers, 4, 0.8, 1)
    assert found.weights == [1 / 8] * 8
    out = {r["id"]: r for r in found.predict(numbers.df.unionByName(gap)).collect()}
    each = [{r["id"]: r["response"] for r in m.predict(numbers.df).collect()} for m in found.models]
    for i in range(120):
        v = sorted(m[i] for m in each)
        mean = sum(v) / 8
        h = 0.975 * 7
        assert out[i]["response"] == pytest.approx(mean)
        assert out[i]["std"] == pytest.approx((sum((x - mean) ** 2 for x in v) / 8) ** 0.5, abs=1e-9)
        assert out[i]["upper"] == pytest.approx(v[6] + (v[7] - v[6]) * (h - 6))
    assert out[900]["truth"] is not None


def test_bayesian_classes(classes):
    found = E.bayesian([("classif.tree", {"maxDepth": 1})], classes, 5, 0.8, 2, posterior=True)
    assert sum(found.weights) == pytest.approx(1) and min(found.weights) > 0
    each = [{r["id"]: r["response"] for r in m.predict(classes.df).collect()} for m in found.models]
    for r in found.predict(classes.df).collect():
        votes = {}
        for w, m in zip(found.weights, each):
            votes[m[r["id"]]] = votes.get(m[r["id"]], 0) + w
        best = min(votes, key=lambda label: (-round(votes[label], 9), label))
        assert r["response"] == best and r["score"] == pytest.approx(votes[best])


def test_simplex_weights_are_the_least():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(20):
        e = rng.normal(size=(50, 3)) + rng.normal(size=3)
        g = e.T @ e / 50
        w = np.array(E.simplex_weights(g.tolist()))
        assert w.min() >= 0 and w.sum() == pytest.approx(1)
        other = rng.dirichlet(np.ones(3), 2000)
        assert w @ g @ w <= np.einsum("ij,jk,ik->i", other, g, other).min() + 1e-12
    assert E.simplex_weights([[1.0, 1.0], [1.0, 1.0]]) == pytest.approx([1.0, 0.0])


def test_adaptive_numbers_beats_its_members(numbers):
    bases = {"line": ("regr.lm", {}, ["x"]), "tree": ("regr.tree", {"maxDepth": 3}, ["z"]), "bad": ("regr.tree", {"maxDepth": 1}, ["z"])}
    found = E.adaptive(bases, numbers, 3, margin=100.0, seed=2)
    stored = E.out_of_fold(bases, numbers, 3, 2).collect()
    assert len(stored) == 120
    error = lambda w: sum((sum(w[n] * r[n] for n in w) - r["truth"]) ** 2 for r in stored)
    assert error(found.weights) <= min(error({n: 1.0}) for n in bases) + 1e-6
    assert len(E.adaptive(bases, numbers, 3, margin=0.0, seed=2).weights) == 2
    assert found.predict(numbers.df).filter("response is null").count() == 0


def test_adaptive_classes(classes):
    bases = {"a": ("classif.tree", {"maxDepth": 2}), "b": ("classif.nb", {}), "c": ("classif.tree", {"maxDepth": 1}, ["x"])}
    found = E.adaptive(bases, classes, 3, margin=1.0, trials=20, seed=1)
    assert set(found.weights) == set(bases) and sum(found.weights.values()) == pytest.approx(1)
    stored = E.out_of_fold(bases, classes, 3, 1).collect()
    for n in bases:
        folds = [[r[n] == r["truth"] for r in stored if r["fold"] == k] for k in range(3)]
        assert found.performance[n] == pytest.approx(sum(sum(f) / len(f) for f in folds) / 3)
    assert found.predict(classes.df).filter("response = truth").count() > 90


def test_cascade_routes_what_is_unsure(classes, numbers):
    models = [L.train("classif.tree", classes, maxDepth=1), L.train("classif.svm", Task(classes.df.filter("c <> 'c'"), "id", {"c": "target"})), L.train("classif.tree", classes, maxDepth=4)]
    gap = classes.df.limit(1).withColumns({"id": F.lit(900).cast("long"), "x": F.lit(None).cast("double")})
    rows = classes.df.unionByName(gap)
    out = {r["id"]: r for r in E.cascade(models, rows, (0.8, 0.6)).collect()}
    first = {r["id"]: r for r in models[0].predict(rows).collect()}
    last = {r["id"]: r for r in models[2].predict(rows).collect()}
    assert len(out) == 121 and out[900]["stage"] == 2 and out[900]["response"] is None
    for i, r in out.items():
        sure = (first[i]["score"] or 0) >= 0.8
        assert r["stage"] == (0 if sure else 2)  # the second gives no shares, so 0.5
        assert r["response"] == (first if sure else last)[i]["response"]
    regr = E.cascade([L.train("regr.lm", numbers), L.train("regr.tree", numbers)], numbers.df, (0.0,))
    assert regr.filter("stage = 0").count() == 120 and regr.select("confidence").distinct().count() == 1
    with pytest.raises(ValueError, match="threshold"):
        E.cascade(models, rows, (0.8,))


def test_folds_are_shared(numbers):
    parts = L.folded(numbers, 3, 1)
    a, b = (L.resample("regr.lm", numbers, 3, 1, rows) for rows in (parts, None))
    key = lambda df: {(r["id"], r["fold"]): round(r["response"], 9) for r in df.collect()}
    assert key(a) == key(b) and len(key(a)) == 120
