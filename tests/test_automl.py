"""Parameter spaces, searches with a budget, and comparisons."""

from __future__ import annotations

import time
from hashlib import md5

import pytest

from lathework.operators import automl as A
from lathework.operators import learners as L
from lathework.operators.params import Choice, ParamSet, Real, Whole
from lathework.task import Task

SPACE = ParamSet({"rule": Choice(["a", "b"]), "depth": Whole(1, 4, default=2), "rate": Real(0.01, 1.0, log=True, when={"rule": "b"}, default=0.1)})


def test_validate():
    assert SPACE.defaults() == {"depth": 2, "rate": 0.1}
    assert SPACE.validate({"rule": "b"}) == {"rule": "b", "depth": 2, "rate": 0.1}
    assert SPACE.validate({"rule": "a", "depth": 3.0}) == {"rule": "a", "depth": 3}
    for bad, why in (({"x": 1}, "unknown"), ({"depth": 5}, "depth"), ({"depth": True}, "depth"), ({"depth": 1.5}, "depth"), ({"rule": "a", "rate": 0.5}, "needs"), ({"rule": "c"}, "rule"), ({"rule": "b", "rate": float("nan")}, "rate")):
        with pytest.raises(ValueError, match=why):
            SPACE.validate(bad)
    with pytest.raises(ValueError, match="before"):
        ParamSet({"a": Whole(1, 2, when={"b": 1}), "b": Whole(1, 2)})
    with pytest.raises(ValueError, match="range"):
        Real(0.0, 1.0, log=True)
    with pytest.raises(ValueError, match="one type"):
        Choice([])


def test_grid_has_each_combination_once():
    assert SPACE.grid(2) == [{"rule": "a", "depth": 1}, {"rule": "a", "depth": 4}, *({"rule": "b", "depth": d, "rate": r} for d in (1, 4) for r in (0.01, 1.0))]
    assert Whole(1, 2).levels(5) == [1, 2] and Real(1.0, 1.0).levels(3) == [1.0]
    assert Real(0.01, 1.0, log=True).levels(3) == pytest.approx([0.01, 0.1, 1.0])


def test_draws(spark):
    df = spark.createDataFrame([(i,) for i in range(300)] + [(None,), (7,)], "id long")
    rows = SPACE.draw(df, "id", 3).collect()
    u = lambda name, key: int(md5(f"3:{name}:{key}".encode()).hexdigest()[:8], 16) / 2**32
    for r in rows:
        key = "-" if r["id"] is None else r["id"]
        assert r["rule"] == "ab"[int(u("rule", key) * 2)] and r["depth"] == 1 + int(u("depth", key) * 4)
        assert r["rate"] == (pytest.approx(0.01 * 100 ** u("rate", key)) if r["rule"] == "b" else None)
    assert {r["depth"] for r in rows} == {1, 2, 3, 4} and len(rows) == 302
    every = SPACE.settings(spark, 20, 3)
    assert len(every) > 5 and all(SPACE.validate(s) == s for s in every)
    assert ParamSet({"d": Whole(1, 1)}).settings(spark, 9) == [{"d": 1}] and ParamSet({}).settings(spark, 3) == [{}]
    with pytest.raises(ValueError, match="already"):
        SPACE.draw(df.withColumnRenamed("id", "rule"), "rule")


def _task(spark, n=240):
    df = spark.range(n).selectExpr("id", "double(id % 17) x", "double(id * 7 % 5) z", "double(id % 17) * 3 - double(id * 7 % 5) v")
    return Task(df, "id", {"v": "target"})


def test_search_ranks_and_errors(spark):
    trials = {"lm": ("regr.lm", {}, None), "half": ("regr.lm", {}, ["x"]), "poor": ("regr.lm", {}, ["z"]), "bad": ("regr.lm", {"maxIter": -1}, None), "none": ("regr.what", {}, None)}
    board = A.search(_task(spark), trials, folds=2, rungs=2, keep=2).collect()
    assert [(r["rank"], r["trial"], r["rung"]) for r in board] == [(1, "lm", 1), (2, "half", 1), (3, "poor", 0), (4, "bad", None), (5, "none", None)]
    assert board[0]["score"] < 1e-6 and board[0]["rows"] == 1.0 and board[2]["rows"] == 0.5
    assert board[3]["error"] and board[4]["error"] and not any(r["error"] for r in board[:3])


def test_budget(spark, monkeypatch):
    trials = {"a": ("regr.lm", {}, None), "b": ("regr.lm", {}, None)}
    assert {(r["score"], r["error"]) for r in A.search(_task(spark), trials, 0.0, folds=2).collect()} == {(None, A.OVER)}
    # A job that would take minutes is cancelled, and what it would do next as well.
    real = L.resample

    def slow(learner, task, folds, seed, rows, **params):
        if params.pop("slow", False):
            for _ in range(3):
                spark.range(0, 1, 1, 1).selectExpr("java_method('java.lang.Thread', 'sleep', 60000L) s").collect()
        return real(learner, task, folds, seed, rows, **params)

    monkeypatch.setattr(L, "resample", slow)
    began = time.monotonic()
    board = A.search(_task(spark), {"a": ("regr.lm", {}, None), "slow": ("regr.lm", {"slow": True}, None)}, 15.0, folds=2).collect()
    assert time.monotonic() - began < 50
    assert [(r["trial"], r["error"]) for r in board] == [("a", None), ("slow", A.OVER)]


def test_automl(spark):
    task = _task(spark)
    found = A.automl(task, {"lm": ("regr.lm", {}, None), "poor": ("regr.lm", {}, ["z"])}, folds=2)
    assert found.best == "lm" and found.score < 1e-6 and set(found.importance) == {"x", "z"}
    assert found.predict(task.df).filter("abs(truth - response) > 1e-6").count() == 0
    with pytest.raises(RuntimeError, match="no trial"):
        A.automl(task, {"lm": ("regr.lm", {"maxIter": -1}, None)}, folds=2)
    with pytest.raises(ValueError, match="target"):
        A.automl(Task(task.df, "id"))
    drawn = A.draw_trials(spark, A.spaces("classif"), 3)
    assert {t[0] for t in drawn.values()} == set(A.spaces("classif")) and sum(n.startswith("classif.nb") for n in drawn) == 1


def test_compare(spark):
    ranks, test = A.compare(_task(spark), {"regr.lm": {}, "regr.tree": {"maxDepth": 1}, "regr.what": {}}, folds=3)
    assert [(r["learner"], r["mean_rank"]) for r in ranks.orderBy("final_rank").collect()] == [("regr.lm", 1.0), ("regr.tree", 2.0)]
    assert test.first()["statistic"] == pytest.approx(3.0)
