"""Versions, stages and racing writers."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

from lathework.operators import learners as L
from lathework.operators.model_store import ModelStore
from lathework.task import Task


@pytest.fixture
def store(spark, tmp_path):
    return ModelStore(spark, str(tmp_path / "store"))


def _fitted(spark, learner="regr.lm", target="v"):
    df = spark.range(40).selectExpr("id", "double(id % 9) x", "2 * double(id % 9) + 1 v", "if(id % 9 > 4, 'hi', 'lo') c").select("id", "x", target)
    return df, L.train(learner, Task(df, "id", {target: "target"}))


def test_versions_and_stages(spark, store):
    df, model = _fitted(spark)
    assert store.models().count() == 0 and store.log("m").count() == 0
    assert [store.register("m", model, {"rmse": e}, {"by": "a"}) for e in (0.3, 0.2, 0.1)] == [1, 2, 3]
    assert store.register("other", model, tags={"by": "b"}) == 1
    store.set_stage("m", 1, "production")
    store.set_stage("m", 2, "production")
    assert {(r["version"], r["stage"]) for r in store.models("m").collect()} == {(1, "archived"), (2, "production"), (3, "development")}
    assert [(r["name"], r["version"]) for r in store.search("production").collect()] == [("m", 2)]
    assert {r["version"] for r in store.search(tags={"by": "a"}, at_most={"rmse": 0.25}).collect()} == {2, 3}
    assert store.search(at_least={"rmse": 0.0}, tags={"by": "b"}).count() == 0
    assert store.load("m", stage="production").predict(df).filter("abs(truth - response) > 1e-6").count() == 0
    assert store.cleanup("m", 1) == [1] and store.register("m", model) == 4
    assert [r["action"] for r in store.log("m").orderBy("seq").collect()] == ["register"] * 3 + ["stage"] * 2 + ["delete", "register"]


def test_classes_come_back(spark, store):
    df, model = _fitted(spark, "classif.tree", "c")
    store.register("tree", model)
    again = store.load("tree")
    assert again.kind == "classif" and again.features == ("x",)
    assert sorted(map(tuple, again.predict(df).collect())) == sorted(map(tuple, model.predict(df).collect()))


def test_racing_writers_get_numbers_of_their_own(spark, store):
    _, model = _fitted(spark)
    with ThreadPoolExecutor(4) as pool:
        got = sorted(pool.map(lambda _: store.register("m", model), range(6)))
    assert got == [1, 2, 3, 4, 5, 6] and store.models("m").select("path").distinct().count() == 6
    assert [r["seq"] for r in store.log("m").orderBy("seq").collect()] == [1, 2, 3, 4, 5, 6]


def test_errors(spark, store):
    _, model = _fitted(spark)
    store.register("m", model)
    store.delete("m", 1)
    for call, kind in (
        (lambda: store.load("m"), KeyError), (lambda: store.load("none"), KeyError), (lambda: store.set_stage("m", 1, "staging"), KeyError), (lambda: store.set_stage("m", 1, "what"), ValueError),
        (lambda: store.delete("m", 1), KeyError), (lambda: store.register("../m", model), ValueError),
    ):
        with pytest.raises(kind):
            call()
