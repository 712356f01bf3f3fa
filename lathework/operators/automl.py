"""Search over learners and settings within a time budget.

Trials run side by side as Spark jobs of one group; the folds are stored once for all of them. Rungs of
successive halving give every trial a share of the rows first and all rows to the best only. What isn't done when the budget
ends is cancelled and stays on the leaderboard with that as its error."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass
from math import ceil
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..task import Task
from . import learners as L
from . import scores as S
from .params import Choice, ParamSet, Real, Whole, uniform
from .resample import holdout

#: A trial: learner, settings and the features it sees (None: all).
Trial = tuple[str, dict[str, Any], list[str] | None]

OVER = "over the budget"


def spaces(kind: str) -> dict[str, ParamSet]:
    """Learners worth a try for a kind of task, with the settings to draw from."""
    trees = {"maxDepth": Whole(2, 10), "minInstancesPerNode": Whole(1, 50, log=True)}
    forest = ParamSet(trees | {"numTrees": Whole(20, 100), "featureSubsetStrategy": Choice(["sqrt", "onethird", "all"])})
    shrunk = ParamSet({"regParam": Real(1e-4, 10.0, log=True), "elasticNetParam": Real(0.0, 1.0)})
    if kind == "classif":
        return {"classif.logreg": shrunk, "classif.tree": ParamSet(trees), "classif.forest": forest, "classif.nb": ParamSet({})}
    if kind == "regr":
        return {"regr.lm": ParamSet({}), "regr.elastic": shrunk, "regr.tree": ParamSet(trees), "regr.forest": forest}
    raise ValueError(f"no learners to search for {kind}")


def draw_trials(spark: SparkSession, among: dict[str, ParamSet], n: int = 5, seed: int = 0) -> dict[str, Trial]:
    """``n`` settings of each learner, named learner#0, learner#1, ...; fewer where they repeat."""
    return {f"{name}#{i}": (name, one, None) for name, space in among.items() for i, one in enumerate(space.settings(spark, n, seed))}


def _error(learner: str, pred: DataFrame) -> float | None:
    """The mean of the folds' errors: misclassified share for classes, root mean squared error for numbers."""
    wrong = F.avg((F.col("truth") != F.col("response")).cast("double")) if learner.startswith("classif") else F.sqrt(F.avg(F.pow(F.col("truth") - F.col("response"), F.lit(2))))
    return pred.groupBy("fold").agg(wrong.alias("e")).agg(F.avg("e")).first()[0]


def _together(spark: SparkSession, work: dict[str, Callable[[], float | None]], until: float, workers: int) -> dict[str, tuple[float | None, str | None]]:
    """Score or error of each piece of work, run by ``workers`` threads up to the time ``until``."""
    group = f"automl-{uuid.uuid4().hex}"
    found: dict[str, tuple[float | None, str | None]] = {}

    def one(name: str) -> None:
        if time.monotonic() >= until:
            found[name] = (None, OVER)
            return
        spark.sparkContext.setJobGroup(group, name, interruptOnCancel=True)
        try:
            score = work[name]()
            found[name] = (score, None) if score is not None else (None, "no row has a truth and a response")
        except Exception as e:  # noqa: BLE001  a trial that fails is a row with its error
            found[name] = (None, OVER if time.monotonic() >= until else (str(e).splitlines() or [type(e).__name__])[0][:200])

    with ThreadPoolExecutor(workers) as pool:
        left = {pool.submit(inheritable_thread_target(spark)(one), name) for name in work}
        left = wait(left, max(0.0, until - time.monotonic())).not_done
        while left:  # a trial goes on to its next job, which is cancelled in turn
            spark.sparkContext.cancelJobGroup(group)
            left = wait(left, 0.5).not_done
    return found


def search(task: Task, trials: dict[str, Trial], budget: float = 300.0, folds: int = 5, rungs: int = 1, keep: int = 3, workers: int = 2, seed: int = 0) -> DataFrame:
    """The leaderboard (rank, trial, learner, params, rung, rows, score, error): trials that reached the highest rung
    first, then by least score, ties by name; those without a score come last, by name.

    Rung r of ``rungs`` sees a share of keep^(r + 1 - rungs) of the rows, drawn by md5, and its best 1 / ``keep``
    go on. ``rung`` and ``score`` are those of the last one that gave a score; ``error`` tells what ended a
    trial after that. ``rows`` is the share of rows. A budget of ``budget`` seconds covers all rungs."""
    if rungs < 1 or keep < 2 or not trials:
        raise ValueError("a search takes a trial and a rung at least, and keeps one in two at most")
    spark, until = task.df.sparkSession, time.monotonic() + budget
    parts = cut(L.folded(task, folds, seed).withColumn("_share", uniform(seed, task.row_id, "rung")))
    state: dict[str, tuple[int | None, float | None, float | None, str | None]] = {n: (None, None, None, None) for n in trials}
    alive = sorted(trials)
    for rung in range(rungs):
        share = float(keep) ** (rung + 1 - rungs)
        rows = (parts if share == 1.0 else parts.filter(F.col("_share") < share)).drop("_share")

        def work(name: str) -> Callable[[], float | None]:
            learner, params, features = trials[name]
            seen = task if features is None else task.select(features)
            kept = rows.select(*seen.df.columns, "_fold")
            return lambda: _error(learner, L.resample(learner, seen, folds, seed, kept, **params))

        found = _together(spark, {n: work(n) for n in alive}, until, workers)
        for name, (score, error) in found.items():
            state[name] = (rung, share, score, None) if error is None else (*state[name][:3], error)
        done = sorted((n for n in alive if found[n][1] is None), key=lambda n: (found[n][0], n))
        alive = done[: ceil(len(done) / keep)]
        if not alive:
            break
    order = sorted(trials, key=lambda n: (state[n][2] is None, -(state[n][0] or 0), state[n][2] or 0.0, n))
    board = [(i + 1, n, trials[n][0], repr(trials[n][1]), *state[n]) for i, n in enumerate(order)]
    return spark.createDataFrame(board, "rank int, trial string, learner string, params string, rung int, rows double, score double, error string")


@dataclass(frozen=True)
class Found:
    """The leaderboard, the name and model of its first trial, and that model's error on rows that the
    search hasn't seen."""

    board: DataFrame
    best: str
    model: L.Fitted
    score: float | None
    importance: dict[str, float]

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.predict(df)


def automl(task: Task, trials: dict[str, Trial] | None = None, test: float = 0.2, n: int = 3, seed: int = 0, **how) -> Found:
    """Searches on all but a share of ``test`` of the rows, fits the best trial on them and measures it on the rest.
    Without ``trials``, ``n`` settings of every learner of ``spaces`` are drawn. ``how`` goes to ``search``. An
    error if no trial gave a score."""
    task.check_target()
    spark = task.df.sparkSession
    trials = draw_trials(spark, spaces(task.kind), n, seed) if trials is None else trials
    parts = cut(holdout(task.df, task.row_id, 1 - test, seed))
    known = task.with_df(parts.filter("is_train").drop("is_train"))
    board = search(known, trials, seed=seed, **how)
    first = board.filter("rank = 1 and score is not null").first()
    if first is None:
        raise RuntimeError(f"no trial gave a score: {board.first()['error']}")
    learner, params, features = trials[first["trial"]]
    seen = known if features is None else known.select(features)
    model = L.train(learner, seen, **params)
    score = _error(learner, model.predict(parts.filter("not is_train")).withColumn("fold", F.lit(0)))
    try:
        worth = L.importance(model, seen)
    except StopIteration:  # a model that has no importances
        worth = {}
    return Found(board, first["trial"], model, score, worth)


def compare(task: Task, learners: dict[str, dict[str, Any]], folds: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(learner, mean_rank, final_rank) over the folds, the best first, and Friedman's statistic with the folds as blocks.
    Learners that fail are left out; ``learners.benchmark`` tells their errors."""
    scores = cut(L.benchmark({"task": task}, learners, folds, seed).filter("error is null"))
    blocks = scores.select(F.col("fold").alias("task"), "learner", "score")
    return S.rank_learners(blocks, minimize=task.kind == "regr"), S.friedman(blocks)
