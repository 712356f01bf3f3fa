"""Graphs of fit/transform steps with branches.

What a node gives is kept in a struct column of its own beside the task's columns. Branches so share one
scan and one row, and joining them again takes no join: a node with several inputs unpacks their structs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import learners as L
from ..task import Task
from .pipeline import Step

HELD = "_held_"


def passed(df: DataFrame, features: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """A step that changes nothing: a union, if it has several inputs."""
    return lambda x: x


def chosen(*names: str) -> Step:
    """Only the features named."""

    def step(df: DataFrame, features: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
        if missing := sorted(set(names) - set(features)):
            raise ValueError(f"no features {missing}")
        return lambda x: x.drop(*[f for f in features if f not in names])

    return step


def mapped(change: Callable[[DataFrame], DataFrame]) -> Step:
    """A step that learns nothing."""
    return lambda df, features: change


@dataclass(frozen=True)
class Graph:
    """Steps by name and edges between them. A node without an input sees the task's features; one with several sees
    those of all, and names that occur in more than one of them get the input's name in front (``scale_x``). There is one
    node without an output. A step may add, change and drop features and drop rows, which are then gone for all branches;
    other columns stay as they are."""

    steps: dict[str, Step]
    edges: Sequence[tuple[str, str]] = ()

    def __post_init__(self) -> None:
        if unknown := sorted({n for e in self.edges for n in e} - set(self.steps)):
            raise ValueError(f"no steps {unknown}")
        if len(set(self.edges)) < len(self.edges):
            raise ValueError("an edge occurs twice")
        self.order()
        if len(self.ends()) != 1:
            raise ValueError(f"one step ends the graph, not {self.ends()}")

    def inputs(self, node: str) -> list[str]:
        return [a for a, b in self.edges if b == node]

    def ends(self) -> list[str]:
        return [n for n in self.steps if all(a != n for a, _ in self.edges)]

    def order(self) -> list[str]:
        """The steps, each after its inputs."""
        out: list[str] = []
        while ready := [n for n in self.steps if n not in out and all(a in out for a in self.inputs(n))]:
            out += ready
        if len(out) < len(self.steps):
            raise ValueError(f"steps in a circle: {[n for n in self.steps if n not in out]}")
        return out

    def fit(self, task: Task) -> FittedGraph:
        """Each step learns from the task's rows as its inputs give them."""
        if clash := [c for c in task.df.columns if c.startswith(HELD)]:
            raise ValueError(f"columns {clash} have a name in use")
        others = [c for c in task.df.columns if c not in task.features]
        df = _start(task.df, task.features)
        applied: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []
        for node in self.order():
            seen, features = _unpacked(df, self.inputs(node), others)
            apply = self.steps[node](seen, features)
            applied.append((node, apply))
            df = _packed(apply(seen), node, others)
        return FittedGraph(self, task, tuple(task.features), applied)


def _start(df: DataFrame, features: Sequence[str]) -> DataFrame:
    others = [c for c in df.columns if c not in features]
    return df.select(*others, F.struct(*features).alias(HELD))


def _unpacked(df: DataFrame, inputs: Sequence[str], others: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with the inputs' features as columns, and their names."""
    types = {f.name: f.dataType for f in df.schema.fields}
    fields = [(i, f) for i in (inputs or [""]) for f in types[HELD + i].names]
    often = {f for _, f in fields if sum(f == g for _, g in fields) > 1}
    named = [(i, f, f"{i}_{f}" if f in often else f) for i, f in fields]
    names = [n for _, _, n in named]
    if clash := sorted({n for n in names if names.count(n) > 1 or n in others}):
        raise ValueError(f"features {clash} have a name in use")
    return df.select("*", *[F.col(HELD + i)[f].alias(n) for i, f, n in named]), names


def _packed(df: DataFrame, node: str, others: Sequence[str]) -> DataFrame:
    held = [c for c in df.columns if c.startswith(HELD)]
    features = [c for c in df.columns if c not in others and c not in held]
    if not features:
        raise ValueError(f"{node} leaves no feature")
    return df.select(*[c for c in df.columns if c in others or c in held], F.struct(*features).alias(HELD + node))


@dataclass(frozen=True)
class FittedGraph:
    graph: Graph
    task: Task
    features: tuple[str, ...]
    applied: list[tuple[str, Callable[[DataFrame], DataFrame]]]

    def transform(self, df: DataFrame) -> Task:
        """``df`` as the last step gives it, as a task with the roles of the one fitted on. Columns that the
        features aren't among are kept; a target may be missing."""
        others = [c for c in df.columns if c not in self.features]
        df = _start(df, self.features)
        for node, apply in self.applied:
            df = _packed(apply(_unpacked(df, self.graph.inputs(node), others)[0]), node, others)
        out, names = _unpacked(df, self.graph.ends(), others)
        return self.task.with_df(out.select(*others, *names))


@dataclass(frozen=True)
class GraphModel:
    """A fitted graph and the learner fitted on what it gives."""

    graph: FittedGraph
    model: L.Fitted

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.predict(self.graph.transform(df).df)


def train(graph: Graph, learner: str, task: Task, **params: Any) -> GraphModel:
    """Graph and learner, both fitted on the task's rows only."""
    fitted = graph.fit(task)
    return GraphModel(fitted, L.train(learner, fitted.transform(task.df), **params))


def resample(graph: Graph, learner: str, task: Task, folds: int = 5, seed: int = 0, **params: Any) -> DataFrame:
    """(row_id, truth, response, ..., fold): each row predicted by the graph and learner that were fitted without
    its fold, so that no step learns from rows to be predicted."""
    rows, out = L.folded(task, folds, seed), None
    for k in range(folds):
        model = train(graph, learner, task.with_df(rows.filter(F.col("_fold") != k).drop("_fold")), **params)
        one = model.predict(rows.filter(F.col("_fold") == k).drop("_fold")).withColumn("fold", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out
