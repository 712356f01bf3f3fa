"""Chains of fit/transform steps on tasks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..task import Task

#: A step learns from a training frame and its features and gives a function of frames.
Step = Callable[[DataFrame, Sequence[str]], Callable[[DataFrame], DataFrame]]


@dataclass
class Pipeline:
    """Steps in order; ``fit`` runs each on what the ones before it gave for the
    training rows only, so that nothing is learnt from rows to be predicted."""

    steps: list[tuple[str, Step]]
    fitted: list[tuple[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)

    def fit(self, task: Task) -> Task:
        self.fitted = []
        for name, step in self.steps:
            apply = step(task.df, task.features)
            self.fitted.append((name, apply))
            task = task.with_df(apply(task.df))
        return task

    def transform(self, task: Task) -> Task:
        for _, apply in self.fitted:
            task = task.with_df(apply(task.df))
        return task


def scaler(df: DataFrame, features: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Standardises numeric features by the training rows' mean and population deviation."""
    from pyspark.sql import functions as F

    numeric = [c for c, t in df.dtypes if c in features and t in ("double", "float", "int", "bigint")]
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in numeric], *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]).first() if numeric else None
    return lambda x: x.withColumns({c: (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0) for c in numeric})


def one_hot(limit: int = 20) -> Step:
    """String features with at most ``limit`` values become 0/1 columns."""
    from ..operators import transform as T

    def step(df: DataFrame, features: Sequence[str]):
        found = {c: T.categories(df, c) for c, t in df.dtypes if c in features and t == "string"}

        def apply(x: DataFrame) -> DataFrame:
            for c, values in found.items():
                x = T.one_hot(x, c, values) if len(values) <= limit else x.drop(c)
            return x

        return apply

    return step
