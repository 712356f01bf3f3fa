"""Typed parameter spaces: what a setting may hold, defaults, grids and draws.

A draw is a column expression: the md5 of seed, id and parameter, as a number from 0 to 1, carried to the
parameter's range. The same expression gives a row of a table its setting and a search its trials."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product
from math import exp, floor, log
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, key: str, name: str) -> Column:
    """A number from 0 to below 1, from the first eight hex digits of md5('seed:name:key')."""
    text = F.concat(F.lit(f"{seed}:{name}:"), F.coalesce(F.col(key).cast("string"), F.lit("-")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


@dataclass(frozen=True)
class Param:
    """A parameter's ``default``, None for none, and ``when``: values of other parameters without
    which it has no value."""

    default: Any = field(default=None, kw_only=True)
    when: dict[str, Any] = field(default_factory=dict, kw_only=True)


@dataclass(frozen=True)
class Real(Param):
    """A number from ``low`` to ``high``, drawn evenly, or evenly by its logarithm."""

    low: float
    high: float
    log: bool = False

    def __post_init__(self) -> None:
        _range(self.low, self.high, self.log)

    def check(self, value: Any) -> float:
        if isinstance(value, bool) or not isinstance(value, int | float) or not self.low <= value <= self.high:
            raise ValueError(f"{value!r} is no number from {self.low} to {self.high}")
        return float(value)

    def draw(self, u: Column) -> Column:
        if self.log:
            a, b = log(self.low), log(self.high)
            return F.least(F.greatest(F.exp(F.lit(a) + u * (b - a)), F.lit(float(self.low))), F.lit(float(self.high)))
        return F.lit(float(self.low)) + u * float(self.high - self.low)

    def levels(self, n: int) -> list[float]:
        """``n`` values from end to end."""
        if n == 1 or self.low == self.high:
            return [float(self.low)]
        at = [i / (n - 1) for i in range(n)]
        if self.log:
            a, b = log(self.low), log(self.high)
            return [float(self.low), *[exp(a + x * (b - a)) for x in at[1:-1]], float(self.high)]
        return [self.low + x * (self.high - self.low) for x in at]


@dataclass(frozen=True)
class Whole(Param):
    """A whole number from ``low`` to ``high``, both included."""

    low: int
    high: int
    log: bool = False

    def __post_init__(self) -> None:
        _range(self.low, self.high, self.log)

    def check(self, value: Any) -> int:
        if isinstance(value, bool) or not isinstance(value, int | float) or value != floor(value) or not self.low <= value <= self.high:
            raise ValueError(f"{value!r} is no whole number from {self.low} to {self.high}")
        return int(value)

    def draw(self, u: Column) -> Column:
        if self.log:
            a, b = log(self.low), log(self.high + 1)
            out = F.floor(F.exp(F.lit(a) + u * (b - a)))
        else:
            out = F.lit(self.low) + F.floor(u * (self.high - self.low + 1))
        return F.least(F.greatest(out, F.lit(self.low)), F.lit(self.high)).cast("long")

    def levels(self, n: int) -> list[int]:
        """At most ``n`` values from end to end, each once."""
        return sorted({floor(x + 0.5) for x in Real(self.low, self.high, self.log).levels(n)})


@dataclass(frozen=True)
class Choice(Param):
    """One of ``values``, which are all of one type."""

    values: Sequence[Any]

    def __post_init__(self) -> None:
        if not self.values or len({type(v) for v in self.values}) > 1:
            raise ValueError("values are of one type, and there is one at least")

    def check(self, value: Any) -> Any:
        if not any(value == v and type(value) is type(v) for v in self.values):
            raise ValueError(f"{value!r} is none of {list(self.values)}")
        return value

    def draw(self, u: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in self.values]), (F.floor(u * len(self.values)) + 1).cast("int"))

    def levels(self, n: int) -> list[Any]:
        return list(self.values)


def _range(low: float, high: float, by_log: bool) -> None:
    if low > high or (by_log and low <= 0):
        raise ValueError(f"no range from {low} to {high}")


@dataclass(frozen=True)
class ParamSet:
    """Parameters by name. One that depends on others comes after them."""

    params: dict[str, Param]

    def __post_init__(self) -> None:
        known: set[str] = set()
        for name, p in self.params.items():
            if missing := set(p.when) - known:
                raise ValueError(f"{name} depends on {sorted(missing)}, which must come before it")
            known.add(name)

    def defaults(self) -> dict[str, Any]:
        return {n: p.default for n, p in self.params.items() if p.default is not None}

    def validate(self, values: dict[str, Any]) -> dict[str, Any]:
        """``values`` as the parameters' types, with defaults for those left out; an error for an unknown
        name, a value out of range, or one whose condition isn't met."""
        if unknown := sorted(set(values) - set(self.params)):
            raise ValueError(f"unknown parameters {unknown}")
        out: dict[str, Any] = {}
        for name, p in self.params.items():
            met = all(out.get(k) == v for k, v in p.when.items())
            if name in values:
                if not met:
                    raise ValueError(f"{name} needs {p.when}")
                try:
                    out[name] = p.check(values[name])
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from None
            elif met and p.default is not None:
                out[name] = p.default
        return out

    def draw(self, df: DataFrame, key: str, seed: int = 0) -> DataFrame:
        """``df`` with a column a parameter: the setting that belongs to the row's ``key``. A parameter whose
        condition isn't met is null. Rows of one key have one setting; a null key counts as ``-``."""
        if clash := sorted(set(self.params) & set(df.columns)):
            raise ValueError(f"{clash} are columns already")
        for name, p in self.params.items():
            value = p.draw(uniform(seed, key, name))
            for other, needed in p.when.items():
                value = F.when(F.col(other) == F.lit(needed), value)
            df = df.withColumn(name, value)
        return df

    def settings(self, spark: SparkSession, n: int, seed: int = 0) -> list[dict[str, Any]]:
        """The settings of ids 0 to ``n`` - 1, without those that repeat an earlier one."""
        out = []
        for r in self.draw(spark.range(n), "id", seed).orderBy("id").collect():  # n trials
            one = {k: r[k] for k in self.params if r[k] is not None}
            if one not in out:
                out.append(one)
        return out

    def grid(self, levels: int = 3) -> list[dict[str, Any]]:
        """Every combination of ``levels`` values of numbers and all values of choices, each once; a
        parameter whose condition isn't met is left out."""
        out = []
        for values in product(*[p.levels(levels) for p in self.params.values()]):
            one: dict[str, Any] = {}
            for (name, p), v in zip(self.params.items(), values, strict=True):
                if all(one.get(k) == x for k, x in p.when.items()):
                    one[name] = v
            if one not in out:
                out.append(one)
        return out
