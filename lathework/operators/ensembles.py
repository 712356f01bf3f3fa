"""Ensembles of `pyspark.ml` learners: bootstrap draws with their spread, weights found on
out-of-fold predictions, and cascades.

A base is (learner, settings) or (learner, settings, features), where a learner sees only
some of the task's features. Predictions of all members are columns of one row, so that no join and
no union is made for them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations
from math import exp, factorial, log, pi
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..task import Task
from .learners import Fitted, folded, resample, train

#: Draws above this one have a chance under 1e-9 at a ratio of 1.
MOST = 12


def draws(row_id: str, number: int, ratio: float, seed: int) -> Column:
    """How often a row is in bootstrap draw ``number``: a Poisson count with mean ``ratio``, the
    usual stand-in for draws with replacement where rows are not numbered. It is read off 32 bits of the md5 of
    seed:number:id, so that no row is moved and a rerun draws the same."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(number)), F.col(row_id).cast("string"))
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    below = [sum(exp(-ratio) * ratio**j / factorial(j) for j in range(k + 1)) for k in range(MOST)]
    return _total([(u >= F.lit(int(b * 2**32))).cast("int") for b in below])


def _total(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _base(task: Task, base: tuple) -> tuple[str, dict[str, Any], Task]:
    learner, params, features = (*base, None)[:3]
    return learner, params, task.select(features) if features else task


def _rated(members: Sequence[str], weights: Sequence[float]) -> Column:
    """An array of (label, weight), without members that have no prediction."""
    return F.array_compact(F.array(*[F.when(F.col(m).isNotNull(), F.struct(F.col(m).alias("label"), F.lit(float(w)).alias("w"))) for m, w in zip(members, weights, strict=True)]))


def _shares(rated: Column) -> Column:
    """(share, label) of each label, the largest share first, then the least label."""
    total = F.aggregate(rated, F.lit(0.0), lambda a, x: a + x["w"])
    share = lambda label: F.aggregate(F.filter(rated, lambda x: x["label"] == label), F.lit(0.0), lambda a, x: a + x["w"])
    labels = F.array_distinct(F.transform(rated, lambda x: x["label"]))
    each = F.transform(labels, lambda label: F.struct((-share(label) / total).alias("less"), label.alias("label")))
    return F.transform(F.array_sort(each), lambda x: F.struct((-x["less"]).alias("share"), x["label"].alias("label")))


def _mean(members: Sequence[str], weights: Sequence[float]) -> Column:
    pairs = list(zip(members, weights, strict=True))
    return _total([F.coalesce(F.col(m) * w, F.lit(0.0)) for m, w in pairs]) / F.nullif(_total([F.when(F.col(m).isNotNull(), w).otherwise(0.0) for m, w in pairs]), F.lit(0.0))


def _predicted(rows: DataFrame, models: Sequence[Fitted], prefix: str = "_m") -> tuple[DataFrame, list[str]]:
    names = [f"{prefix}{i}" for i in range(len(models))]
    for name, m in zip(names, models, strict=True):
        rows = m.add(rows, name).drop(f"{name}_score")
    return rows, names


def _truth(df: DataFrame, target: str | None) -> Column:
    return F.col(target) if target in df.columns else F.lit(None).cast("string")


@dataclass(frozen=True)
class Bayesian:
    """Models of bootstrap draws; ``weights`` add up to 1."""

    models: list[Fitted]
    weights: list[float]
    confidence: float = 0.95

    def predict(self, df: DataFrame) -> DataFrame:
        """Numbers: (row_id, truth, response, std, lower, upper), the members' weighted mean and its
        spread, and the quantiles of their predictions that hold ``confidence`` between them. Classes:
        (row_id, truth, response, score, entropy), the label with most weight (ties: the least), its share and the
        entropy of the shares in nats. Null where a feature is."""
        first = self.models[0]
        rows, names = _predicted(df, self.models)
        head = [F.col(first.row_id), _truth(df, first.target).alias("truth")]
        if first.kind == "classif":
            rows = rows.withColumn("_s", _shares(_rated(names, self.weights)))
            top, none = F.get("_s", F.lit(0)), F.size("_s") == 0
            entropy = F.aggregate("_s", F.lit(0.0), lambda a, x: a - F.when(x["share"] > 0, x["share"] * F.ln(x["share"])).otherwise(0.0))
            return rows.select(*head, top["label"].alias("response"), top["share"].alias("score"), F.when(~none, entropy).alias("entropy"))
        mean = _mean(names, self.weights)
        spread = _total([w * (F.col(m) - F.col("response")) * (F.col(m) - F.col("response")) for m, w in zip(names, self.weights, strict=True)])
        rows = rows.withColumn("response", mean).withColumn("_a", F.array_sort(F.array(*names)))

        def at(p: float) -> Column:
            h = p * (len(names) - 1)
            lo, hi = F.get("_a", F.lit(int(h))), F.get("_a", F.lit(min(int(h) + 1, len(names) - 1)))
            return lo + (hi - lo) * (h - int(h))

        tail = (1 - self.confidence) / 2
        return rows.select(*head, "response", F.sqrt(spread).alias("std"), at(tail).alias("lower"), at(1 - tail).alias("upper"))


def bayesian(bases: Sequence[tuple], task: Task, n: int = 100, ratio: float = 0.8, seed: int = 0, posterior: bool = False, confidence: float = 0.95) -> Bayesian:
    """``n`` bootstrap draws, each base fitted on each, so ``n`` times the bases fits; a draw is a
    weight column, for learners that take weights. Members count alike or, with ``posterior``, by the likelihood
    of the rows that their draw left out (a geometric mean a row: of a normal density with the member's own variance, or
    of hits and misses by class). The likelihoods of all members come from one pass."""
    models, drawn = [], []
    for b in range(n):
        rows = task.df.withColumn("_draws", draws(task.row_id, b, ratio, seed).cast("double"))
        for base in bases:
            learner, params, own = _base(task, base)
            models.append(train(learner, Task(rows.select(own.row_id, *own.features, task.target, "_draws"), own.row_id, {task.target: "target", "_draws": "weight"}), **params))
            drawn.append(b)
    if not posterior:
        return Bayesian(models, [1 / len(models)] * len(models), confidence)
    rows, names = _predicted(task.df, models)
    left = [F.when(draws(task.row_id, b, ratio, seed) == 0, F.col(m)) for b, m in zip(drawn, names, strict=True)]
    if models[0].kind == "classif":
        cells = [F.avg(F.when(x.isNotNull(), (x == F.col(task.target)).cast("double"))) for x in left]
        like = [_even(p) for p in rows.agg(*cells).first()]
    else:
        cells = [F.avg((x - F.col(task.target)) * (x - F.col(task.target))) for x in left]
        like = [-0.5 * (log(2 * pi * max(v, 1e-12)) + 1) if v is not None else None for v in rows.agg(*cells).first()]
    best = max((x for x in like if x is not None), default=0.0)
    raw = [exp(x - best) if x is not None else 0.0 for x in like]
    return Bayesian(models, [x / sum(raw) for x in raw] if sum(raw) else [1 / len(raw)] * len(raw), confidence)


def _even(p: float | None) -> float | None:
    """The mean logarithm of the likelihood of hits and misses with a share ``p`` of hits."""
    if p is None:
        return None
    return sum(x * log(x) for x in (p, 1 - p) if x > 0) if p > 0.5 else -log(2.0)


@dataclass(frozen=True)
class Adaptive:
    """``performance`` of every base, by name, and the weights of those chosen."""

    models: dict[str, Fitted]
    performance: dict[str, float]
    weights: dict[str, float]

    def predict(self, df: DataFrame) -> DataFrame:
        """(row_id, truth, response): the weighted mean, or the label with most weight (ties: the least)."""
        names = sorted(self.weights)
        first = self.models[names[0]]
        rows, members = _predicted(df, [self.models[n] for n in names])
        weights = [self.weights[n] for n in names]
        out = F.get(_shares(_rated(members, weights)), F.lit(0))["label"] if first.kind == "classif" else _mean(members, weights)
        return rows.select(first.row_id, _truth(df, first.target).alias("truth"), out.alias("response"))


def out_of_fold(bases: dict[str, tuple], task: Task, folds: int = 5, seed: int = 0) -> DataFrame:
    """(row_id, truth, fold, a column a base): out-of-fold predictions, brought together by one
    shuffle and stored."""
    parts, tall = folded(task, folds, seed), None
    for name, base in bases.items():
        learner, params, own = _base(task, base)
        one = resample(learner, own, folds, seed, parts.select(*own.df.columns, "_fold"), **params).select(task.row_id, "truth", "fold", "response", F.lit(name).alias("_n"))
        tall = one if tall is None else tall.unionByName(one)
    return cut(tall.groupBy(task.row_id, "fold").agg(F.first("truth").alias("truth"), *[F.max(F.when(F.col("_n") == n, F.col("response"))).alias(n) for n in bases]))


def simplex_weights(gram: Sequence[Sequence[float]]) -> list[float]:
    """The weights, none below zero and 1 in all, with the least w'Gw, where G holds the mean products of
    members' errors: solved for every set of members on its own, so for at most ten."""
    import numpy as np

    g = np.asarray(gram, dtype=float)
    k, best, found = len(g), float("inf"), None
    if k > 10:
        raise ValueError("at most ten members")
    for size in range(1, k + 1):
        for some in combinations(range(k), size):
            part = np.linalg.lstsq(g[np.ix_(some, some)], np.ones(size), rcond=None)[0]
            total = part.sum()
            if not np.isfinite(total) or total <= 0 or (part < -1e-12 * abs(total)).any():
                continue
            w = np.zeros(k)
            w[list(some)] = np.clip(part / total, 0, None)
            worth = float(w @ g @ w)
            if worth < best - 1e-15:
                best, found = worth, w
    return [float(x) for x in (found if found is not None else np.full(k, 1 / k))]


def _trial(names: Sequence[str], number: int, seed: int) -> list[float]:
    """Weights drawn at random: number 0 is even, others share out exponential draws from md5."""
    from hashlib import md5

    if number == 0:
        return [1 / len(names)] * len(names)
    raw = [-log((int(md5(f"{seed}:{number}:{n}".encode()).hexdigest()[:8], 16) + 1) / 2**32) for n in names]
    return [x / sum(raw) for x in raw] if sum(raw) else [1 / len(names)] * len(names)


def adaptive(bases: dict[str, tuple], task: Task, folds: int = 5, margin: float = 0.1, trials: int = 50, seed: int = 0) -> Adaptive:
    """Bases whose out-of-fold performance (the folds' mean of accuracy or of minus the squared error) is within
    ``margin`` of the best, at least two, weighted so that their mix does best out of fold: exactly for numbers, as
    its squared error is a quadratic form of the weights; for classes the best of even weights and ``trials``
    drawn ones. Either takes one aggregate over the stored predictions. Rows that a chosen base leaves without
    prediction don't count."""
    stored = out_of_fold(bases, task, folds, seed)
    names = sorted(bases)
    classes = next(iter(bases.values()))[0].startswith("classif")
    score = {n: F.avg((F.col(n) == F.col("truth")).cast("double")) if classes else -F.avg((F.col(n) - F.col("truth")) * (F.col(n) - F.col("truth"))) for n in names}
    found = stored.groupBy("fold").agg(*[score[n].alias(n) for n in names]).agg(*[F.avg(n).alias(n) for n in names]).first()
    order = sorted((n for n in names if found[n] is not None), key=lambda n: (-found[n], n))
    if not order:
        raise ValueError("no base has predictions")
    chosen = [n for n in order if found[n] >= found[order[0]] - margin]
    chosen = sorted(chosen if len(chosen) > 1 else order[:2])
    rows = stored.dropna(subset=[*chosen, "truth"])
    if classes:
        every = [_trial(chosen, t, seed) for t in range(trials + 1)]
        votes = [[_total([F.when(F.col(m) == F.col(n), w).otherwise(0.0) for m, w in zip(chosen, ws, strict=True)]) for n in chosen] for ws in every]
        picks = [F.array_min(F.array(*[F.struct((-v).alias("less"), F.col(n).alias("label")) for v, n in zip(vs, chosen, strict=True)]))["label"] for vs in votes]
        hits = rows.agg(*[F.avg((p == F.col("truth")).cast("double")).alias(str(i)) for i, p in enumerate(picks)]).first()
        weights = every[max(range(len(every)), key=lambda i: (hits[i] or 0.0, -i))]
    else:
        err = {n: F.col(n) - F.col("truth") for n in chosen}
        row = rows.agg(*[F.avg(err[a] * err[b]).alias(f"{i}_{j}") for i, a in enumerate(chosen) for j, b in enumerate(chosen)]).first()
        weights = simplex_weights([[row[f"{i}_{j}"] or 0.0 for j in range(len(chosen))] for i in range(len(chosen))])
    models = {}
    for n in chosen:
        learner, params, own = _base(task, bases[n])
        models[n] = train(learner, own, **params)
    return Adaptive(models, {n: found[n] for n in names}, dict(zip(chosen, weights, strict=True)))


#: Confidence that a cascade asks of its first members, where none is given.
THRESHOLDS = (0.9, 0.8, 0.7, 0.6, 0.5)


def cascade(models: Sequence[Fitted], df: DataFrame, thresholds: Sequence[float] | None = None) -> DataFrame:
    """(row_id, truth, response, stage, confidence): the first model answers the rows that it is confident
    of, the next sees only the rest, and the last takes what is left. What a stage says is stored, so that no model
    predicts a row twice.

    Confidence is the share of the likeliest class, 0.5 for classifiers without shares, and for numbers the
    same for all rows of a stage: 1 / (1 + median distance of its predictions to their median)."""
    from .ordered import with_quantiles

    limits = list(thresholds or THRESHOLDS)
    if len(limits) < len(models) - 1:
        raise ValueError("a threshold for every model but the last")
    first, out, rest = models[0], None, df
    for i, m in enumerate(models):
        scored = m.add(rest, "_m")
        if m.kind == "regr":
            scored = with_quantiles(scored, "_m", {"_mid": 0.5})
            scored = with_quantiles(scored, F.abs(F.col("_m") - F.col("_mid")), {"_far": 0.5}).withColumn("_sure", 1 / (1 + F.col("_far"))).drop("_mid", "_far")
        else:
            scored = scored.withColumn("_sure", F.col("_m_score") if "_m_score" in scored.columns else F.when(F.col("_m").isNotNull(), F.lit(0.5)))
        scored = cut(scored)
        taken = F.lit(True) if i == len(models) - 1 else F.coalesce(F.col("_sure") >= limits[i], F.lit(False))
        one = scored.filter(taken).select(first.row_id, _truth(df, first.target).alias("truth"), F.col("_m").alias("response"), F.lit(i).alias("stage"), F.col("_sure").alias("confidence"))
        out = one if out is None else out.unionByName(one)
        rest = scored.filter(~taken).select(*df.columns)
    return out
