"""Ensembles of learners, on the embeddings' components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensembles as E
from ..operators import learners as L
from ..sources.readers import table
from ..task import Task
from .catalogue import Catalogue

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql

_POINTS = "SELECT vec_id, embedding[1]::DOUBLE AS x, (embedding[2] > 0)::INT::DOUBLE AS b, embedding[3]::DOUBLE + 0.5::DOUBLE * embedding[1] + 0.2::DOUBLE * (embedding[2] > 0)::INT AS y FROM embeddings"


def _points(spark, d):
    at = lambda i: F.col("embedding")[i].cast("double")
    side = (F.col("embedding")[1] > 0).cast("double")
    return table(spark, d, "embeddings").select("vec_id", at(0).alias("x"), side.alias("b"), (at(2) + 0.5 * at(0) + 0.2 * side).alias("y"))


def _draws(b: str, seed: int, ratio: float) -> str:
    from math import exp, factorial

    below = [int(sum(exp(-ratio) * ratio**j / factorial(j) for j in range(k + 1)) * 2**32) for k in range(E.MOST)]
    u = f"('0x' || md5('{seed}:' || {b} || ':' || vec_id)[1:8])::BIGINT"
    return "(" + " + ".join(f"({u} >= {t})::INT" for t in below) + ")"


@C.add(
    "bayesian_ensemble",
    f"""WITH p AS ({_POINTS}), d AS (SELECT p.*, b.b AS m, {_draws("b.b", 3, 0.8)} AS w FROM p, (SELECT unnest(range(8)) AS b) b),
s AS (SELECT m, sum(w)::DOUBLE AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy FROM d WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY m),
f AS (SELECT m, (w * wxy - wx * wy) / (w * wxx - wx * wx) AS slope, w, wx, wy FROM s), g AS (SELECT m, slope, (wy - slope * wx) / w AS start FROM f),
o AS (SELECT m, exp(-0.5::DOUBLE * (ln(2 * pi() * greatest(avg(pow(y - start - slope * x, 2)), 1e-12)) + 1)) AS l FROM d JOIN g USING (m) WHERE w = 0 GROUP BY m),
v AS (SELECT m, l / sum(l) OVER () AS share FROM o), r AS (SELECT vec_id, y, share, start + slope * x AS r FROM p, g JOIN v USING (m)), a AS (SELECT *, sum(share * r) OVER (PARTITION BY vec_id) AS mean FROM r)
SELECT vec_id, round(any_value(y), 6) AS truth, round(any_value(mean), 6) AS response, round(sqrt(sum(share * pow(r - mean, 2))), 6) AS std, round(quantile_cont(r, 0.025), 6) AS lower, round(quantile_cont(r, 0.975), 6) AS upper FROM a GROUP BY vec_id""",
)
def _(spark, d):
    """Lines through eight weighted draws, weighted by the likelihood of the rows left out."""
    task = Task(_points(spark, d).drop("b"), "vec_id", {"y": "target"})
    out = E.bayesian([("regr.lm", {})], task, 8, 0.8, 3, posterior=True).predict(task.df)
    return out.withColumns({c: F.round(c, 6) for c in ("truth", "response", "std", "lower", "upper")})


_ADAPTIVE = f"""WITH p AS ({_POINTS}), n AS (SELECT *, row_number() OVER (ORDER BY md5('5:' || vec_id), vec_id) - 1 AS pos, count(*) OVER () AS n FROM p),
f AS (SELECT *, CASE WHEN pos < (n % 3) * (n // 3 + 1) THEN pos // (n // 3 + 1) ELSE n % 3 + (pos - (n % 3) * (n // 3 + 1)) // (n // 3) END AS fold FROM n), k AS (SELECT unnest(range(3)) AS k),
line AS (SELECT k, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM f, k WHERE fold <> k GROUP BY k), step AS (SELECT k, b, avg(y) AS m FROM f, k WHERE fold <> k GROUP BY k, b),
e AS (SELECT fold, i + s * x - y AS e1, m - y AS e2 FROM f JOIN line ON line.k = fold JOIN step ON step.k = fold AND step.b = f.b),
perf AS (SELECT avg(p1) AS p1, avg(p2) AS p2 FROM (SELECT -avg(e1 * e1) AS p1, -avg(e2 * e2) AS p2 FROM e GROUP BY fold)),
w AS (SELECT least(1, greatest(0, (avg(e2 * e2) - avg(e1 * e2)) / (avg(e1 * e1) + avg(e2 * e2) - 2 * avg(e1 * e2)))) AS w FROM e)"""


def _adaptive(spark, d):
    task = Task(_points(spark, d), "vec_id", {"y": "target"})
    return task, E.adaptive({"line": ("regr.lm", {}, ["x"]), "step": ("regr.tree", {"maxDepth": 1}, ["b"])}, task, 3, margin=100.0, seed=5)


@C.add("adaptive_weights", f"{_ADAPTIVE} SELECT 'line' AS base, round(p1, 6) AS performance, round(w, 5) AS weight FROM perf, w UNION ALL SELECT 'step', round(p2, 6), round(1 - w, 5) FROM perf, w")
def _(spark, d):
    found = _adaptive(spark, d)[1]
    rows = [(n, round(found.performance[n], 6), round(found.weights[n], 5)) for n in found.weights]
    return spark.createDataFrame(rows, "base string, performance double, weight double")


@C.add("adaptive_ensemble", f"{_ADAPTIVE}, l AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p), t AS (SELECT b, avg(y) AS m FROM p GROUP BY b) SELECT vec_id, round(y, 6) AS truth, round(w * (i + s * x) + (1 - w) * m, 5) AS response FROM p JOIN t USING (b), l, w")
def _(spark, d):
    task, found = _adaptive(spark, d)
    return found.predict(task.df).withColumns({"truth": F.round("truth", 6), "response": F.round("response", 5)})


_SIDES = ("x", "b", "z")
_LABELLED = "SELECT vec_id, label::VARCHAR AS y, (embedding[1] > 0)::INT AS x, (embedding[2] > 0)::INT AS b, (embedding[3] > 0.05)::INT AS z FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL"
_LIMITS = (0.14, 0.13)


def _stump(f: str) -> str:
    """A tree of one 0/1 feature: each side's commonest class, or one leaf where both sides say the same."""
    top = "SELECT {k} AS v, y, c / sum(c) OVER (PARTITION BY {k}) AS share FROM (SELECT {k}, y, count(*)::DOUBLE AS c FROM p GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY c DESC, y) = 1"
    sides, whole = top.format(k=f), top.format(k="0")
    return f"{f}s AS ({sides}), {f}w AS ({whole}), {f}t AS (SELECT v, y, CASE WHEN (SELECT count(DISTINCT y) FROM {f}s) = 1 THEN (SELECT share FROM {f}w) ELSE share END AS share FROM {f}s)"


@C.add(
    "cascade_ensemble",
    f"""WITH p AS ({_LABELLED}), {", ".join(map(_stump, _SIDES))},
a AS (SELECT p.vec_id, p.y AS truth, CASE WHEN xt.share >= {_LIMITS[0]} THEN 0 WHEN bt.share >= {_LIMITS[1]} THEN 1 ELSE 2 END AS stage, [xt.y, bt.y, zt.y] AS r, [xt.share, bt.share, zt.share] AS c FROM p JOIN xt ON xt.v = p.x JOIN bt ON bt.v = p.b JOIN zt ON zt.v = p.z)
SELECT vec_id, truth, r[stage + 1] AS response, stage, round(c[stage + 1], 6) AS confidence FROM a""",
)
def _(spark, d):
    """Three trees of one feature each; a row stops at the first that is sure enough."""
    side = lambda i, t: (F.col("embedding")[i] > t).cast("double")
    e = table(spark, d, "embeddings").filter("embedding is not null and label is not null")
    p = e.select("vec_id", F.col("label").cast("string").alias("y"), side(0, 0.0).alias("x"), side(1, 0.0).alias("b"), side(2, 0.05).alias("z"))
    task = Task(p, "vec_id", {"y": "target"})
    models = [L.train("classif.tree", task.select([f]), maxDepth=1) for f in _SIDES]
    return E.cascade(models, p, _LIMITS).withColumn("confidence", F.round("confidence", 6))
