"""Outliers of whole rows, on the embeddings' components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outliers as O
from ..sources.readers import table
from .catalogue import Catalogue

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql

_XY = ["x", "y"]


def _points(spark, d):
    at = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, d, "embeddings").select("vec_id", at(0).alias("x"), at(1).alias("y"))


def _envelope_sql(steps: int) -> str:
    """Medians and median distances, then ``steps`` times the half with the least distance."""
    out = [
        "p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings WHERE embedding[1] IS NOT NULL AND embedding[2] IS NOT NULL)",
        "m AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM p)",
        "e0 AS (SELECT any_value(mx) AS mx, any_value(my) AS my, 1 / pow(quantile_cont(abs(x - mx), 0.5), 2) AS a, 0.0::DOUBLE AS b, 1 / pow(quantile_cont(abs(y - my), 0.5), 2) AS c FROM p, m)",
    ]
    far = "(x - mx) * (x - mx) * a + 2 * (x - mx) * (y - my) * b + (y - my) * (y - my) * c"
    for i in range(1, steps + 1):
        out.append(f"d{i} AS (SELECT x, y, {far} AS d FROM p, e{i - 1})")
        out.append(f"h{i} AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(x, y) AS vxy, var_pop(y) AS vy FROM d{i} WHERE d <= (SELECT quantile_cont(d, 0.5) + 1e-12 FROM d{i}))")
        out.append(f"e{i} AS (SELECT mx, my, vy / (vx * vy - vxy * vxy) AS a, -vxy / (vx * vy - vxy * vxy) AS b, vx / (vx * vy - vxy * vxy) AS c FROM h{i})")
    out.append(f"s AS (SELECT vec_id, {far} AS d FROM p, e{steps})")
    return f"WITH {', '.join(out)} SELECT v.vec_id, round(d * 2 * ln(2) / (SELECT quantile_cont(d, 0.5) FROM s), 5) AS outlier_score FROM embeddings v LEFT JOIN s USING (vec_id)"


@C.add("elliptic_envelope", _envelope_sql(3))
def _(spark, d):
    """Robust Mahalanobis distances after three concentration steps."""
    p = _points(spark, d)
    return O.elliptic_envelope(p, _XY, 0.5, 3).score(p).select("vec_id", F.round(O.SCORE, 5).alias(O.SCORE))


@C.add("isolation_forest")
def _(spark, d):
    """Scores of every row; checked in the tests against a walk of each tree."""
    p = _points(spark, d)
    return O.isolation_forest(p, "vec_id", _XY, trees=50, seed=1).score(p).select("vec_id", F.round(O.SCORE, 8).alias(O.SCORE))


_FIXED = O.grow([[x * x % 17 / 34 - 0.25, x * 7 % 23 / 46 - 0.25] for x in range(64)], "fixed")


def _depth_sql(at: int = 0) -> str:
    t = _FIXED
    if t.feature[at] < 0:
        return f"{t.depth[at]!r}::DOUBLE"
    return f"CASE WHEN {_XY[t.feature[at]]} < {t.cut[at]!r}::DOUBLE THEN {_depth_sql(t.left[at])} ELSE {_depth_sql(t.right[at])} END"


@C.add("isolation_path", f"WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT vec_id, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN round(pow(2, -({_depth_sql()}) / {O.average_path(64)!r}::DOUBLE), 8) END AS outlier_score FROM p")
def _(spark, d):
    """A forest of one given tree, so that path lengths can be told by nested conditions."""
    p = _points(spark, d)
    return O.Forest(_XY, [_FIXED], 64).score(p).select("vec_id", F.round(O.SCORE, 8).alias(O.SCORE))


_SCORED = "WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), s AS (SELECT *, (x - 0.01) * (x - 0.01) * 4 + (y + 0.02) * (y + 0.02) AS d FROM p), e AS (SELECT *, coalesce(d > (SELECT quantile_cont(d, 0.95) FROM s), false) AS hit FROM s)"


@C.add(
    "outlier_rows",
    f"""{_SCORED} SELECT 'flag' AS action, count(*) AS n, sum(hit::INT)::BIGINT AS outliers, round(avg(x), 8) AS mean FROM e UNION ALL SELECT 'remove', count(*), 0, round(avg(x), 8) FROM e WHERE NOT hit
UNION ALL SELECT 'impute', count(*), 0, round(avg(CASE WHEN hit THEN (SELECT quantile_cont(x, 0.5) FROM p) ELSE x END), 8) FROM e""",
)
def _(spark, d):
    """The three actions on a twentieth of the rows, by distance from a given ellipse."""
    scored = O.Ellipse(_XY, [0.01, -0.02], [[4.0, 0.0], [0.0, 1.0]]).score(_points(spark, d))
    out = None
    for action in ("flag", "remove", "impute"):
        hits = F.sum("is_outlier") if action == "flag" else F.lit(0).cast("long")
        one = O.act(scored, _XY, 0.05, action).agg(F.lit(action).alias("action"), F.count("*").alias("n"), hits.alias("outliers"), F.round(F.avg("x"), 8).alias("mean"))
        out = one if out is None else out.unionByName(one)
    return out
