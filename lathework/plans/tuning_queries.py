"""Parameter spaces, the search over learners, and graphs of steps."""

from __future__ import annotations

from math import log

from pyspark.sql import functions as F

from ..operators import automl as A
from ..operators import learners as L
from ..operators.params import Choice, ParamSet, Real, Whole
from ..sources.readers import table
from ..task import Task
from . import graph as G
from .catalogue import Catalogue
from .pipeline import scaler

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql

_SPACE = ParamSet({"depth": Whole(1, 8), "rate": Real(1e-4, 1.0, log=True), "rule": Choice(["gini", "entropy"]), "smooth": Real(-1.0, 3.0, when={"rule": "gini"}), "bins": Whole(2, 500, log=True)})


def _u(name: str, key: str, seed: int) -> str:
    return f"(('0x' || md5('{seed}:{name}:' || {key})[1:8])::BIGINT / 4294967296::DOUBLE)"


@C.add(
    "param_draws",
    f"""WITH u AS (SELECT p_partkey, {", ".join(f"{_u(n, 'p_partkey', 7)} AS {n}" for n in ("depth", "rate", "rule", "smooth", "bins"))} FROM part)
SELECT p_partkey, (1 + floor(depth * 8))::BIGINT AS depth, round(exp({log(1e-4)!r}::DOUBLE * (1 - rate)), 9) AS rate, CASE WHEN rule < 0.5 THEN 'gini' ELSE 'entropy' END AS rule,
CASE WHEN rule < 0.5 THEN round(-1 + smooth * 4, 9) END AS smooth, floor(exp({log(2)!r}::DOUBLE + bins * {log(501) - log(2)!r}::DOUBLE))::BIGINT AS bins FROM u""",
)
def _(spark, d):
    """A setting for every part, with a logarithmic scale, whole numbers and a condition."""
    out = _SPACE.draw(table(spark, d, "part").select("p_partkey"), "p_partkey", 7)
    return out.withColumns({"rate": F.round("rate", 9), "smooth": F.round("smooth", 9)})


@C.add(
    "automl_board",
    f"""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS b, embedding[4]::DOUBLE AS w, embedding[3]::DOUBLE + 0.5::DOUBLE * embedding[1] + 0.2::DOUBLE * embedding[2] AS y FROM embeddings),
n AS (SELECT *, row_number() OVER (ORDER BY md5('5:' || vec_id), vec_id) - 1 AS pos, count(*) OVER () AS n, {_u("rung", "vec_id", 5)} AS u FROM p),
f AS (SELECT *, CASE WHEN pos < (n % 3) * (n // 3 + 1) THEN pos // (n // 3 + 1) ELSE n % 3 + (pos - (n % 3) * (n // 3 + 1)) // (n // 3) END AS fold FROM n), k AS (SELECT unnest(range(3)) AS k), r AS (SELECT unnest([0.5, 1.0]) AS share),
l AS (SELECT 'line_b' AS trial, fold, u, y, b AS v FROM f UNION ALL SELECT 'line_w', fold, u, y, w FROM f UNION ALL SELECT 'line_x', fold, u, y, x FROM f),
fit AS (SELECT trial, share, k, regr_slope(y, v) AS s, regr_intercept(y, v) AS i FROM l, k, r WHERE fold <> k AND u < share GROUP BY ALL),
e AS (SELECT l.trial, share, fold, sqrt(avg(pow(i + s * v - y, 2))) AS e FROM l JOIN fit ON fit.trial = l.trial AND fit.k = l.fold WHERE u < share GROUP BY ALL),
sc AS (SELECT trial, share, avg(e) AS score FROM e GROUP BY ALL), kept AS (SELECT trial FROM sc WHERE share < 1 ORDER BY score, trial LIMIT 2),
b AS (SELECT trial, share, score FROM sc WHERE (share = 1) = (trial IN (SELECT trial FROM kept)))
SELECT row_number() OVER (ORDER BY share DESC, score, trial)::INT AS rank, trial, (share = 1)::INT AS rung, share::DOUBLE AS rows, round(score, 6) AS score, false AS failed FROM b UNION ALL SELECT 4, 'words', NULL, NULL, NULL, true""",
)
def _(spark, d):
    """Three lines compete, the worst of half the rows goes, and one trial fails."""
    at = lambda i: F.col("embedding")[i].cast("double")
    p = table(spark, d, "embeddings").select("vec_id", at(0).alias("x"), at(1).alias("b"), at(3).alias("w"), F.col("vec_id").cast("string").alias("words"), (at(2) + 0.5 * at(0) + 0.2 * at(1)).alias("y"))
    trials = {f"line_{c}": ("regr.lm", {}, [c]) for c in "xbw"} | {"words": ("regr.lm", {}, ["words"])}
    board = A.search(Task(p, "vec_id", {"y": "target"}), trials, 3600, folds=3, rungs=2, keep=2, seed=5)
    return board.select("rank", "trial", "rung", "rows", F.round("score", 6).alias("score"), F.col("error").isNotNull().alias("failed"))


_CURVE = """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[1]::DOUBLE * embedding[1]::DOUBLE AS z, embedding[3]::DOUBLE + 0.5::DOUBLE * embedding[1] + embedding[1] * embedding[1] AS y FROM embeddings),
n AS (SELECT *, row_number() OVER (ORDER BY md5('5:' || vec_id), vec_id) - 1 AS pos, count(*) OVER () AS n FROM p),
f AS (SELECT *, CASE WHEN pos < (n % 3) * (n // 3 + 1) THEN pos // (n // 3 + 1) ELSE n % 3 + (pos - (n % 3) * (n // 3 + 1)) // (n // 3) END AS fold FROM n), k AS (SELECT unnest(range(3)) AS k)"""


def _curve(spark, d):
    x = F.col("embedding")[0].cast("double")
    p = table(spark, d, "embeddings").select("vec_id", x.alias("x"), (F.col("embedding")[2].cast("double") + 0.5 * x + x * x).alias("y"))
    square = G.mapped(lambda df: df.withColumn("z", F.col("x") * F.col("x")).drop("x"))
    graph = G.Graph({"line": scaler, "square": square, "even": scaler, "both": G.passed}, [("square", "even"), ("line", "both"), ("even", "both")])
    return graph, Task(p, "vec_id", {"y": "target"})


@C.add(
    "graph_features",
    f"{_CURVE}, s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(z) AS mz, stddev_pop(z) AS sz FROM f WHERE fold <> 0) SELECT vec_id, round((x - mx) / sx, 6) AS x, round((z - mz) / sz, 6) AS z FROM f, s",
)
def _(spark, d):
    """Two branches, each scaled by what it learnt from two of three folds, for every row."""
    graph, task = _curve(spark, d)
    known = task.with_df(L.folded(task, 3, 5).filter("_fold <> 0").drop("_fold"))
    out = graph.fit(known).transform(task.df)
    return out.df.select("vec_id", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))


@C.add(
    "graph_cv",
    f"""{_CURVE}, s AS (SELECT k, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM f, k WHERE fold <> k GROUP BY k),
b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM s)
SELECT vec_id, fold::INT AS fold, round(y, 6) AS truth, round(my + bx * (x - mx) + bz * (z - mz), 5) AS response FROM f JOIN b ON k = fold""",
)
def _(spark, d):
    """The graph with a linear model after it, cross-validated as a whole."""
    graph, task = _curve(spark, d)
    out = G.resample(graph, "regr.lm", task, 3, 5)
    return out.select("vec_id", "fold", F.round("truth", 6).alias("truth"), F.round("response", 5).alias("response"))
