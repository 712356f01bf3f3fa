"""Cluster quality, weighted drift, outlier actions, n-grams and searches over learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import learners as L
from ..operators import measures as M
from ..operators import transform as T
from ..sources.readers import table
from ..task import Task
from .catalogue import Catalogue
from .drift_queries import _CDF, _halves

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@C.add(
    "cluster_quality",
    """WITH r AS (SELECT c_custkey AS id, c_mktsegment AS c, c_acctbal / 1000 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer), p AS (SELECT c, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM r GROUP BY 1),
s AS (SELECT c, n, mx, my, sum(pow(x - mx, 2) + pow(y - my, 2)) AS w, avg(sqrt(pow(x - mx, 2) + pow(y - my, 2))) AS s FROM r JOIN p USING (c) GROUP BY 1, 2, 3, 4), g AS (SELECT avg(x) AS gx, avg(y) AS gy FROM r),
t AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS k, sum(w) AS w, sum(n * (pow(mx - gx, 2) + pow(my - gy, 2))) AS b FROM s, g),
q AS (SELECT avg(q) AS q FROM (SELECT a.c, max((a.s + b.s) / sqrt(pow(a.mx - b.mx, 2) + pow(a.my - b.my, 2))) AS q FROM s a JOIN s b ON a.c <> b.c GROUP BY 1)),
o AS (SELECT r.id, max(CASE WHEN s.c = r.c THEN s.n / (s.n - 1.0::DOUBLE) * (pow(x - mx, 2) + pow(y - my, 2) + w / n) END) AS a, min(CASE WHEN s.c <> r.c THEN pow(x - mx, 2) + pow(y - my, 2) + w / n END) AS b FROM r, s GROUP BY 1)
SELECT n, k AS clusters, round(w, 3) AS inertia, round((b / (k - 1)) / (w / (n - k)), 5) AS calinski_harabasz, round(q, 5) AS davies_bouldin, (SELECT round(avg((b - a) / greatest(a, b)), 6) FROM o) AS silhouette FROM t, q""",
)
def _(spark, d):
    c = table(spark, d, "customer").selectExpr("c_mktsegment", "c_acctbal / 1000 AS balance", "c_nationkey")
    out = _rounded(M.cluster_quality(c, ["balance", "c_nationkey"], "c_mktsegment"), "silhouette")
    return _rounded(_rounded(out, "inertia", digits=3), "calinski_harabasz", "davies_bouldin", digits=5)


@C.add(
    "anderson_darling",
    f"{_CDF}, a AS (SELECT pow(CASE WHEN r > 0 THEN f ELSE 0 END - CASE WHEN c > 0 THEN g ELSE 0 END, 2) AS e, sum(r + c) OVER (ORDER BY v) - r - c + 1 AS i, CAST(nr AS DOUBLE) AS n, CAST(nc AS DOUBLE) AS m FROM g) "
    "SELECT CAST(max(n) AS BIGINT) AS n_reference, CAST(max(m) AS BIGINT) AS n_current, round(max(n) * max(m) / (max(n) + max(m)) * sum(e / (i * (n + m - i + 1))), 6) AS anderson_darling FROM a",
)
def _(spark, d):
    return _rounded(D.anderson_darling(_halves(spark, d), "value", "ref"), "anderson_darling")


@C.add(
    "outlier_actions",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) AS b FROM orders),
f AS (SELECT o_totalprice AS v, m, o_totalprice < a - 0.5 * (b - a) OR o_totalprice > b + 0.5 * (b - a) AS far FROM orders, q)
SELECT 'flag' AS action, count(*) AS n, count(*) FILTER (WHERE far) AS outliers, round(avg(v), 4) AS mean FROM f
UNION ALL SELECT 'remove', count(*), 0, round(avg(v), 4) FROM f WHERE NOT far
UNION ALL SELECT 'impute', count(*), 0, round(avg(CASE WHEN far THEN m ELSE v END), 4) FROM f""",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    out = None
    for action in ("flag", "remove", "impute"):
        hits = F.sum("is_outlier") if action == "flag" else F.lit(0).cast("long")
        one = T.outliers(o, ["o_totalprice"], action, 0.5).agg(F.lit(action).alias("action"), F.count("*").alias("n"), hits.alias("outliers"), F.avg("o_totalprice").alias("mean"))
        out = one if out is None else out.unionByName(one)
    return _rounded(out, "mean", digits=4)


@C.add(
    "ngram_counts",
    r"""WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' ' || p_type), '\b\w\w+\b') AS w FROM part), f AS (
SELECT p_partkey, unnest(w) AS token FROM t UNION ALL SELECT p_partkey, unnest([array_to_string(w[i:i + 1], ' ') FOR i IN range(1, len(w))]) FROM t), c AS (SELECT p_partkey, token, count(*) AS n FROM f GROUP BY 1, 2),
m AS (SELECT token FROM c GROUP BY 1 ORDER BY sum(n) DESC, token LIMIT 50) SELECT p_partkey, token, n FROM c JOIN m USING (token)""",
)
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return T.ngram_counts(p, "p_partkey", "t", 1, 2, 50)


_TAU = """WITH v AS (SELECT {x} AS x, {y} AS y, count(*) AS n FROM {t} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2), o AS (SELECT sum(n)::DOUBLE AS n FROM v),
s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y) * a.n * b.n) AS s FROM v a JOIN v b ON a.x < b.x),
tx AS (SELECT sum(k * (k - 1) / 2.0::DOUBLE) AS t FROM (SELECT sum(n) AS k FROM v GROUP BY x)), ty AS (SELECT sum(k * (k - 1) / 2.0::DOUBLE) AS t FROM (SELECT sum(n) AS k FROM v GROUP BY y))
SELECT round(s / sqrt((o.n * (o.n - 1) / 2 - tx.t) * (o.n * (o.n - 1) / 2 - ty.t)), 6) AS ktau FROM s, o, tx, ty"""


@C.add("kendall_continuous", _TAU.format(x="c_acctbal", y="c_custkey * 7919 % 1009 + c_acctbal / 20", t="customer"))
def _(spark, d):
    c = table(spark, d, "customer").selectExpr("c_acctbal", "c_custkey * 7919 % 1009 + c_acctbal / 20 AS y")
    return _rounded(M.kendall(c, "c_acctbal", "y", per_cell=200), "ktau")


def _part(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "double(p_size) x", "double(p_partkey % 10) z", "double(p_partkey * 7919 % 101) w", "3 * p_size - p_partkey % 10 + 0D v")
    return Task(p, "p_partkey", {"v": "target"})


@C.add("random_search", "SELECT 3 AS settings, true AS all_scored")
def _(spark, d):
    found = L.random_search("regr.tree", _part(spark, d), {"maxDepth": [1, 2, 3], "maxBins": [8, 64]}, n=3, folds=2, seed=1)
    return found.agg(F.count_distinct("params").cast("int").alias("settings"), (F.count_if(F.col("score") >= 0) == 3).alias("all_scored"))


@C.add("blending", "SELECT count(*) AS n, true AS better FROM part")
def _(spark, d):
    """A linear model over held-out predictions of two others is at least as near as the worse of them."""
    pred = L.blend({"a": ("regr.lm", {}), "b": ("regr.tree", {"maxDepth": 2})}, "regr.lm", _part(spark, d))
    return pred.agg(F.count("*").alias("n"), (F.sqrt(F.avg(F.pow(F.col("truth") - F.col("response"), F.lit(2)))) < 5).alias("better"))


@C.add("feature_elimination", "SELECT 'x' AS feature, 1 AS rank UNION ALL SELECT 'z', 2 UNION ALL SELECT 'w', 3")
def _(spark, d):
    """The target is made of x and, less, of z; w is noise."""
    return L.eliminate("regr.lm", _part(spark, d), 1)
