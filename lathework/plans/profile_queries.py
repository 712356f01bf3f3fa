"""Profiles and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..sources.readers import table
from .catalogue import Catalogue

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _each(columns, row, source):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {row.format(c=c)} FROM {source}" for c in columns)


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@C.add("col_profile", _each(ORDERS, "count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values", "orders"))
def _(spark, d):
    return P.col_info(table(spark, d, "orders"))


@C.add("distinct_per_column", " UNION ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM part WHERE {c} IS NOT NULL" for c in ("p_brand", "p_type", "p_size")))
def _(spark, d):
    return P.distinct_per_column(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


@C.add("distinct_tuples", "SELECT DISTINCT p_brand, p_type FROM part")
def _(spark, d):
    return P.distinct_tuples(table(spark, d, "part"), ["p_brand", "p_type"])


_HOLES = "(SELECT CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id, event_type FROM events)"


@C.add("missing_counts", _each(["value", "user_id", "event_type"], "count(*) - count({c}) AS missing", _HOLES))
def _(spark, d):
    e = table(spark, d, "events")
    return P.missing_counts(e.selectExpr("case when event_id % 7 <> 0 then value end value", "case when event_id % 11 <> 0 then user_id end user_id", "event_type"))


_STATS = "round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values"


@C.add("feature_statistics", _each(["p_size", "p_retailprice"], _STATS, "part"))
def _(spark, d):
    return _rounded(P.numeric_stats(table(spark, d, "part"), ["p_size", "p_retailprice"]), "mean", "std", "median")


@C.add("value_counts", "SELECT c_mktsegment AS value, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM customer GROUP BY 1")
def _(spark, d):
    return _rounded(P.value_counts(table(spark, d, "customer"), "c_mktsegment"), "share")


@C.add("binary_ratio", "SELECT count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END), 6) AS true_ratio, round(avg(CASE WHEN o_orderstatus <> 'F' THEN 1.0::DOUBLE ELSE 0 END), 6) AS false_ratio FROM orders")
def _(spark, d):
    return _rounded(P.true_ratio(table(spark, d, "orders"), F.col("o_orderstatus") == "F"), "true_ratio", "false_ratio")


@C.add("duplicate_ratio", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, round((sum(n) - count(*)) / CAST(sum(n) AS DOUBLE), 6) AS duplicate_ratio FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def _(spark, d):
    return _rounded(P.duplicate_ratio(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "duplicate_ratio")


@C.add("iqr_outliers", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem) SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, count(*) FILTER (WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS outliers, count(l_extendedprice) AS n FROM lineitem, q GROUP BY q1, q3")
def _(spark, d):
    return _rounded(P.iqr_outliers(table(spark, d, "lineitem"), "l_extendedprice"), "q1", "q3")


_Z = "SELECT '{c}' AS \"column\", count({c}) AS n, count(*) FILTER (WHERE abs({c} - m) > 2.0 * s) AS outliers, round(count(*) FILTER (WHERE abs({c} - m) > 2.0 * s) / CAST(count({c}) AS DOUBLE), 6) AS outlier_rate FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem)"


@C.add("zscore_outliers", " UNION ALL ".join(_Z.format(c=c) for c in ("l_extendedprice", "l_quantity")))
def _(spark, d):
    return _rounded(P.zscore_outliers(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"], 2.0), "outlier_rate")


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@C.add("correlations", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]))
def _(spark, d):
    return _rounded(P.correlations(table(spark, d, "lineitem"), _NUM), "corr")


@C.add("task_type", _each(["p_brand", "p_size", "p_retailprice"], "count(DISTINCT {c}) AS distinct_values, CASE WHEN count(DISTINCT {c}) <= 20 THEN 'classif' ELSE 'regr' END AS task_type", "part"))
def _(spark, d):
    return P.task_type(table(spark, d, "part"), ["p_brand", "p_size", "p_retailprice"])


_V = "round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS missing_ratio, CASE WHEN count({c}) < 0.5 * count(*) THEN 'severe' WHEN count({c}) < 0.8 * count(*) THEN 'high' WHEN count({c}) < count(*) THEN 'some' ELSE 'none' END AS missing_band, count(DISTINCT {c}) <= 1 AS constant, count(DISTINCT {c}) > count(*) / 10.0::DOUBLE AS high_cardinality"


@C.add("validate_report", _each(["c_name", "c_acctbal", "c_mktsegment", "hole"], _V, "(SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 1 END AS hole FROM customer)"))
def _(spark, d):
    c = table(spark, d, "customer").withColumn("hole", F.expr("case when c_custkey % 3 = 0 then 1 end"))
    return _rounded(P.validate(c, ["c_name", "c_acctbal", "c_mktsegment", "hole"]), "missing_ratio")


@C.add("class_imbalance", "WITH c AS (SELECT count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM events GROUP BY event_type) SELECT max(n) AS most, min(n) AS least, round(max(n) / CAST(min(n) AS DOUBLE), 6) AS imbalance, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy FROM c")
def _(spark, d):
    return _rounded(P.class_imbalance(table(spark, d, "events"), "event_type"), "imbalance", "entropy")
