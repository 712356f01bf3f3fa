"""Feature scores, rankings, the feature store, retrieval and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feature_store as FS
from ..operators import models as M
from ..operators import profile as P
from ..operators import scores as S
from ..sources.readers import table
from .catalogue import Catalogue

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _each(sql, names=LINE):
    return " UNION ALL ".join(sql.format(c=c) for c in names)


@C.add("variance", _each("SELECT '{c}' AS feature, round(var_samp({c}), 3) AS score FROM lineitem"))
def _(spark, d):
    return _rounded(S.variance(table(spark, d, "lineitem"), LINE), "score", digits=3)


@C.add("pearson", _each("SELECT '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 6) AS score FROM lineitem", ["l_quantity", "l_discount", "l_tax"]))
def _(spark, d):
    return _rounded(S.pearson(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), "score")


@C.add("f_regression", _each("SELECT '{c}' AS feature, round(pow(corr({c}, l_extendedprice), 2) * (count(*) - 2) / (1 - pow(corr({c}, l_extendedprice), 2)), 3) AS score FROM lineitem", ["l_quantity", "l_discount", "l_tax"]))
def _(spark, d):
    return _rounded(S.f_regression(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), "score", digits=3)


@C.add("anova_f", _each("(WITH x AS (SELECT l_returnflag AS y, {c} - (SELECT avg({c}) FROM lineitem) AS v FROM lineitem), g AS (SELECT y, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM x GROUP BY y) SELECT '{c}' AS feature, round(((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))), 6) AS score FROM g)"))
def _(spark, d):
    return _rounded(S.anova(table(spark, d, "lineitem"), LINE, "l_returnflag"), "score")


@C.add("chi2_scores", _each("(WITH g AS (SELECT l_returnflag AS y, sum(greatest({c}, 0)) AS o, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT *, sum(o) OVER () * n / sum(n) OVER () AS e FROM g) SELECT '{c}' AS feature, round(sum(pow(o - e, 2) / e), 4) AS score FROM t)"))
def _(spark, d):
    return _rounded(S.chi_squared(table(spark, d, "lineitem"), LINE, "l_returnflag"), "score", digits=4)


_INFO = """(WITH e AS (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem), k AS (SELECT len([i FOR i IN [0.1::DOUBLE,0.2::DOUBLE,0.3::DOUBLE,0.4::DOUBLE,0.5::DOUBLE,0.6::DOUBLE,0.7::DOUBLE,0.8::DOUBLE,0.9::DOUBLE] IF lo + (hi - lo) * i <= {c}]) AS b, l_returnflag AS y, count(*) AS k FROM lineitem, e GROUP BY 1, 2), n AS (SELECT sum(k)::DOUBLE AS n FROM k),
h AS (SELECT (SELECT -sum(x / n * log2(x / n)) FROM (SELECT sum(k) AS x FROM k GROUP BY b), n) AS hx, (SELECT -sum(x / n * log2(x / n)) FROM (SELECT sum(k) AS x FROM k GROUP BY y), n) AS hy, (SELECT -sum(k / n * log2(k / n)) FROM k, n) AS hxy)
SELECT '{c}' AS feature, round(greatest(0, hx + hy - hxy), 8) AS info_gain, round(greatest(0, hx + hy - hxy) / greatest(hx, 0.01), 8) AS gain_ratio, round(2 * greatest(0, hx + hy - hxy) / (hx + hy), 8) AS sym_uncertainty FROM h)"""


@C.add("info_gain", _each(_INFO))
def _(spark, d):
    return _rounded(S.information(S.binned(table(spark, d, "lineitem"), LINE, "l_returnflag")), "info_gain", "gain_ratio", "sym_uncertainty", digits=8)


@C.add("corr_prune", "SELECT f AS feature FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS f) WHERE f <> 'l_quantity' OR (SELECT abs(corr(l_quantity, l_extendedprice)) FROM lineitem) <= 0.3")
def _(spark, d):
    df = table(spark, d, "lineitem")
    left = S.prune_correlated(P.correlations(df, LINE), S.variance(df, LINE), LINE, 0.3)
    return spark.createDataFrame([(f,) for f in left], "feature string")


_SCORES = """s AS (SELECT event_type AS task, 'u' || (user_id % 4) AS learner, round(avg(value), 1) AS score FROM events GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY score DESC) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0::DOUBLE AS rank FROM s)"""


def _scores(spark, d):
    e = table(spark, d, "events").withColumn("learner", F.concat(F.lit("u"), F.col("user_id") % 4))
    return e.groupBy(F.col("event_type").alias("task"), "learner").agg(F.round(F.avg("value"), 1).alias("score"))


@C.add("rank_learners", f"WITH {_SCORES}, m AS (SELECT learner, round(avg(rank), 3) AS mean_rank FROM r GROUP BY 1) SELECT learner, mean_rank, CAST(row_number() OVER (ORDER BY mean_rank, learner) AS INTEGER) AS final_rank FROM m")
def _(spark, d):
    return S.rank_learners(_scores(spark, d))


@C.add("friedman", f"WITH {_SCORES}, t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*) AS c FROM r GROUP BY task, score)), q AS (SELECT sum(s * s) AS s2, count(*) AS k FROM (SELECT sum(rank) AS s FROM r GROUP BY learner)), n AS (SELECT count(DISTINCT task) AS n FROM r) SELECT n, k, round((12.0::DOUBLE / (n * k * (k + 1)) * s2 - 3 * n * (k + 1)) / (1 - t / CAST(n * k * (k * k - 1) AS DOUBLE)), 6) AS statistic FROM t, q, n")
def _(spark, d):
    return _rounded(S.friedman(_scores(spark, d)), "statistic")


@C.add(
    "ensemble_rank",
    """WITH s AS (SELECT p_brand AS feature, 'a' AS filter, avg(p_retailprice) AS score FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'b', CAST(count(*) AS DOUBLE) FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'c', CAST(max(p_size) AS DOUBLE) FROM part GROUP BY 1),
r AS (SELECT *, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0.5) AS norm, rank() OVER (PARTITION BY filter ORDER BY score DESC) + (count(*) OVER (PARTITION BY filter, score) - 1) / 2.0::DOUBLE AS rank FROM s WINDOW w AS (PARTITION BY filter))
SELECT feature, round(avg(norm), 6) AS mean, round(quantile_cont(norm, 0.5), 6) AS median, round(avg(rank), 6) AS mean_rank, round(sum((SELECT count(DISTINCT feature) FROM s) - rank), 6) AS borda, round(sum(norm * CASE filter WHEN 'a' THEN 3.0::DOUBLE ELSE 1 END) / sum(CASE filter WHEN 'a' THEN 3.0::DOUBLE ELSE 1 END), 6) AS weighted FROM r GROUP BY feature""",
)
def _(spark, d):
    by = table(spark, d, "part").groupBy(F.col("p_brand").alias("feature"))
    kinds = {"a": F.avg("p_retailprice"), "b": F.count("*").cast("double"), "c": F.max("p_size").cast("double")}
    s = None
    for name, x in kinds.items():
        one = by.agg(x.alias("score")).withColumn("filter", F.lit(name))
        s = one if s is None else s.unionByName(one)
    return _rounded(S.ensemble(s, {"a": 3.0, "b": 1.0, "c": 1.0}), "mean", "median", "mean_rank", "borda", "weighted")


@C.add("score_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std_samp, round(stddev_pop(value), 6) AS std_pop, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1")
def _(spark, d):
    return _rounded(S.aggregate_scores(table(spark, d, "events").withColumnRenamed("value", "score"), ["event_type"]), "mean", "std_samp", "std_pop", "median")


# feature store: snapshots of customers' orders at the end of two years


def _snapshots(spark, d):
    o = table(spark, d, "orders")
    year = F.when(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"), F.lit("1997-01-01")).otherwise(F.lit("1999-01-01")).cast("timestamp")
    return o.withColumn("_timestamp", year)


_SNAP = "SELECT *, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN TIMESTAMP '1997-01-01' ELSE TIMESTAMP '1999-01-01' END AS ts FROM orders"


@C.add(
    "latest_features",
    f"WITH s AS ({_SNAP}), a AS (SELECT o_custkey, count(*) AS n_orders FROM s WHERE ts = TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT c_custkey AS o_custkey, c_acctbal FROM customer WHERE c_custkey % 3 = 0) SELECT o_custkey, n_orders, c_acctbal FROM a FULL JOIN b USING (o_custkey) WHERE o_custkey % 2 = 0",
)
def _(spark, d):
    a = _snapshots(spark, d).groupBy("o_custkey", "_timestamp").agg(F.count("*").alias("n_orders"))
    b = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", F.lit("1996-06-01").cast("timestamp").alias("_timestamp"))
    ids = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return FS.get_features({"orders": (a, ["n_orders"]), "accounts": (b, ["c_acctbal"])}, "o_custkey", ids, "1998-01-01")


@C.add(
    "latest_features_whole",
    f"WITH s AS ({_SNAP}), a AS (SELECT o_custkey, count(*) AS n_orders FROM s WHERE ts = TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT c_custkey AS o_custkey, c_acctbal FROM customer) SELECT o_custkey, n_orders, c_acctbal FROM a FULL JOIN b USING (o_custkey)",
)
def _(spark, d):
    a = _snapshots(spark, d).groupBy("o_custkey", "_timestamp").agg(F.count("*").alias("n_orders"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", F.lit("1996-06-01").cast("timestamp").alias("_timestamp"))
    return FS.get_features({"orders": (a, ["n_orders"]), "accounts": (b, ["c_acctbal"])}, "o_custkey", None, "1998-01-01")


@C.add("historical_features", f"WITH s AS ({_SNAP}) SELECT o_custkey, count(*) AS n_orders, CAST(NULL AS DOUBLE) AS c_acctbal FROM s WHERE ts = TIMESTAMP '1999-01-01' GROUP BY 1 UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer")
def _(spark, d):
    a = _snapshots(spark, d).groupBy("o_custkey", "_timestamp").agg(F.count("*").alias("n_orders"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", F.lit("1998-06-01").cast("timestamp").alias("_timestamp"))
    return FS.history([a, b], "1998-01-01", "2000-01-01").drop("_timestamp")


@C.add("materialized_view", "WITH a AS (SELECT o_custkey, max(o_totalprice) AS top, 1 AS flag FROM orders GROUP BY 1), b AS (SELECT c_custkey AS o_custkey, c_acctbal, 2 AS flag FROM customer) SELECT o_custkey, top, flag, c_acctbal FROM (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.top, a.flag, b.c_acctbal FROM a FULL JOIN b ON a.o_custkey = b.o_custkey)")
def _(spark, d):
    a = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"), F.lit(1).alias("flag"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", F.lit(2).alias("flag"))
    return FS.view([a, b], "o_custkey")


@C.add("point_in_time_join", "SELECT e.event_id, e.user_id, e.ts, o.value AS value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') o ON e.user_id = o.user_id AND e.ts >= o.ts")
def _(spark, d):
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), "value")
    return FS.as_of(left, right, "user_id", "ts", ["value"], "seen")


# retrieval and models


@C.add(
    "vector_topk_cosine",
    """WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum([x * x FOR x IN v])) AS l FROM v), q AS (SELECT * FROM n WHERE vec_id % 50 = 0)
SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, n.vec_id, list_sum([n.v[i] * q.v[i] FOR i IN range(1, 65)]) / (n.l * q.l) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum([n.v[i] * q.v[i] FOR i IN range(1, 65)]) / (n.l * q.l) DESC, n.vec_id) AS r FROM n, q WHERE n.vec_id <> q.vec_id) WHERE r <= 5""",
)
def _(spark, d):
    from ..operators.retrieval import top_k

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return _rounded(top_k(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5, "cosine"), "score")


@C.add("featureless", "SELECT event_type AS label, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS prior, row_number() OVER (ORDER BY count(*) DESC, event_type) = 1 AS is_mode FROM events GROUP BY 1")
def _(spark, d):
    return _rounded(M.featureless_classif(table(spark, d, "events"), "event_type"), "prior")


@C.add("featureless_regr", "SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value) / sqrt(count(value)), 6) AS se FROM events")
def _(spark, d):
    return _rounded(M.featureless_regr(table(spark, d, "events"), "value"), "mean", "median", "se")


_NBX = ["l_quantity", "l_discount", "l_tax"]


@C.add(
    "gaussian_nb",
    f"""WITH x AS (SELECT p_partkey, p_type AS y, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part), tr AS (SELECT * FROM x WHERE p_partkey % 4 <> 0), te AS (SELECT * FROM x WHERE p_partkey % 4 = 0),
s AS (SELECT y, 'a' AS f, avg(a) AS m, var_pop(a) AS v, count(*) AS n FROM tr GROUP BY y UNION ALL SELECT y, 'b', avg(b), var_pop(b), count(*) FROM tr GROUP BY y),
mo AS (SELECT y, f, m, v + 1e-9 * (SELECT max(v) FROM s) AS v, ln(n / CAST((SELECT count(*) FROM tr) AS DOUBLE)) AS prior FROM s),
u AS (SELECT p_partkey, 'a' AS f, a AS x FROM te UNION ALL SELECT p_partkey, 'b', b FROM te),
l AS (SELECT p_partkey, y, sum(-0.5 * (ln(2 * pi() * v) + pow(x - m, 2) / v)) + max(prior) AS ll FROM u JOIN mo USING (f) GROUP BY 1, 2)
SELECT p_partkey, y AS response, round(ll, 4) AS log_lik FROM l QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY ll DESC, y) = 1""",
)
def _(spark, d):
    x = table(spark, d, "part").selectExpr("p_partkey", "p_type y", "double(p_size) a", "p_retailprice b")
    out = M.gaussian_nb(x.filter("p_partkey % 4 <> 0"), x.filter("p_partkey % 4 = 0"), "p_partkey", ["a", "b"], "y")
    return _rounded(out, "log_lik", digits=4)


@C.add("linear_normal", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def _(spark, d):
    out = M.simple_linear(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return _rounded(_rounded(_rounded(out, "slope", digits=4), "intercept", digits=3), "r2")


@C.add(
    "knn_vote",
    """WITH te AS (SELECT s_suppkey, s_nationkey AS x, s_acctbal / 1000 AS y FROM supplier WHERE s_suppkey % 10 = 0), tr AS (SELECT s_suppkey, s_nationkey AS x, s_acctbal / 1000 AS y, s_suppkey % 3 AS lab FROM supplier WHERE s_suppkey % 10 <> 0),
n AS (SELECT te.s_suppkey AS q, lab FROM tr, te QUALIFY row_number() OVER (PARTITION BY te.s_suppkey ORDER BY sqrt(pow(tr.x - te.x, 2) + pow(tr.y - te.y, 2)), tr.s_suppkey) <= 5)
SELECT q AS s_suppkey, lab AS response FROM (SELECT q, lab, count(*) AS c FROM n GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, lab) = 1""",
)
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", "double(s_nationkey) x", "s_acctbal / 1000 y", "s_suppkey % 3 lab")
    return M.knn(s.filter("s_suppkey % 10 <> 0"), s.filter("s_suppkey % 10 = 0"), "s_suppkey", ["x", "y"], "lab")


@C.add("voting", "WITH p AS (SELECT o_orderkey, CASE WHEN o_totalprice < 200000 THEN 'F' ELSE 'O' END AS response, 1.0::DOUBLE AS w FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'P' END, 1.5::DOUBLE FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_orderpriority < '3' THEN 'O' ELSE 'P' END, 1.0::DOUBLE FROM orders) SELECT o_orderkey, response FROM (SELECT o_orderkey, response, sum(w) AS w FROM p GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY w DESC, response) = 1")
def _(spark, d):
    o = table(spark, d, "orders")
    p = lambda c, a, b: o.select("o_orderkey", F.when(c, a).otherwise(b).alias("response"))
    parts = [p(F.col("o_totalprice") < 200000, "F", "O"), p(F.col("o_custkey") % 2 == 0, "F", "P"), p(F.col("o_orderpriority") < "3", "O", "P")]
    return M.vote(parts, "o_orderkey", [1.0, 1.5, 1.0])
