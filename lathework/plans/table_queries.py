"""Binding, selecting and sampling rows, preprocessing, windows by time, and scores by fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import measures as M
from ..operators import profile as P
from ..operators import resample as R
from ..operators import scores as S
from ..operators import transform as T
from ..sources.readers import table
from ..task import Task
from .catalogue import Catalogue

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@C.add("task_filter", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    chosen = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    task = Task(o, "o_orderkey", {"o_totalprice": "target"})
    return task.filter(o.join(chosen, "o_custkey", "left_semi").select("o_orderkey")).data()


@C.add("task_head", "SELECT * FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 7) UNION ALL SELECT * FROM (SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 5)")
def _(spark, d):
    task = Task(table(spark, d, "customer"), "c_custkey")
    return task.head(7).unionByName(task.tail(5))


@C.add("cbind", "SELECT c_custkey, c_name, c_acctbal, n_orders FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def _(spark, d):
    c = Task(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")
    return c.cbind(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))).df


@C.add("rbind", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, 'c' AS side FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal, 's' FROM supplier")
def _(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey id", "c_name name", "c_acctbal balance", "'c' side")
    return Task(c, "id").rbind(table(spark, d, "supplier").selectExpr("s_suppkey + 1000000 id", "s_name name", "s_acctbal balance", "'s' side")).df


@C.add("outer_rbind", "SELECT c_custkey AS id, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def _(spark, d):
    a = table(spark, d, "customer").selectExpr("c_custkey id", "c_mktsegment segment")
    return a.unionByName(table(spark, d, "supplier").selectExpr("s_suppkey id", "s_acctbal balance"), allowMissingColumns=True)


@C.add("hash_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('9:' || o_orderkey), o_orderkey LIMIT 500")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(R.place("o_orderkey", 9), "o_orderkey").limit(500)  # a sampling operator


@C.add("row_predicate", "SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem WHERE l_quantity > 45 AND (l_discount >= 0.09 OR l_returnflag = 'R')")
def _(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity > 45 and (l_discount >= 0.09 or l_returnflag = 'R')").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")


@C.add("concat_feature", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_brand END, 'nan') || '_' || p_type AS brand_type FROM part")
def _(spark, d):
    brand = F.coalesce(F.expr("case when p_partkey % 4 <> 0 then p_brand end"), F.lit("nan"))
    return table(spark, d, "part").select("p_partkey", F.concat_ws("_", brand, "p_type").alias("brand_type"))


@C.add("json_metadata", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) < 30")
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k")).filter("k < 30")


@C.add(
    "preprocess",
    """WITH h AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS b, CASE WHEN c_custkey % 8 <> 0 THEN c_mktsegment END AS s FROM customer), f AS (SELECT c_custkey, coalesce(b, (SELECT quantile_cont(b, 0.5) FROM h)) AS b, coalesce(s, 'missing') AS s FROM h), m AS (SELECT avg(b) AS m, stddev_pop(b) AS d FROM f)
SELECT c_custkey, round((b - m) / d, 6) AS b, """ + ", ".join(f"CASE WHEN s = '{v}' THEN 1 ELSE 0 END AS \"s_{v}\"" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "missing")) + " FROM f, m",
)
def _(spark, d):
    h = table(spark, d, "customer").selectExpr("c_custkey", "case when c_custkey % 9 <> 0 then c_acctbal end b", "case when c_custkey % 8 <> 0 then c_mktsegment end s")
    filled = T.impute(h, {"b": "median", "s": ("constant", "missing")})
    return _rounded(T.scale(T.one_hot(filled, "s", T.categories(filled, "s")), ["b"]), "b")


@C.add("cluster_preprocess", "WITH h AS (SELECT s_suppkey, CASE WHEN s_suppkey % 6 <> 0 THEN s_acctbal END AS b, CAST(s_nationkey AS DOUBLE) AS n FROM supplier), k AS (SELECT * FROM h WHERE b IS NOT NULL), m AS (SELECT avg(b) AS mb, stddev_samp(b) AS sb, avg(n) AS mn, stddev_samp(n) AS sn FROM k) SELECT s_suppkey, round((b - mb) / sb, 6) AS b, round((n - mn) / sn, 6) AS n FROM k, m")
def _(spark, d):
    h = table(spark, d, "supplier").selectExpr("s_suppkey", "case when s_suppkey % 6 <> 0 then s_acctbal end b", "double(s_nationkey) n")
    return _rounded(T.scale(h.dropna(), ["b", "n"], sample=True), "b", "n")


@C.add("add_strata", "WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, CASE WHEN p_retailprice <= lo + (hi - lo) * (1 / 3.0::DOUBLE) THEN 0 WHEN p_retailprice <= lo + (hi - lo) * (2 / 3.0::DOUBLE) THEN 1 ELSE 2 END AS stratum FROM part, e")
def _(spark, d):
    return T.cut(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 3, out="stratum").drop("p_retailprice")


@C.add("wide_scores", "SELECT event_type AS task, " + ", ".join(f"round(avg(value) FILTER (WHERE user_id % 3 = {k}), 6) AS u{k}" for k in range(3)) + " FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").withColumn("learner", F.concat(F.lit("u"), F.col("user_id") % 3))
    return _rounded(e.groupBy(F.col("event_type").alias("task")).pivot("learner", ["u0", "u1", "u2"]).agg(F.avg("value")), "u0", "u1", "u2")


_G = "pow(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), {p})"


@C.add(
    "meta_features",
    "SELECT count(*) AS n_rows, 4 AS n_features, round((" + " + ".join(f"abs(avg({_G.format(c=c, p=3)}))" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ") / 4, 6) AS mean_abs_skew, round((" + " + ".join(f"abs(avg({_G.format(c=c, p=4)}) - 3)" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ") / 4, 6) AS mean_abs_kurtosis FROM lineitem",
)
def _(spark, d):
    c = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    mean = lambda f: sum((F.abs(f(x)) for x in c), F.lit(0.0)) / len(c)
    out = table(spark, d, "lineitem").agg(F.count("*").alias("n_rows"), F.lit(len(c)).alias("n_features"), mean(F.skewness).alias("mean_abs_skew"), mean(F.kurtosis).alias("mean_abs_kurtosis"))
    return _rounded(out, "mean_abs_skew", "mean_abs_kurtosis")


@C.add(
    "feature_stability",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(CASE WHEN r <= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS frequency FROM (SELECT i, f, row_number() OVER (PARTITION BY i ORDER BY s DESC, f) AS r FROM (SELECT i, f, abs(corr(x, l_extendedprice)) AS s FROM (SELECT i, f, l_extendedprice, CASE f WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount ELSE l_tax END AS x FROM lineitem, range(4) t(i), (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) u(f) WHERE substr(md5(i || ':' || l_orderkey), 1, 1) < '8') GROUP BY i, f)) WHERE f = '{c}'"
        for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def _(spark, d):
    names = ["l_quantity", "l_discount", "l_tax"]
    rows = table(spark, d, "lineitem").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    half = rows.filter(F.substring(F.md5(F.concat_ws(":", F.col("i").cast("string"), F.col("l_orderkey").cast("string")).cast("binary")), 1, 1) < "8")
    score = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.corr(c, "l_extendedprice")).alias("score")) for c in names])
    per = half.groupBy("i").agg(score.alias("s")).select("i", F.explode("s").alias("s")).select(F.col("i").alias("filter"), "s.feature", "s.score")
    chosen = S.ranked(per).withColumn("hit", (F.col("rank") <= 2).cast("double"))
    return _rounded(chosen.groupBy("feature").agg(F.avg("hit").alias("frequency")), "frequency")


_P = "SELECT o_orderkey, o_orderstatus AS y, round(0.2 + 0.5::DOUBLE * (o_orderkey % 7) / 7, 6) AS f, round(0.1 + 0.4::DOUBLE * (o_custkey % 5) / 5, 6) AS o FROM orders"


@C.add(
    "class_auc",
    " UNION ALL ".join(
        f"SELECT '{k}' AS label, count(*) FILTER (WHERE y = '{k}') AS n, round((sum(r) FILTER (WHERE y = '{k}') - count(*) FILTER (WHERE y = '{k}') * (count(*) FILTER (WHERE y = '{k}') + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE y = '{k}') * count(*) FILTER (WHERE y <> '{k}')), 6) AS auc FROM (SELECT y, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r FROM ({_P}))"
        for k, c in (("F", "f"), ("O", "o"))
    ),
)
def _(spark, d):
    p = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderstatus y", "round(0.2 + 0.5D * (o_orderkey % 7) / 7, 6) f", "round(0.1 + 0.4D * (o_custkey % 5) / 5, 6) o")
    return _rounded(M.class_auc(p, "y", {"F": "f", "O": "o"}), "auc")


@C.add("tumbling_counts", "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    e = table(spark, d, "events")
    out = e.groupBy(F.window("ts", "6 hours")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return _rounded(out, "total", digits=4)


@C.add(
    "session_counts",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def _(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@C.add(
    "resample_featureless",
    """WITH r AS (SELECT o_totalprice AS y, row_number() OVER (ORDER BY md5('11:' || o_orderkey), o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders), f AS (SELECT y, CASE WHEN pos < (n % 4) * (n // 4 + 1) THEN pos // (n // 4 + 1) ELSE n % 4 + (pos - (n % 4) * (n // 4 + 1)) // (n // 4) END AS fold FROM r),
m AS (SELECT k AS fold, avg(y) AS p FROM f, range(4) t(k) WHERE fold <> k GROUP BY k) SELECT CAST(f.fold AS INTEGER) AS fold, count(*) AS n, round(avg(abs(p - y)), 3) AS mae, round(sqrt(avg(pow(p - y, 2))), 3) AS rmse FROM f JOIN m ON f.fold = m.fold GROUP BY f.fold""",
)
def _(spark, d):
    """All folds in one job: a fold's training mean is the total less its own."""
    rows = R.cv(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("y")), "o_orderkey", 4, 11)
    own = rows.groupBy("fold").agg(F.sum("y").alias("s"), F.count("y").alias("k"))
    total = own.agg(F.sum("s").alias("ts"), F.sum("k").alias("tk"))
    mean = own.crossJoin(F.broadcast(total)).select("fold", ((F.col("ts") - F.col("s")) / (F.col("tk") - F.col("k"))).alias("p"))  # one row
    scored = M.regression(rows.join(F.broadcast(mean), "fold"), "y", "p", ["fold"])  # a row a fold
    return _rounded(scored.select("fold", "n", "mae", "rmse"), "mae", "rmse", digits=3)


@C.add("col_profile_all", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values FROM lineitem" for c in ("l_orderkey", "l_returnflag", "l_shipdate", "l_tax")))
def _(spark, d):
    return P.col_info(table(spark, d, "lineitem"), ["l_orderkey", "l_returnflag", "l_shipdate", "l_tax"])
