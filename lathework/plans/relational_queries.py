"""Round trips through files, joins, groupings, set operations, functions and learners."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import learners as L
from ..operators import resample as R
from ..session import shared_dir
from ..sources import readers
from ..sources.readers import table
from ..task import Task
from .catalogue import Catalogue

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _path(spark, suffix):
    return f"{shared_dir(spark)}/lathework-{uuid.uuid4().hex}.{suffix}"


# files: written, then read by the suffix


def _round_trip(name, suffix, **write):
    @C.add(name, "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
    def _(spark, d):
        path = _path(spark, suffix)
        readers.write(table(spark, d, "supplier"), path, **write)
        out = readers.read(spark, path)
        return out.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"), "s_acctbal")


_round_trip("read_csv", "csv", header=True)
_round_trip("read_parquet", "parquet")
_round_trip("read_orc", "orc")


@C.add("read_json", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, d):
    path = _path(spark, "json")
    readers.write(table(spark, d, "supplier"), path)
    return readers.read(spark, path, multiLine=False).select("s_suppkey", "s_name", "s_acctbal")


@C.add("read_many", "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def _(spark, d):
    """Several files at once; a column that one lacks is null there."""
    a, b = _path(spark, "parquet"), _path(spark, "parquet")
    readers.write(table(spark, d, "customer").selectExpr("c_custkey id", "c_acctbal balance", "c_mktsegment segment"), a)
    readers.write(table(spark, d, "supplier").selectExpr("s_suppkey id", "s_acctbal balance"), b)
    return readers.read(spark, a, b).select("id", "balance", "segment")


@C.add("feature_snapshots", "SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer")
def _(spark, d):
    """Two snapshots of a group are appended; the last one is read back."""
    from ..operators.feature_store import latest

    path, c = _path(spark, "features"), table(spark, d, "customer").select("c_custkey", "c_acctbal")
    readers.write_features(c, path, "2024-01-01")
    readers.write_features(c.withColumn("c_acctbal", F.col("c_acctbal") + 1), path, "2024-02-01")
    return latest(spark.read.parquet(path)).select("c_custkey", "c_acctbal")


@C.add("nan_to_null", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "if(o_orderkey % 3 = 0, double('NaN'), o_totalprice) as price")
    return readers.nan_to_null(o)


@C.add("row_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS _row_id FROM orders")
def _(spark, d):
    return readers.with_row_id(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "_row_id")


# joins


@C.add("range_join", "WITH b(lo, hi, band) AS (VALUES (0, 100000, 'low'), (100000, 250000, 'mid'), (250000, 1000000, 'high')) SELECT o_orderkey, band FROM orders JOIN b ON o_totalprice >= lo AND o_totalprice < hi")
def _(spark, d):
    bands = spark.createDataFrame([(0, 100000, "low"), (100000, 250000, "mid"), (250000, 1000000, "high")], "lo long, hi long, band string")
    return X.range_join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "lo", "hi", 50_000).select("o_orderkey", "band")


@C.add("interval_join", "SELECT a.event_id AS purchase, count(b.event_id) AS views FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'view' AND b.ts >= a.ts - INTERVAL 6 HOURS AND b.ts < a.ts WHERE a.event_type = 'purchase' GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    a = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", "ts")
    b = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), "event_id")
    return X.count_within(a, b, "purchase", "user_id", "ts", "seen", 6 * 3600, "views")


@C.add("anti_and_semi", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer")
def _(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    yes = c.join(o, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True))
    return yes.unionByName(c.join(o, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


@C.add("right_join", "SELECT n_name, count(c_custkey) AS n FROM (SELECT * FROM customer WHERE c_acctbal > 9000) RIGHT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 9000")
    return c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "right").groupBy("n_name").agg(F.count("c_custkey").alias("n"))


# groupings and sets

_AGG = "count(*) AS n, round(sum(l_quantity), 2) AS quantity"


def _lines(df):
    return _rounded(df.agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")), "quantity", digits=2)


@C.add("rollup", f"SELECT l_returnflag, l_linestatus, {_AGG} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, d):
    return _lines(table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus"))


@C.add("cube", f"SELECT l_returnflag, l_linestatus, {_AGG} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(spark, d):
    return _lines(table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus"))


@C.add("grouping_sets", f"SELECT l_returnflag, l_linestatus, {_AGG} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def _(spark, d):
    return _lines(table(spark, d, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus"))


@C.add("intersect_except", "SELECT 'both' AS side, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' INTERSECT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01') UNION ALL SELECT 'early', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')")
def _(spark, d):
    o = table(spark, d, "orders")
    early = o.filter("o_orderdate < timestamp '1995-01-01'").select(F.col("o_custkey").alias("k"))
    late = o.filter("o_orderdate >= timestamp '1997-01-01'").select(F.col("o_custkey").alias("k"))
    return early.intersect(late).select(F.lit("both").alias("side"), "k").unionByName(early.subtract(late).select(F.lit("early").alias("side"), "k"))


@C.add("approx_distinct", "SELECT l_returnflag, true AS within FROM lineitem GROUP BY 1")
def _(spark, d):
    """A HyperLogLog sketch is within 5 % of the exact count."""
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("about"), F.count_distinct("l_partkey").alias("n"))
    return g.select("l_returnflag", (F.abs(F.col("about") - F.col("n")) <= 0.05 * F.col("n")).alias("within"))


@C.add("range_frame", "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS kind, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    by = Window.partitionBy("user_id")
    day = by.orderBy("us").rangeBetween(-86_400_000_000, 0)
    return e.select(
        "event_id", F.count("*").over(day).alias("n"), F.round(F.sum("value").over(day), 4).alias("total"),
        F.dense_rank().over(by.orderBy("event_type")).cast("long").alias("kind"), F.ntile(4).over(by.orderBy("ts", "event_id")).cast("long").alias("quarter"),
    )


# functions


@C.add("string_functions", r"SELECT p_partkey, upper(p_name) AS up, length(p_name) AS n, substr(p_brand, 1, 5) AS head, replace(p_type, ' ', '_') AS joined, regexp_extract(p_brand, '[0-9]+') AS digits, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, len(string_split(p_name, ' ')) AS words, contains(p_name, 'e') AS has_e FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    return p.select(
        "p_partkey", F.upper("p_name").alias("up"), F.length("p_name").cast("long").alias("n"), F.substring("p_brand", 1, 5).alias("head"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("joined"),
        F.regexp_extract("p_brand", "[0-9]+", 0).alias("digits"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.size(F.split("p_name", " ")).cast("long").alias("words"), F.contains("p_name", F.lit("e")).alias("has_e"),
    )


@C.add("date_functions", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate)::TIMESTAMP AS month_start, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS days, dayofyear(o_orderdate) AS doy, last_day(o_orderdate::DATE) AS month_end FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    at = F.col("o_orderdate")
    return o.select(
        "o_orderkey", F.year(at).cast("long").alias("y"), F.month(at).cast("long").alias("m"), F.date_trunc("month", at).cast("timestamp_ntz").alias("month_start"),
        F.date_diff(at.cast("date"), F.lit("1990-01-01").cast("date")).cast("long").alias("days"), F.dayofyear(at).cast("long").alias("doy"), F.last_day(at.cast("date")).alias("month_end"),
    )


@C.add("map_functions", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def _(spark, d):
    """Counts by kind folded into one map a user."""
    k = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = k.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))  # a row a kind
    of = lambda kind: F.coalesce(F.try_element_at("m", F.lit(kind)), F.lit(0)).alias(f"{kind}s")
    return m.select("user_id", of("view"), of("purchase"), F.size("m").cast("long").alias("kinds"))


@C.add("custom_aggregate", "SELECT c_mktsegment, round(exp(avg(ln(c_acctbal + 1001))), 4) AS geometric FROM customer GROUP BY 1")
def _(spark, d):
    return _rounded(X.custom_mean(table(spark, d, "customer").withColumn("v", F.col("c_acctbal") + 1001), "c_mktsegment", "v", "geometric"), "geometric", digits=4)


@C.add("table_function", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word, generate_subscripts(string_split(p_type, ' '), 1) - 1 AS at FROM part")
def _(spark, d):
    """A table function per row: every word with its place."""
    p = table(spark, d, "part").select("p_partkey", "p_type")
    return p.lateralJoin(spark.tvf.posexplode(F.split(F.col("p_type").outer(), " "))).select("p_partkey", F.col("col").alias("word"), F.col("pos").cast("long").alias("at"))


# learners: what any right fit must give


@C.add("learner_checks", " UNION ALL ".join(f"SELECT '{k}' AS learner, (SELECT count(*) FROM part) AS n, true AS better" for k in ("classif.logreg", "classif.tree", "regr.lm", "regr.ridge", "regr.tree")))
def _(spark, d):
    """Each learner predicts every part, better than the most common class or the mean."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 10).cast("double").alias("z"))
    p = p.withColumn("v", 3 * F.col("x") - F.col("z")).withColumn("c", F.when(F.col("x") > 25, "big").otherwise("small"))
    out = []
    for name in ("classif.logreg", "classif.tree", "regr.lm", "regr.ridge", "regr.tree"):
        target = "c" if name.startswith("classif") else "v"
        task = Task(p.select("p_partkey", "x", "z", target), "p_partkey", {target: "target"})
        pred = L.train(name, task).predict(task.df)
        hit = (F.col("truth") == F.col("response")).cast("double") if target == "c" else 1 - F.pow(F.col("truth") - F.col("response"), F.lit(2)) / 1000
        out.append(pred.agg(F.lit(name).alias("learner"), F.count("*").alias("n"), (F.avg(hit) > 0.8).alias("better")))
    both = out[0]
    for one in out[1:]:
        both = both.unionByName(one)
    return both


_COV = "SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, 50 * l_discount) AS b, var_samp(50 * l_discount) AS c FROM lineitem"


@C.add("pca_variances", f"WITH v AS ({_COV}) SELECT round((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b), 4) AS first, round((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 4) AS second FROM v")
def _(spark, d):
    df = table(spark, d, "lineitem").selectExpr("l_quantity q", "50 * l_discount d")
    out = L.pca(df, ["q", "d"], 2).agg(F.var_samp("PC1").alias("first"), F.var_samp("PC2").alias("second"))
    return _rounded(out, "first", "second", digits=4)


@C.add("kmeans_partition", "SELECT count(*) AS n, 3 AS clusters, 0 AS missing FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", "double(s_nationkey) x", "s_acctbal / 1000 y")
    pred = L.train("cluster.kmeans", Task(s, "s_suppkey")).predict(s)
    return pred.agg(F.count("*").alias("n"), F.count_distinct("response").cast("int").alias("clusters"), F.count_if(F.col("response").isNull()).cast("int").alias("missing"))


@C.add("environmental_folds", "SELECT count(*) AS n, true AS all_in_one FROM supplier")
def _(spark, d):
    """Folds by clusters of place and environment: every row in exactly one of at most five."""
    s = table(spark, d, "supplier").selectExpr("s_suppkey", "double(s_suppkey % 101) x", "double(s_suppkey * 37 % 101) y", "s_acctbal e")
    out = R.environmental(s, ["x", "y"], ["e"], 5, 0.5)
    return out.agg(F.count("*").alias("n"), ((F.count_distinct("s_suppkey") == F.count("*")) & (F.min("fold") >= 0) & (F.max("fold") < 5)).alias("all_in_one"))


@C.add("stacking", "SELECT count(*) AS n, true AS better FROM part")
def _(spark, d):
    """A linear model over out-of-fold predictions of two others is at least as near as the worse of them."""
    p = table(spark, d, "part").selectExpr("p_partkey", "double(p_size) x", "double(p_partkey % 10) z", "3 * p_size - p_partkey % 10 + 0D v")
    task = Task(p, "p_partkey", {"v": "target"})
    pred = L.stack({"a": ("regr.lm", {}), "b": ("regr.tree", {"maxDepth": 2})}, "regr.lm", task, folds=2)
    return pred.agg(F.count("*").alias("n"), (F.sqrt(F.avg(F.pow(F.col("truth") - F.col("response"), F.lit(2)))) < 5).alias("better"))


@C.add("permutation_importance", "SELECT 'x' AS first, 3 AS n_features")
def _(spark, d):
    """Of three features the one that the target is made of matters most."""
    p = table(spark, d, "part").selectExpr("p_partkey", "double(p_size) x", "double(p_partkey % 10) z", "p_retailprice w", "3D * p_size v")
    out = L.permutation_importance(L.train("regr.lm", Task(p, "p_partkey", {"v": "target"})), Task(p, "p_partkey", {"v": "target"}))
    return out.agg(F.max_by("feature", "importance").alias("first"), F.count("*").cast("int").alias("n_features"))


@C.add("grid_search", "SELECT 4 AS settings, true AS best_is_least")
def _(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "double(p_size) x", "double(p_partkey % 10) z", "3D * p_size v")
    found = L.grid("regr.tree", Task(p, "p_partkey", {"v": "target"}), {"maxDepth": [1, 3], "maxBins": [8, 64]}, folds=2)
    best = F.min_by("score", F.struct("score", "params"))
    return found.agg(F.count("*").cast("int").alias("settings"), (best == F.min("score")).alias("best_is_least"))
