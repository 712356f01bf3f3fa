"""Time series and resampling plans on events, orders, customers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample as R
from ..operators import timeseries as S
from ..sources.readers import table
from .catalogue import Catalogue

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql

ORDER = ["ts", "event_id"]


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "value")


_W = "PARTITION BY user_id ORDER BY ts, event_id"


@C.add("lags", f"SELECT * FROM (SELECT event_id, lag(value, 1) OVER ({_W}) AS value_lag_1, lag(value, 3) OVER ({_W}) AS value_lag_3 FROM events) WHERE value_lag_1 IS NOT NULL AND value_lag_3 IS NOT NULL")
def _(spark, d):
    return S.lags(_events(spark, d), ["value"], [1, 3], ORDER, "user_id").select("event_id", "value_lag_1", "value_lag_3")


_R3 = f"OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@C.add("rolling_mean_std", f"SELECT event_id, round(avg(value) {_R3}, 6) AS value_rolling_mean_3, round(stddev_samp(value) {_R3}, 6) AS value_rolling_std_3, min(value) {_R3} AS value_rolling_min_3, max(value) {_R3} AS value_rolling_max_3, round(sum(value) {_R3}, 6) AS value_rolling_sum_3, count(value) {_R3} AS value_rolling_count_3 FROM events")
def _(spark, d):
    out = S.rolling(_events(spark, d), ["value"], 3, ["mean", "std", "min", "max", "sum", "count"], ORDER, "user_id").drop("ts", "user_id", "value")
    return _rounded(out, "value_rolling_mean_3", "value_rolling_std_3", "value_rolling_sum_3")


@C.add("moving_average_full", f"SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round(avg(value) OVER w, 6) END AS value_rolling_mean_5 FROM events WINDOW w AS ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    return _rounded(S.rolling(_events(spark, d), ["value"], 5, ["mean"], ORDER, "user_id", full=True).select("event_id", "value_rolling_mean_5"), "value_rolling_mean_5")


@C.add(
    "supervised_features",
    "SELECT * FROM (SELECT event_id, " + ", ".join(f"lag(value, {k}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag_{k}" for k in (1, 2, 3)) + ", "
    + ", ".join(f"round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), 6) AS value_rolling_mean_{k}, round(stddev_samp(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), 6) AS value_rolling_std_{k}" for k in (3, 7))
    + " FROM events) WHERE value_lag_3 IS NOT NULL AND value_rolling_std_3 IS NOT NULL",
)
def _(spark, d):
    out = S.supervised(_events(spark, d), "value", ORDER, "user_id", 3, (3, 7), leak_free=True).drop("ts", "user_id", "value")
    return _rounded(out, *[f"value_rolling_{f}_{k}" for f in ("mean", "std") for k in (3, 7)])


@C.add("temporal_split", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM events) SELECT event_id, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos >= floor(n * 0.7::DOUBLE) + 50 AND pos < floor(n * 0.7::DOUBLE) + 50 + floor(n * 0.2::DOUBLE) THEN 'test' END AS split FROM r")
def _(spark, d):
    e = _events(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return S.temporal_split(e, "us", 0.7, 0.2, 50).select("event_id", "split")


@C.add(
    "regularity",
    """WITH s AS (SELECT user_id, epoch_us(ts) / 1e6::DOUBLE - lag(epoch_us(ts) / 1e6::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events), t AS (SELECT * FROM s WHERE d IS NOT NULL),
c AS (SELECT user_id, CAST(floor(d / 60) AS BIGINT) AS m, count(*) AS k FROM t GROUP BY 1, 2), b AS (SELECT user_id, m AS common_minutes FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC, m) = 1)
SELECT user_id, count(*) + 1 AS n, round(avg(d), 3) AS mean_step, round(stddev_samp(d), 3) AS std_step, max(common_minutes) AS common_minutes, coalesce(stddev_samp(d) / nullif(avg(d), 0) < 0.1, false) AS regular FROM t JOIN b USING (user_id) GROUP BY user_id""",
)
def _(spark, d):
    return _rounded(S.regularity(_events(spark, d), "ts", ["user_id"]), "mean_step", "std_step", digits=3)


@C.add(
    "series_features",
    """WITH m AS (SELECT event_type, count(*) AS n, avg(value) AS mu FROM events GROUP BY 1), k AS (SELECT event_type, n, avg(pow(value - mu, 2)) AS m2, avg(pow(value - mu, 3)) AS m3, avg(pow(value - mu, 4)) AS m4 FROM events JOIN m USING (event_type) GROUP BY 1, 2)
SELECT event_type, max(k.n) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75,
round(max(m3 / pow(m2, 1.5) * sqrt(k.n * (k.n - 1)) / (k.n - 2)), 6) AS skew, round(max((k.n - 1) / CAST((k.n - 2) * (k.n - 3) AS DOUBLE) * ((k.n + 1) * (m4 / (m2 * m2) - 3) + 6)), 6) AS kurt FROM events JOIN k USING (event_type) GROUP BY event_type""",
)
def _(spark, d):
    return _rounded(S.series_features(table(spark, d, "events"), "value", ["event_type"]), "mean", "std", "median", "q25", "q75", "skew", "kurt")


@C.add("window_score", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT event_type, count(*) AS n, round(avg(value), 6) AS window_mean, arg_min(value, r) AS last FROM r WHERE r <= 100 GROUP BY event_type")
def _(spark, d):
    return _rounded(S.recent(table(spark, d, "events"), "event_type", ORDER, "value", 100), "window_mean")


@C.add("trend", "WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS DOUBLE) AS x FROM events), s AS (SELECT event_type, regr_slope(value, x) AS slope FROM r GROUP BY 1) SELECT event_type, round(slope, 8) AS slope, CASE WHEN abs(slope) < 0.001 THEN 'stable' WHEN slope > 0 THEN 'up' ELSE 'down' END AS trend FROM s")
def _(spark, d):
    return _rounded(S.trend(table(spark, d, "events"), "event_type", ORDER, "value"), "slope", digits=8)


@C.add(
    "exponential_smoothing",
    "WITH l AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1) SELECT user_id, len(v) AS n, round(v[1] * pow(0.7::DOUBLE, len(v) - 1) + coalesce(list_sum([0.3::DOUBLE * v[i] * pow(0.7::DOUBLE, len(v) - i) FOR i IN range(2, len(v) + 1)]), 0), 6) AS level FROM l",
)
def _(spark, d):
    return _rounded(S.smooth(_events(spark, d), ["user_id"], "ts", "value"), "level")


# resampling

_PLACE = "SELECT {id}, row_number() OVER ({part}ORDER BY md5('{seed}:' || {id}), {id}) - 1 AS pos, count(*) OVER ({p}) AS n FROM {t}"


@C.add("cv_folds", f"WITH r AS ({_PLACE.format(id='o_orderkey', part='', p='', seed=1, t='orders')}) SELECT o_orderkey, CAST(CASE WHEN pos < (n % 7) * (n // 7 + 1) THEN pos // (n // 7 + 1) ELSE n % 7 + (pos - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM r")
def _(spark, d):
    return R.cv(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7, 1)


@C.add("cv_stratified", f"WITH r AS ({_PLACE.format(id='o_orderkey', part='PARTITION BY o_orderstatus ', p='', seed=2, t='orders')}) SELECT o_orderkey, CAST(pos % 5 AS INTEGER) AS fold FROM r")
def _(spark, d):
    return R.cv(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 5, 2, "o_orderstatus").drop("o_orderstatus")


@C.add("repeated_cv", " UNION ALL ".join(f"SELECT c_custkey, CAST(CASE WHEN pos < (n % 4) * (n // 4 + 1) THEN pos // (n // 4 + 1) ELSE n % 4 + (pos - (n % 4) * (n // 4 + 1)) // (n // 4) END AS INTEGER) AS fold, {r} AS repeat FROM ({_PLACE.format(id='c_custkey', part='', p='', seed=3 + r, t='customer')})" for r in range(2)))
def _(spark, d):
    return R.repeated_cv(table(spark, d, "customer").select("c_custkey"), "c_custkey", 4, 2, 3)


@C.add("holdout", f"WITH r AS ({_PLACE.format(id='c_custkey', part='PARTITION BY c_mktsegment ', p='PARTITION BY c_mktsegment', seed=4, t='customer')}) SELECT c_custkey, pos < floor(n * 0.67::DOUBLE) AS is_train FROM r")
def _(spark, d):
    return R.holdout(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 0.67, 4, "c_mktsegment").drop("c_mktsegment")


@C.add("subsampling", " UNION ALL ".join(f"SELECT p_partkey, pos < floor(n * 0.5::DOUBLE) AS is_train, {i} AS iter FROM ({_PLACE.format(id='p_partkey', part='', p='', seed=5 + i, t='part')})" for i in range(3)))
def _(spark, d):
    return R.subsampling(table(spark, d, "part").select("p_partkey"), "p_partkey", 3, 0.5, 5)


@C.add(
    "bootstrap_oob",
    f"""WITH r AS ({_PLACE.format(id='c_custkey', part='', p='', seed=6, t='customer')}), d AS (SELECT b AS iter, CAST('0x' || substr(md5('6:' || b || ':' || j), 1, 8) AS BIGINT) % (SELECT count(*) FROM customer) AS pos FROM range((SELECT count(*) FROM customer)) t(j), range(3) u(b)),
h AS (SELECT iter, pos, count(*) AS draws FROM d GROUP BY 1, 2) SELECT CAST(b AS INTEGER) AS iter, c_custkey, coalesce(draws, 0) AS draws FROM r CROSS JOIN range(3) u(b) LEFT JOIN h ON h.iter = b AND h.pos = r.pos""",
)
def _(spark, d):
    return R.bootstrap(table(spark, d, "customer"), "c_custkey", 3, 1.0, 6)


@C.add("leave_one_out", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS fold FROM supplier")
def _(spark, d):
    return R.leave_one_out(table(spark, d, "supplier"), "s_suppkey")


@C.add("custom_cv", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS fold FROM customer")
def _(spark, d):
    return R.by_column(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").drop("c_mktsegment")


_CELL = "least({k} - 1, floor(({v} - min({v}) OVER ()) * {k} / (max({v}) OVER () - min({v}) OVER ())))"
_XY = "SELECT s_suppkey, s_acctbal / 100 AS x, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS y FROM supplier"


def _points(spark, d):
    return table(spark, d, "supplier").selectExpr("s_suppkey", "s_acctbal / 100 as x", "double(s_suppkey * 37 % 101) as y")


@C.add("block_cv", f"WITH p AS ({_XY}) SELECT s_suppkey, CAST(({_CELL.format(k=4, v='y')} + {_CELL.format(k=5, v='x')}) % 3 AS INTEGER) AS fold FROM p")
def _(spark, d):
    return R.spatial_blocks(_points(spark, d), "x", "y", 4, 5, 3).drop("x", "y")


@C.add("spatial_grid", f"WITH p AS ({_XY}), c AS (SELECT s_suppkey, {_CELL.format(k=4, v='y')} AS r, {_CELL.format(k=4, v='x')} AS c FROM p) SELECT s_suppkey, CAST((dense_rank() OVER (ORDER BY r, c) - 1) % 5 AS INTEGER) AS fold FROM c")
def _(spark, d):
    return R.spatial_kfold(_points(spark, d), "x", "y").drop("x", "y")


@C.add("spatial_neighbours", f"WITH p AS ({_XY}) SELECT a.s_suppkey AS id_a, b.s_suppkey AS id_b, round(pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 6) AS d2 FROM p a, p b WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 64 AND a.s_suppkey <> b.s_suppkey")
def _(spark, d):
    p = _points(spark, d)
    pairs = R.near(p, p, "x", "y", 8.0, ("s_suppkey", "s_suppkey")).filter("id_a <> id_b")
    return pairs.withColumn("d2", F.floor(F.col("d2") * 1e6 + 0.5) / F.lit(1e6))  # round() makes a decimal of each


@C.add(
    "buffer_antijoin",
    f"WITH p AS ({_XY}), r AS (SELECT p.*, row_number() OVER (ORDER BY md5('8:' || s_suppkey), s_suppkey) - 1 < floor(count(*) OVER () * 0.2::DOUBLE) AS test FROM p) SELECT s_suppkey, x, y, CASE WHEN test THEN 'test' WHEN NOT EXISTS (SELECT 1 FROM r t WHERE t.test AND pow(t.x - r.x, 2) + pow(t.y - r.y, 2) <= 36) THEN 'train' END AS role FROM r",
)
def _(spark, d):
    return R.buffered(_points(spark, d), "s_suppkey", "x", "y", 6.0, 0.2, 8)


@C.add("split_check", "WITH a AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 < 8), b AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 >= 7) SELECT (SELECT count(*) FROM a) AS n_train, (SELECT count(*) FROM b) AS n_test, (SELECT count(*) FROM a JOIN b USING (o_orderkey)) AS overlap, count(*) AS n_union, count(*) FILTER (WHERE o_orderkey >= 10000) AS out_of_bounds, round((SELECT count(*) FROM b) / CAST(count(*) AS DOUBLE), 6) AS test_ratio FROM (SELECT * FROM a UNION SELECT * FROM b)")
def _(spark, d):
    o = table(spark, d, "orders")
    return _rounded(R.split_check(o.filter("o_orderkey % 10 < 8"), o.filter("o_orderkey % 10 >= 7"), "o_orderkey", 10000), "test_ratio")
