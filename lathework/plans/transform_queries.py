"""Feature transforms on orders, parts, customers, lines and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transform as T
from ..sources.readers import table
from .catalogue import Catalogue

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice")


def _scaled(name, centre, spread, **how):
    @C.add(name, f"WITH s AS (SELECT {centre} AS m, {spread} AS s FROM orders) SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice FROM orders, s")
    def _(spark, d):
        return _rounded(T.scale(_orders(spark, d), ["o_totalprice"], **how), "o_totalprice")


_IQR = "quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)"
_scaled("scale_pop", "avg(o_totalprice)", "stddev_pop(o_totalprice)")
_scaled("scale_samp_eps", "avg(o_totalprice)", "stddev_samp(o_totalprice) + 1e-8", eps=1e-8, sample=True)
_scaled("scale_minmax", "min(o_totalprice)", "max(o_totalprice) - min(o_totalprice)", method="minmax")
_scaled("scale_robust", "quantile_cont(o_totalprice, 0.5)", _IQR, method="robust")


@C.add("scale_mad", "WITH m AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders), s AS (SELECT quantile_cont(abs(o_totalprice - m), 0.5) AS s FROM orders, m) SELECT o_orderkey, round((o_totalprice - m) / (s + 1e-10), 6) AS o_totalprice FROM orders, m, s")
def _(spark, d):
    return _rounded(T.mad_scale(_orders(spark, d), "o_totalprice"), "o_totalprice")


_HOLED = "h AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS a, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS b, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS c, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS d FROM part)"


@C.add(
    "impute",
    f"WITH {_HOLED}, s AS (SELECT avg(a) AS a, quantile_cont(b, 0.5) AS b FROM h), m AS (SELECT c FROM h WHERE c IS NOT NULL GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) SELECT p_partkey, round(coalesce(h.a, s.a), 6) AS a, coalesce(h.b, s.b) AS b, coalesce(h.c, m.c) AS c, coalesce(h.d, 'none') AS d, CASE WHEN h.a IS NULL THEN 1 ELSE 0 END AS a_was_missing, CASE WHEN h.b IS NULL THEN 1 ELSE 0 END AS b_was_missing, CASE WHEN h.c IS NULL THEN 1 ELSE 0 END AS c_was_missing, CASE WHEN h.d IS NULL THEN 1 ELSE 0 END AS d_was_missing FROM h, s, m",
)
def _(spark, d):
    h = table(spark, d, "part").selectExpr("p_partkey", "case when p_partkey % 5 <> 0 then p_retailprice end a", "case when p_partkey % 7 <> 0 then double(p_size) end b", "case when p_partkey % 3 <> 0 then p_brand end c", "case when p_partkey % 4 <> 0 then p_type end d")
    return _rounded(T.impute(h, {"a": "mean", "b": "median", "c": "mode", "d": ("constant", "none")}, indicator=True), "a")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@C.add("one_hot", "SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS \"c_mktsegment_{s}\"" for s in _SEGMENTS) + " FROM customer")
def _(spark, d):
    return T.one_hot(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", _SEGMENTS)


@C.add("label_encode", "WITH k AS (SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 50 <> 0 AND p_size < 5)) SELECT p_partkey, coalesce(code, -1) AS p_brand FROM part LEFT JOIN k USING (p_brand)")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return T.label_encode(p.drop("p_size"), "p_brand", fit=p.filter("p_partkey % 50 <> 0 and p_size < 5"))


@C.add("label_encode_whole", "WITH k AS (SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)) SELECT p_partkey, coalesce(code, -1) AS p_brand FROM part LEFT JOIN k USING (p_brand)")
def _(spark, d):
    return T.label_encode(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand")


@C.add("target_encode", "WITH g AS (SELECT avg(p_retailprice) AS g FROM part), k AS (SELECT p_brand, avg(p_retailprice) AS m, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, round(CASE WHEN n >= 75 THEN (n * m + 10.0::DOUBLE * g) / (n + 10.0::DOUBLE) ELSE g END, 6) AS p_brand FROM part JOIN k USING (p_brand), g")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return _rounded(T.target_encode(p, "p_brand", "p_retailprice", 10.0, 75).drop("p_retailprice"), "p_brand")


@C.add("count_frequency", "WITH h AS (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN event_type END AS e FROM events), k AS (SELECT e, count(*) AS n FROM h WHERE e IS NOT NULL GROUP BY e) SELECT event_id, h.e, coalesce(n, 0) AS e_count, round(coalesce(n, 0) / CAST((SELECT sum(n) FROM k) AS DOUBLE), 6) AS e_freq FROM h LEFT JOIN k ON h.e = k.e")
def _(spark, d):
    h = table(spark, d, "events").selectExpr("event_id", "case when event_id % 6 <> 0 then event_type end e")
    return _rounded(T.count_frequency(h, "e"), "e_freq")


@C.add("group_rare", "WITH k AS (SELECT p_brand, count(*) / CAST((SELECT count(*) FROM part) AS DOUBLE) AS f FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN f < 0.04 THEN 'RARE' ELSE p_brand END AS p_brand FROM part JOIN k USING (p_brand)")
def _(spark, d):
    return T.group_rare(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 0.04)


@C.add("bins_quantile", "WITH e AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM orders) SELECT o_orderkey, CAST(len([x FOR x IN e IF x <= o_totalprice]) AS INTEGER) AS bin FROM orders, e")
def _(spark, d):
    return T.bins(_orders(spark, d), "o_totalprice", 5, out="bin").drop("o_totalprice")


@C.add("bins_uniform", "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT o_orderkey, CAST(len([x FOR x IN [0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE] IF lo + (hi - lo) * x <= o_totalprice]) AS INTEGER) AS bin FROM orders, e")
def _(spark, d):
    return T.bins(_orders(spark, d), "o_totalprice", 5, "uniform", out="bin").drop("o_totalprice")


@C.add("bins_cut", "SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 0 WHEN p_size > 10 AND p_size <= 25 THEN 1 WHEN p_size > 25 AND p_size <= 40 THEN 2 END AS cut FROM part")
def _(spark, d):
    return T.cut(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", [0, 10, 25, 40], out="cut").drop("p_size")


@C.add("polynomial", 'SELECT event_id, value AS "value", user_id AS "user_id", value * value AS "value^2", value * user_id AS "value user_id", user_id * user_id AS "user_id^2" FROM events')
def _(spark, d):
    return T.polynomial(table(spark, d, "events").select("event_id", "value", "user_id"), ["value", "user_id"])


_ROW = "CASE WHEN l_linenumber <> 3 THEN l_quantity END AS a, l_discount AS b, l_tax AS c"


@C.add(
    "row_stats",
    f"WITH h AS (SELECT l_orderkey, l_partkey, l_suppkey, {_ROW} FROM lineitem), v AS (SELECT *, list_sort([x FOR x IN [a, b, c] IF x IS NOT NULL]) AS v FROM h) SELECT l_orderkey, l_partkey, l_suppkey, round(list_sum(v), 6) AS row_sum, round(list_avg(v), 6) AS row_mean, list_max(v) AS row_max, list_min(v) AS row_min, round(list_stddev_samp(v), 6) AS row_std, CAST(len(v) AS BIGINT) AS row_count, round(list_median(v), 6) AS row_median FROM v",
)
def _(spark, d):
    h = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "case when l_linenumber <> 3 then l_quantity end a", "l_discount b", "l_tax c")
    return _rounded(T.row_stats(h, ["a", "b", "c"]).drop("a", "b", "c"), "row_sum", "row_mean", "row_std", "row_median")


@C.add("ratio_difference", "SELECT o_orderkey, round(o_totalprice / (o_custkey + 1e-10), 4) AS ratio, o_totalprice - o_custkey AS difference, round(pow(o_totalprice / 1000, 3), 2) AS cube FROM orders WHERE o_custkey > 0")
def _(spark, d):
    o = table(spark, d, "orders").filter("o_custkey > 0")
    return o.select("o_orderkey", F.round(T.ratio("o_totalprice", "o_custkey"), 4).alias("ratio"), (F.col("o_totalprice") - F.col("o_custkey")).alias("difference"), F.round(F.pow(F.col("o_totalprice") / 1000, F.lit(3.0)), 2).alias("cube"))


@C.add("interactions", "SELECT p_partkey, p_size, p_retailprice, p_retailprice * p_size AS p_retailprice_x_p_size, round(p_retailprice / nullif(p_size, 0), 6) AS p_retailprice_div_p_size FROM part")
def _(spark, d):
    return _rounded(T.interactions(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]), "p_retailprice_div_p_size")


@C.add("group_mean", "SELECT c_custkey, c_mktsegment, round(avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS c_acctbal_by_c_mktsegment FROM customer")
def _(spark, d):
    return _rounded(T.group_mean(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal").drop("c_acctbal"), "c_acctbal_by_c_mktsegment")


@C.add("auto_numeric", "SELECT o_orderkey, round(o_totalprice * o_totalprice, 2) AS o_totalprice_square, round(1 / o_totalprice, 10) AS o_totalprice_reciprocal, round(ln(o_totalprice), 6) AS o_totalprice_log, round(sqrt(o_totalprice), 6) AS o_totalprice_sqrt FROM orders")
def _(spark, d):
    out = T.auto_numeric(_orders(spark, d), "o_totalprice").drop("o_totalprice")
    return _rounded(_rounded(_rounded(out, "o_totalprice_log", "o_totalprice_sqrt"), "o_totalprice_square", digits=2), "o_totalprice_reciprocal", digits=10)


@C.add(
    "tfidf",
    r"""WITH t AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '\b\w\w+\b')) AS token FROM part), f AS (SELECT p_partkey, token, count(*) AS tf FROM t GROUP BY 1, 2),
i AS (SELECT token, ln((1 + (SELECT count(*) FROM part)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM f GROUP BY 1), w AS (SELECT p_partkey, token, tf, tf * idf AS w FROM f JOIN i USING (token))
SELECT p_partkey, token, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)), 6) AS tfidf FROM w""",
)
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return _rounded(T.tfidf(p, "p_partkey", "t"), "tfidf")


@C.add("chunk_text", "WITH c AS (SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(0, ceil((length(text) - 500) / 400.0::DOUBLE)) AS BIGINT))) AS chunk FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, substr(text, chunk * 400 + 1, 500) AS content FROM c")
def _(spark, d):
    return T.chunks(table(spark, d, "documents"), "doc_id", "text", 500, 100)
