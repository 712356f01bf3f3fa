"""Feature selection, post-hoc tests, further measures, roles and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import measures as M
from ..operators import models as K
from ..operators import resample as R
from ..operators import scores as S
from ..operators import selection as L
from ..operators.retrieval import top_k
from ..sources.readers import table
from ..task import Task
from .catalogue import Catalogue
from .model_queries import _INFO, _SCORES, LINE, _each, _scores
from .model_queries import ORACLE_SQL as _MODEL_SQL

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_VAR = "(" + _each("SELECT '{c}' AS feature, var_samp({c}) AS score FROM lineitem") + ")"


def _variances(spark, d):
    return S.variance(table(spark, d, "lineitem"), LINE)


@C.add("filter_top_k", f"SELECT feature, round(score, 3) AS score FROM {_VAR} ORDER BY score DESC, feature LIMIT 2")
def _(spark, d):
    return _rounded(L.top_k(_variances(spark, d), 2), "score", digits=3)


@C.add("filter_threshold", f"SELECT feature, round(score, 3) AS score FROM {_VAR} WHERE score >= 0.0005")
def _(spark, d):
    return _rounded(L.threshold(_variances(spark, d), 0.0005), "score", digits=3)


@C.add("filter_percentile", f"WITH v AS (SELECT * FROM {_VAR}) SELECT feature, round(score, 3) AS score FROM v WHERE score >= (SELECT quantile_cont(score, 0.4) FROM v)")
def _(spark, d):
    return _rounded(L.percentile(_variances(spark, d), 40), "score", digits=3)


@C.add("filter_rank", f"SELECT feature, CAST(row_number() OVER (ORDER BY score DESC, feature) AS INTEGER) AS rank FROM {_VAR} QUALIFY rank <= 3")
def _(spark, d):
    return L.ranks(_variances(spark, d), 3).select("feature", "rank")


@C.add("filter_columns", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def _(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LINE, "l_returnflag")
    return L.filter_columns(df, LINE, "l_returnflag", "variance")  # the better half


@C.add("select_k_best", "SELECT feature, score FROM (" + _MODEL_SQL["f_regression"] + ") ORDER BY score DESC, feature LIMIT 2")
def _(spark, d):
    return _rounded(L.top_k(L.create_filter("auto", True)(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), 2), "score", digits=3)


_RANKED = (
    "s AS (SELECT 'anova' AS filter, feature, score FROM (" + _MODEL_SQL["anova_f"] + ") UNION ALL SELECT 'chi2', feature, score FROM (" + _MODEL_SQL["chi2_scores"]
    + ") UNION ALL SELECT 'info_gain', feature, info_gain FROM (" + _MODEL_SQL["info_gain"] + ")), "
    "r AS (SELECT feature, rank() OVER (PARTITION BY filter ORDER BY score DESC) + (count(*) OVER (PARTITION BY filter, score) - 1) / 2.0::DOUBLE AS rank FROM s), "
    "m AS (SELECT feature, avg(rank) AS mean_rank FROM r GROUP BY feature)"
)


@C.add("cumulative_ranking", f"WITH {_RANKED} SELECT feature, round(mean_rank, 6) AS mean_rank, round(5 - mean_rank, 6) AS score FROM m")
def _(spark, d):
    return _rounded(L.cumulative_ranking(table(spark, d, "lineitem"), LINE, "l_returnflag", ["anova", "chi2", "info_gain"]), "mean_rank", "score")


@C.add("quick_selection", f"WITH {_RANKED} SELECT feature, round(5 - mean_rank, 6) AS score FROM m ORDER BY mean_rank, feature LIMIT 2")
def _(spark, d):
    return _rounded(L.quick_selection(table(spark, d, "lineitem"), LINE, "l_returnflag", 2, ["anova", "chi2", "info_gain"]).select("feature", "score"), "score")


@C.add(
    "mrmr",
    "WITH r AS (SELECT feature, score FROM (" + _each("SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS score FROM lineitem", ["l_quantity", "l_discount", "l_tax"]) + ")), f AS (SELECT feature, score FROM r ORDER BY score DESC, feature LIMIT 1), "
    "c AS (SELECT 'l_quantity' AS x, 'l_discount' AS y, abs(corr(l_quantity, l_discount)) AS c FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', abs(corr(l_quantity, l_tax)) FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', abs(corr(l_discount, l_tax)) FROM lineitem), "
    "g AS (SELECT r.feature FROM r, f, c WHERE r.feature <> f.feature AND ((c.x = r.feature AND c.y = f.feature) OR (c.y = r.feature AND c.x = f.feature)) ORDER BY r.score - c.c DESC, r.feature LIMIT 1) "
    "SELECT 1 AS position, feature FROM f UNION ALL SELECT 2, feature FROM g",
)
def _(spark, d):
    from ..operators.profile import correlations

    df, own = table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]
    picked = S.mrmr(S.pearson(df, own, "l_extendedprice"), correlations(df, own), 2)
    return spark.createDataFrame(list(enumerate(picked, 1)), "position int, feature string")


_PAIRS = (
    "WITH e AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in LINE) + " FROM lineitem), k AS (SELECT "
    + ", ".join(f"len([i FOR i IN [0.1::DOUBLE,0.2::DOUBLE,0.3::DOUBLE,0.4::DOUBLE,0.5::DOUBLE,0.6::DOUBLE,0.7::DOUBLE,0.8::DOUBLE,0.9::DOUBLE] IF lo_{c} + (hi_{c} - lo_{c}) * i <= {c}]) AS b_{c}" for c in LINE)
    + ", l_returnflag AS y, count(*) AS k FROM lineitem, e GROUP BY ALL), p AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, b_{a} AS x, b_{b} AS z, y, sum(k)::DOUBLE AS k FROM k GROUP BY ALL" for i, a in enumerate(LINE) for b in LINE[i + 1 :])
    + "), t AS (SELECT a, b, sum(k) AS t FROM p GROUP BY ALL)"
    + "".join(f", {n} AS (SELECT a, b, -sum(c / t * log2(c / t)) AS v FROM (SELECT a, b, sum(k) AS c FROM p GROUP BY a, b{g}) JOIN t USING (a, b) GROUP BY a, b)" for n, g in (("hx", ", x"), ("hz", ", z"), ("hl", ", y"), ("hxz", ", x, z"), ("h", ", x, z, y")))
    + ", q AS (SELECT a, b, hxz.v + hl.v - h.v AS joint, hx.v + hz.v - hxz.v AS redundancy, h.v AS h FROM hx JOIN hz USING (a, b) JOIN hl USING (a, b) JOIN hxz USING (a, b) JOIN h USING (a, b))"
)


@C.add("pair_information", f"{_PAIRS} SELECT a, b, round(joint, 6) AS joint, round(redundancy, 6) AS redundancy, round(h, 6) AS h FROM q")
def _(spark, d):
    return _rounded(L.pair_information(table(spark, d, "lineitem"), LINE, "l_returnflag"), "joint", "redundancy", "h")


@C.add(
    "joint_selection",
    f"{_PAIRS}, r AS (SELECT feature, info_gain AS rel FROM ({_each(_INFO)})), f AS (SELECT feature, rel FROM r ORDER BY rel DESC, feature LIMIT 1), "
    "o AS (SELECT r.feature, r.rel, f.rel AS rel_f, q.* FROM r, f, q WHERE r.feature <> f.feature AND ((q.a = r.feature AND q.b = f.feature) OR (q.b = r.feature AND q.a = f.feature))), "
    "m AS (SELECT unnest(['jmi', 'jmim', 'cmim', 'disr', 'mifs']) AS method), "
    "w AS (SELECT method, feature, CASE method WHEN 'cmim' THEN least(rel, joint - rel_f) WHEN 'disr' THEN joint / h WHEN 'mifs' THEN rel - redundancy ELSE joint END AS worth FROM o, m) "
    "SELECT method, 1 AS position, feature FROM m, f UNION ALL SELECT method, 2, feature FROM w QUALIFY row_number() OVER (PARTITION BY method ORDER BY worth DESC, feature) = 1",
)
def _(spark, d):
    df = table(spark, d, "lineitem")
    tables = L.joint_tables(df, LINE, "l_returnflag")
    rows = [(m, i, f) for m in L.JOINT for i, f in enumerate(L.greedy(*tables, 2, m), 1)]
    return spark.createDataFrame(rows, "method string, position int, feature string")


@C.add("sim_jaccard", "WITH s AS (SELECT c_mktsegment AS k, list(DISTINCT CASE WHEN c_acctbal > 9500 THEN c_nationkey END) AS s FROM customer WHERE c_acctbal > 9500 GROUP BY 1) SELECT count(*) AS pairs, round(avg(len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE)), 6) AS jaccard FROM s a JOIN s b ON a.k < b.k")
def _(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 9500").select(F.col("c_mktsegment").alias("iter"), F.col("c_nationkey").alias("feature"))
    return _rounded(L.jaccard(c), "jaccard")


# tests over learners


_KW = f"WITH {_SCORES}, a AS (SELECT learner, score, rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM s), n AS (SELECT count(*)::DOUBLE AS n FROM a), t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*) AS c FROM a GROUP BY score)), q AS (SELECT sum(q) AS q, count(*) AS k FROM (SELECT pow(sum(rk), 2) / count(*) AS q FROM a GROUP BY learner))"


@C.add("kruskal", f"{_KW} SELECT CAST(n AS BIGINT) AS n, k, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 6) AS statistic FROM n, t, q")
def _(spark, d):
    return _rounded(S.kruskal(_scores(spark, d)), "statistic")


@C.add("one_way_anova", f"WITH {_SCORES}, x AS (SELECT learner AS y, score - (SELECT avg(score) FROM s) AS v FROM s), g AS (SELECT y, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM x GROUP BY y) SELECT round(((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))), 6) AS statistic FROM g")
def _(spark, d):
    return _rounded(S.one_way(_scores(spark, d)), "statistic")


@C.add("nemenyi", f"WITH {_SCORES}, m AS (SELECT learner, avg(rank) AS r, count(*) AS n FROM r GROUP BY 1) SELECT a.learner AS a, b.learner AS b, round(abs(a.r - b.r), 6) AS difference, round(2.569::DOUBLE * sqrt(4 * 5 / (6.0::DOUBLE * a.n)), 6) AS critical, abs(a.r - b.r) > 2.569::DOUBLE * sqrt(4 * 5 / (6.0::DOUBLE * a.n)) AS differs FROM m a JOIN m b ON a.learner < b.learner")
def _(spark, d):
    return _rounded(S.nemenyi(_scores(spark, d)), "difference", "critical")


@C.add("ab_allocation", "WITH h AS (SELECT c_custkey, (CAST(CAST('0x' || substr(md5('5:' || c_custkey), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE AS u FROM customer) SELECT c_custkey, CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS variant FROM h")
def _(spark, d):
    return D.allocate(table(spark, d, "customer").select("c_custkey"), "c_custkey", {"a": 5.0, "b": 3.0, "c": 2.0}, 5)


# measures of several classes


_PROB = "p AS (SELECT o_orderstatus AS y, round(0.2 + 0.5::DOUBLE * (o_orderkey % 7) / 7, 6) AS f, round(0.1 + 0.4::DOUBLE * (o_custkey % 5) / 5, 6) AS o, round(0.3 + 0.2::DOUBLE * (o_orderkey % 3) / 3, 6) AS q FROM orders)"
_CLASSES = (("F", "f"), ("O", "o"), ("P", "q"))


def _probabilities(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderstatus y", "round(0.2 + 0.5D * (o_orderkey % 7) / 7, 6) f", "round(0.1 + 0.4D * (o_custkey % 5) / 5, 6) o", "round(0.3 + 0.2D * (o_orderkey % 3) / 3, 6) q")


@C.add("mbrier", f"WITH {_PROB} SELECT count(*) AS n, round(avg(" + " + ".join(f"pow((CASE WHEN y = '{k}' THEN 1.0::DOUBLE ELSE 0 END) - {c}, 2)" for k, c in _CLASSES) + "), 6) AS mbrier FROM p")
def _(spark, d):
    return _rounded(M.brier_multi(_probabilities(spark, d), "y", dict(_CLASSES)), "mbrier")


_AUC = "SELECT (sum(r) FILTER (WHERE y = '{k}') - count(*) FILTER (WHERE y = '{k}') * (count(*) FILTER (WHERE y = '{k}') + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE y = '{k}') * count(*) FILTER (WHERE y <> '{k}')) AS auc, count(*) FILTER (WHERE y = '{k}') AS n FROM (SELECT y, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r FROM p{w})"


@C.add("mauc_aunu_aunp", f"WITH {_PROB}, a AS (" + " UNION ALL ".join(_AUC.format(k=k, c=c, w="") for k, c in _CLASSES) + ") SELECT round(avg(auc), 6) AS aunu, round(sum(auc * n) / sum(n), 6) AS aunp FROM a")
def _(spark, d):
    return _rounded(M.auc_multi(_probabilities(spark, d), "y", dict(_CLASSES)), "aunu", "aunp")


@C.add("mauc_au1u", f"WITH {_PROB}, a AS (" + " UNION ALL ".join(_AUC.format(k=k, c=c, w=f" WHERE y IN ('{k}', '{j}')") for k, c in _CLASSES for j, _ in _CLASSES if j != k) + ") SELECT round(avg(auc), 6) AS au1u FROM a")
def _(spark, d):
    return _rounded(M.auc_pairs(_probabilities(spark, d), "y", dict(_CLASSES)), "au1u")


_LOSS = "sum(greatest(0.9::DOUBLE * (t - {p}), (0.9::DOUBLE - 1) * (t - {p})))"


@C.add("rqr", f"WITH r AS (SELECT l_extendedprice AS t, l_quantity * 1500 + 800 * l_discount AS p FROM lineitem), q AS (SELECT quantile_cont(t, 0.9) AS q FROM r) SELECT round(1 - {_LOSS.format(p='p')} / {_LOSS.format(p='q')}, 6) AS rqr FROM r, q")
def _(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500 + 800 * F.col("l_discount")).alias("p"))
    return _rounded(M.rqr(r, "t", "p", 0.9), "rqr")


@C.add("measure_by_id", "SELECT 'regr.mae' AS id, round(avg(abs(o_custkey - o_totalprice)), 4) AS score FROM orders UNION ALL SELECT 'regr.rmse', round(sqrt(avg(pow(o_custkey - o_totalprice, 2))), 4) FROM orders UNION ALL SELECT 'regr.bias', round(avg(o_custkey - o_totalprice), 4) FROM orders")
def _(spark, d):
    o, out = table(spark, d, "orders"), None
    for name in ("regr.mae", "regr.rmse", "regr.bias"):
        one = M.create_measure(name)(o, "o_totalprice", "o_custkey").select(F.lit(name).alias("id"), F.round("score", 4).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


# roles and plans


@C.add("row_roles", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'test' ELSE 'use' END AS row_role FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    return Task(c, "c_custkey").set_row_roles(c.filter("c_mktsegment = 'BUILDING'")).select("c_custkey", "row_role")


@C.add("task_divide", "SELECT CASE WHEN c_acctbal < 0 THEN 'test' ELSE 'train' END AS side, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "customer")
    train, test = Task(c, "c_custkey").divide(c.filter("c_acctbal < 0"))
    both = train.df.withColumn("side", F.lit("train")).unionByName(test.df.withColumn("side", F.lit("test")))
    return _rounded(both.groupBy("side").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total")), "total", digits=2)


@C.add("task_select", "SELECT p_partkey, p_size AS size, p_brand, p_retailprice FROM part")
def _(spark, d):
    t = Task(table(spark, d, "part"), "p_partkey", {"p_retailprice": "target"}).set_roles({"p_brand": "group"})
    return t.select(["p_size"]).rename({"p_size": "size"}).df


@C.add("task_ordered", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def _(spark, d):
    return Task(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", {"o_orderdate": "order"}).ordered()


@C.add("task_levels", "SELECT c_mktsegment AS level, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def _(spark, d):
    return Task(table(spark, d, "customer"), "c_custkey").set_levels("c_mktsegment", ["BUILDING", "MACHINERY", "NONE"]).levels("c_mktsegment")


_AT = "row_number() OVER (PARTITION BY s ORDER BY md5('{seed}:' || c_custkey), c_custkey) - 1"
_HOLED = "h AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS s FROM customer)"


def _holed(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey", "case when c_custkey % 5 <> 0 then c_mktsegment end s")


@C.add("cv_null_strata", f"WITH {_HOLED} SELECT c_custkey, CAST(({_AT.format(seed=12)}) % 4 AS INTEGER) AS fold FROM h")
def _(spark, d):
    return R.cv(_holed(spark, d), "c_custkey", 4, 12, "s").drop("s")


@C.add("repeated_cv_strata", " UNION ALL ".join(f"SELECT c_custkey, {r} AS repeat, CAST(({_AT.format(seed=13 + r)}) % 3 AS INTEGER) AS fold FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS s FROM customer)" for r in range(3)))
def _(spark, d):
    return R.repeated_cv(_holed(spark, d), "c_custkey", 3, 3, 13, "s").drop("s")


@C.add("subsampling_strata", " UNION ALL ".join(f"SELECT c_custkey, {i} AS iter, {_AT.format(seed=16 + i)} < floor(count(*) OVER (PARTITION BY s) * 0.6::DOUBLE) AS is_train FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS s FROM customer)" for i in range(2)))
def _(spark, d):
    return R.subsampling(_holed(spark, d), "c_custkey", 2, 0.6, 16, "s").drop("s")


@C.add(
    "bootstrap_strata",
    f"WITH {_HOLED}, r AS (SELECT c_custkey, s, {_AT.format(seed=18)} AS pos, count(*) OVER (PARTITION BY s) AS n FROM h), d AS (SELECT b AS iter, s, CAST('0x' || substr(md5('18:' || b || ':' || pos), 1, 8) AS BIGINT) % n AS pos FROM r, range(2) u(b)), k AS (SELECT iter, s, pos, count(*) AS draws FROM d GROUP BY ALL) SELECT CAST(b AS INTEGER) AS iter, c_custkey, coalesce(draws, 0) AS draws FROM r CROSS JOIN range(2) u(b) LEFT JOIN k ON k.iter = b AND k.pos = r.pos AND k.s IS NOT DISTINCT FROM r.s",
)
def _(spark, d):
    return R.stratified_bootstrap(_holed(spark, d), "c_custkey", "s", 2, 18)


@C.add("insample", "SELECT r_regionkey, role FROM region, (VALUES ('train'), ('test')) t(role)")
def _(spark, d):
    return R.insample(table(spark, d, "region").select("r_regionkey"))


@C.add("chi2_new_category", "WITH x AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '1995-01-01' THEN '2-HIGH' WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS k, o_orderdate < TIMESTAMP '1995-01-01' AS ref FROM orders), k AS (SELECT k, count(*) FILTER (WHERE ref) AS r, count(*) FILTER (WHERE NOT ref) AS c FROM x GROUP BY 1) SELECT round(sum(pow(c - r - 1e-10, 2) / (r + 1e-10)) / 1e9, 3) AS chi2_e9, count(*) - 1 AS df FROM k")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("ref", F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp"))
    k = F.expr("case when o_orderpriority = '1-URGENT' and ref then '2-HIGH' when o_orderkey % 9 = 0 then null else o_orderpriority end")
    out = D.chi2_categories(o.withColumn("k", k), "k", "ref")
    return out.select(F.round(F.col("chi2") / 1e9, 3).alias("chi2_e9"), "df")


# nearest neighbours


_NEAR = "te AS (SELECT s_suppkey, s_nationkey AS x, s_acctbal / 1000 AS y FROM supplier WHERE s_suppkey % 10 = 0), tr AS (SELECT s_suppkey, s_nationkey AS x, s_acctbal / 1000 AS y, s_acctbal AS v, s_suppkey % 3 AS lab FROM supplier WHERE s_suppkey % 10 <> 0), n AS (SELECT te.s_suppkey AS q, v, lab, {d} AS d FROM tr, te QUALIFY row_number() OVER (PARTITION BY te.s_suppkey ORDER BY {d}, tr.s_suppkey) <= 5)"
_EUCLID, _CITY = "sqrt(pow(tr.x - te.x, 2) + pow(tr.y - te.y, 2))", "abs(tr.x - te.x) + abs(tr.y - te.y)"


def _suppliers(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", "double(s_nationkey) x", "s_acctbal / 1000 y", "s_acctbal v", "s_suppkey % 3 lab")
    return s.filter("s_suppkey % 10 <> 0"), s.filter("s_suppkey % 10 = 0")


@C.add("knn_regression", f"WITH {_NEAR.format(d=_EUCLID)} SELECT q AS s_suppkey, round(avg(v), 6) AS response FROM n GROUP BY q")
def _(spark, d):
    return _rounded(K.knn(*_suppliers(spark, d), "s_suppkey", ["x", "y"], "v", classify=False), "response")


@C.add("knn_weighted", f"WITH {_NEAR.format(d=_EUCLID)} SELECT q AS s_suppkey, round(sum(v * CASE WHEN d > 0 THEN 1 / d ELSE 1e10 END) / sum(CASE WHEN d > 0 THEN 1 / d ELSE 1e10 END), 4) AS response FROM n GROUP BY q")
def _(spark, d):
    return _rounded(K.knn(*_suppliers(spark, d), "s_suppkey", ["x", "y"], "v", classify=False, weights="distance"), "response", digits=4)


@C.add("knn_manhattan", f"WITH {_NEAR.format(d=_CITY)} SELECT q AS s_suppkey, lab AS response FROM (SELECT q, lab, count(*) AS c FROM n GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, lab) = 1")
def _(spark, d):
    return K.knn(*_suppliers(spark, d), "s_suppkey", ["x", "y"], "lab", metric="manhattan")


_VEC = "WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, v.vec_id, {s} AS score FROM v, q WHERE v.vec_id <> q.vec_id) SELECT query_id, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"


@C.add("vector_topk_dot", _VEC.format(s="list_sum([v.v[i] * q.v[i] FOR i IN range(1, 65)])"))
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return _rounded(top_k(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5, "dot"), "score")


@C.add("vector_topk_euclidean", _VEC.format(s="-sqrt(list_sum([pow(v.v[i] - q.v[i], 2) FOR i IN range(1, 65)]))"))
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return _rounded(top_k(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5, "euclidean"), "score")
