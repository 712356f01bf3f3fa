"""Density clustering, neighbour-based feature scores and kernel drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.density import dbscan
from ..operators.information import mutual_info_classif, mutual_info_regr
from ..operators.mmd import frequencies, mmd, multipliers
from ..operators.models import knn
from ..operators.modes import mean_shift
from ..operators.relief import filter_relief, relief, relief_f
from ..sources.readers import table
from .catalogue import Catalogue

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql


def _dbscan_sql(points: str, eps: float, least: int) -> str:
    return f"""
WITH RECURSIVE pts AS ({points}),
near AS (SELECT p.id, q.id AS other FROM pts p, pts q WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= {eps!r} * {eps!r}),
cores AS (SELECT id FROM near GROUP BY id HAVING count(*) >= {least}),
links AS (SELECT n.id, n.other FROM near n JOIN cores a ON a.id = n.id JOIN cores b ON b.id = n.other),
reach AS (SELECT id, id AS label FROM cores UNION SELECT l.other, r.label FROM reach r JOIN links l ON l.id = r.id),
named AS (SELECT id, min(label) AS cluster FROM reach GROUP BY id)
SELECT p.id, coalesce(any_value(own.cluster), min(c.cluster)) AS cluster, any_value(own.cluster) IS NOT NULL AS core
FROM pts p LEFT JOIN named own ON own.id = p.id LEFT JOIN near n ON n.id = p.id LEFT JOIN named c ON c.id = n.other GROUP BY p.id"""


@C.add("dbscan", _dbscan_sql("SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings", 0.02, 5))
def _(spark, d):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return dbscan(x, "id", ["x", "y"], 0.02, 5)


@C.add("dbscan_customers", _dbscan_sql("SELECT c_custkey AS id, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer", 40.0, 16))
def _(spark, d):
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("y"))
    return dbscan(x, "id", ["x", "y"], 40.0, 16)


FEATURES = [f"e{i}" for i in range(1, 7)]
SAMPLES, NEAR = 100, 10


def _features(spark, d):
    own = [F.col("embedding")[i].cast("double").alias(f"e{i + 1}") for i in range(7)]
    return table(spark, d, "embeddings").select("vec_id", "label", *own)


_E = f"(SELECT vec_id, label, {', '.join(f'embedding[{i}]::DOUBLE AS e{i}' for i in range(1, 8))} FROM embeddings)"
_MINMAX = ", ".join(f"(e{i} - min(e{i}) OVER ()) / (max(e{i}) OVER () - min(e{i}) OVER ()) AS e{i}" for i in range(1, 7))
_STANDARD = ", ".join(f"(e{i} - avg(e{i}) OVER ()) / (stddev_pop(e{i}) OVER () + 1e-10) AS e{i}" for i in range(1, 7))


def _near_sql(scaled: str, label: str, same: str) -> str:
    gap = " + ".join(f"(a.e{i} - b.e{i}) * (a.e{i} - b.e{i})" for i in range(1, 7))
    return f"""
WITH scaled AS (SELECT vec_id, {label} AS label, {scaled} FROM {_E}),
own AS (SELECT * FROM scaled ORDER BY md5('0:' || vec_id), vec_id LIMIT {SAMPLES}),
pairs AS (SELECT a.vec_id AS own, b.vec_id AS id, a.label AS own_label, b.label, {same} AS same, {gap} AS d, {', '.join(f'abs(a.e{i} - b.e{i}) AS e{i}' for i in range(1, 7))} FROM own a JOIN scaled b ON b.vec_id <> a.vec_id)"""


def _each_sql(sql: str) -> str:
    return " UNION ALL ".join(sql.format(c=c) for c in FEATURES)


_TOP = f"near AS (SELECT *, row_number() OVER (PARTITION BY own, same ORDER BY d, id) AS place FROM pairs QUALIFY place <= {NEAR})"
_HITS = _each_sql("SELECT '{c}' AS feature, own, avg({c}) FILTER (same) AS hit, avg({c}) FILTER (NOT same) AS miss FROM near GROUP BY own")


@C.add("relief", f"{_near_sql(_MINMAX, 'label', 'a.label = b.label')}, {_TOP}, per AS ({_HITS}) SELECT feature, round(sum(coalesce(miss, 0) - coalesce(hit, 0)) / (SELECT count(*) FROM own), 8) AS score FROM per GROUP BY feature")
def _(spark, d):
    return relief(_features(spark, d), "vec_id", FEATURES, "label", NEAR, SAMPLES).withColumn("score", F.round("score", 8))


@C.add("filter_relief", f"{_near_sql(_STANDARD, 'label', 'a.label = b.label')}, {_TOP}, per AS ({_HITS}), raw AS (SELECT feature, sum(coalesce(miss - hit, 0)) / (SELECT count(*) FROM own) AS s FROM per GROUP BY feature) SELECT feature, round(s - (SELECT min(s) FROM raw), 8) AS score FROM raw")
def _(spark, d):
    return filter_relief(_features(spark, d), "vec_id", FEATURES, "label", NEAR, SAMPLES).withColumn("score", F.round("score", 8))


_MOVED = _each_sql("SELECT '{c}' AS feature, own, avg({c} * abs(own_label - label)) AS vt FROM near GROUP BY own")


@C.add("filter_relief_regr", f"{_near_sql(_STANDARD, 'e7', 'true')}, {_TOP}, per AS ({_MOVED}), raw AS (SELECT feature, -sum(vt) / (SELECT count(*) FROM own) AS s FROM per GROUP BY feature) SELECT feature, round(s - (SELECT min(s) FROM raw), 8) AS score FROM raw")
def _(spark, d):
    return filter_relief(_features(spark, d), "vec_id", FEATURES, "e7", NEAR, SAMPLES, classify=False).withColumn("score", F.round("score", 8))


_F_NEAR = f"near AS (SELECT p.*, 1 / (sqrt(d) + 1e-10) AS w, s.share FROM pairs p JOIN (SELECT label, count(*) / (SELECT count(*) FROM scaled) AS share FROM scaled GROUP BY label) s ON s.label = p.label QUALIFY row_number() OVER (PARTITION BY own ORDER BY d, id) <= {NEAR})"
_GAIN = _each_sql("SELECT '{c}' AS feature, own, sum(w * {c} * CASE WHEN same THEN -1 ELSE share END) / sum(w) AS gain FROM near GROUP BY own")


@C.add("relief_f", f"{_near_sql(_MINMAX, 'label', 'a.label = b.label')}, {_F_NEAR}, per AS ({_GAIN}) SELECT feature, round(sum(gain) / (SELECT count(*) FROM own), 8) AS score FROM per GROUP BY feature")
def _(spark, d):
    return relief_f(_features(spark, d), "vec_id", FEATURES, "label", NEAR, SAMPLES).withColumn("score", F.round("score", 8))


#: Digamma of a whole number.
_PSI = "(-0.5772156649015329 + coalesce(list_sum(list_transform(range(1, ({0})::BIGINT), lambda i: 1 / i)), 0))"
_HELD = ", ".join(f"round(e{i} / (stddev_pop(e{i}) OVER ()) * 1099511627776)::BIGINT AS e{i}" for i in range(1, 8))
_TALL = "held AS (SELECT vec_id, label, " + _HELD + f" FROM {_E}), tall AS (" + " UNION ALL ".join(f"SELECT 'e{i}' AS feature, vec_id, label, e{i} AS v, e7 AS y FROM held" for i in range(1, 5)) + ")"
INFORMED = FEATURES[:4]

_REGR = f"""
WITH {_TALL},
gaps AS (SELECT a.feature, a.vec_id, abs(a.v - b.v) AS dx, abs(a.y - b.y) AS dy, row_number() OVER (PARTITION BY a.feature, a.vec_id ORDER BY greatest(abs(a.v - b.v), abs(a.y - b.y))) AS place FROM tall a JOIN tall b ON b.feature = a.feature),
reach AS (SELECT feature, vec_id, greatest(greatest(dx, dy) - 1, 0) AS r FROM gaps WHERE place = 4),
near AS (SELECT g.feature, g.vec_id, count(*) FILTER (dx <= r) AS nx, count(*) FILTER (dy <= r) AS ny FROM gaps g JOIN reach USING (feature, vec_id) GROUP BY g.feature, g.vec_id)
SELECT feature, round(greatest(0, {_PSI.format("count(*)")} + {_PSI.format("3")} - avg({_PSI.format("nx")} + {_PSI.format("ny")})), 7) AS score FROM near GROUP BY feature"""


@C.add("mutual_info_regr", _REGR)
def _(spark, d):
    return mutual_info_regr(_features(spark, d), "vec_id", INFORMED, "e7").withColumn("score", F.round("score", 7))


_CLASSIF = f"""
WITH {_TALL},
sized AS (SELECT *, count(*) OVER (PARTITION BY feature, label) AS n FROM tall QUALIFY n > 1),
gaps AS (SELECT a.feature, a.vec_id, a.n, least(3, a.n - 1) AS k, abs(a.v - b.v) AS dx, row_number() OVER (PARTITION BY a.feature, a.vec_id ORDER BY abs(a.v - b.v)) AS place FROM sized a JOIN sized b ON b.feature = a.feature AND b.label = a.label),
reach AS (SELECT feature, vec_id, n, k, greatest(dx - 1, 0) AS r FROM gaps WHERE place = k + 1),
near AS (SELECT a.feature, a.vec_id, any_value(r.n) AS n, any_value(r.k) AS k, count(*) FILTER (abs(a.v - b.v) <= r.r) AS m FROM sized a JOIN reach r USING (feature, vec_id) JOIN sized b ON b.feature = a.feature GROUP BY a.feature, a.vec_id)
SELECT feature, round(greatest(0, {_PSI.format("count(*)")} + avg({_PSI.format("k")}) - avg({_PSI.format("n")}) - avg({_PSI.format("m")})), 7) AS score FROM near GROUP BY feature"""


@C.add("mutual_info_classif", _CLASSIF)
def _(spark, d):
    return mutual_info_classif(_features(spark, d), "vec_id", INFORMED, "label").withColumn("score", F.round("score", 7))


#: Kernel width, frequencies and permutations of the drift queries.
GAMMA, WAVES, DRAWS = 8.0, 32, 40
_SIDES = f"rows_ AS (SELECT vec_id, label < 5 AS ref, e1, e2, e3, e4, ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT % 2147483647 AS h FROM {_E})"
_HASHES = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(multipliers(DRAWS).tolist()))
_WAVES = ", ".join(f"({j}, {', '.join(map(repr, w))})" for j, w in enumerate(frequencies(4, WAVES, GAMMA).tolist()))
_RBF = f"""
WITH {_SIDES},
marked AS (SELECT *, -1 AS draw, ref AS own FROM rows_ UNION ALL
 SELECT r.*, p.draw, (r.h * p.a + p.b) % 2147483647 < (SELECT avg(ref::INTEGER) FROM rows_) * 2147483647 FROM rows_ r, (VALUES {_HASHES}) p(draw, a, b)),
turned AS (SELECT w.j, draw, own, cos(t) AS c, sin(t) AS s FROM (SELECT m.draw, m.own, w.j, m.e1 * w.w1 + m.e2 * w.w2 + m.e3 * w.w3 + m.e4 * w.w4 AS t FROM marked m, (VALUES {_WAVES}) w(j, w1, w2, w3, w4)) w),
gaps AS (SELECT draw, j, (avg(c) FILTER (own) - avg(c) FILTER (NOT own)) ** 2 + (avg(s) FILTER (own) - avg(s) FILTER (NOT own)) ** 2 AS g FROM turned GROUP BY draw, j),
found AS (SELECT draw, avg(g) AS statistic, stddev_pop(g) / sqrt({WAVES}) AS error FROM gaps GROUP BY draw)
SELECT round(f.statistic, 9) AS statistic, round(f.error, 9) AS error, (SELECT avg((p.statistic >= f.statistic)::INTEGER) FROM found p WHERE p.draw >= 0) AS p_value,
 (SELECT avg((p.statistic >= f.statistic)::INTEGER) FROM found p WHERE p.draw >= 0) < 0.05 AS is_drift, (SELECT count(*) FROM rows_ WHERE ref) AS n_reference, (SELECT count(*) FROM rows_ WHERE NOT ref) AS n_current
FROM found f WHERE f.draw = -1"""


@C.add("mmd_rbf", _RBF)
def _(spark, d):
    x = _features(spark, d)
    found = mmd(x.filter("label < 5"), x.filter("label >= 5"), "vec_id", INFORMED, gamma=GAMMA, count=WAVES, permutations=DRAWS)
    return found.withColumns({c: F.round(c, 9) for c in ("statistic", "error")})


_PAIRS = f"""
WITH {_SIDES},
pairs AS (SELECT a.ref AS x, b.ref AS y, (1 + a.e1 * b.e1 + a.e2 * b.e2 + a.e3 * b.e3 + a.e4 * b.e4) ** 3 AS k FROM rows_ a, rows_ b)
SELECT round(avg(k) FILTER (x AND y) + avg(k) FILTER (NOT x AND NOT y) - 2 * avg(k) FILTER (x AND NOT y), 9) AS statistic FROM pairs"""


@C.add("mmd_polynomial", _PAIRS)
def _(spark, d):
    x = _features(spark, d)
    found = mmd(x.filter("label < 5"), x.filter("label >= 5"), "vec_id", INFORMED, "polynomial", permutations=0)
    return found.select(F.round("statistic", 9).alias("statistic"))


_GAPS = "SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_nationkey::DOUBLE END AS x, CASE WHEN s_suppkey % 20 <> 10 THEN s_acctbal / 1000 END AS y, CASE WHEN s_suppkey % 11 <> 1 THEN s_acctbal END AS v FROM supplier"
_KNN = f"""
WITH s AS ({_GAPS}), te AS (SELECT * FROM s WHERE s_suppkey % 10 = 0),
n AS (SELECT te.s_suppkey AS q, tr.v FROM s tr, te WHERE tr.s_suppkey % 10 <> 0 AND tr.v IS NOT NULL AND sqrt(pow(tr.x - te.x, 2) + pow(tr.y - te.y, 2)) IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY te.s_suppkey ORDER BY sqrt(pow(tr.x - te.x, 2) + pow(tr.y - te.y, 2)), tr.s_suppkey) <= 5)
SELECT te.s_suppkey, round(avg(n.v), 6) AS response FROM te LEFT JOIN n ON n.q = te.s_suppkey GROUP BY te.s_suppkey"""


@C.add("knn_nulls", _KNN)
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", "if(s_suppkey % 7 <> 0, double(s_nationkey), null) x", "if(s_suppkey % 20 <> 10, s_acctbal / 1000, null) y", "if(s_suppkey % 11 <> 1, s_acctbal, null) v")
    found = knn(s.filter("s_suppkey % 10 <> 0"), s.filter("s_suppkey % 10 = 0"), "s_suppkey", ["x", "y"], "v", classify=False)
    return found.withColumn("response", F.round("response", 6))


def _shift_sql(points: str, width: float) -> str:
    far = f"<= {width!r}::DOUBLE * {width!r}::DOUBLE"
    return f"""WITH RECURSIVE p AS ({points}), s AS (SELECT DISTINCT round(x / {width!r}::DOUBLE) * {width!r}::DOUBLE AS x, round(y / {width!r}::DOUBLE) * {width!r}::DOUBLE AS y FROM p),
m AS (SELECT x AS sx, y AS sy, x, y, 0::BIGINT AS n, false AS stays FROM s UNION ALL
SELECT sx, sy, avg(p.x), avg(p.y), count(*), pow(avg(p.x) - any_value(m.x), 2) + pow(avg(p.y) - any_value(m.y), 2) <= pow(0.001::DOUBLE * {width!r}::DOUBLE, 2) FROM m JOIN p ON pow(p.x - m.x, 2) + pow(p.y - m.y, 2) {far} WHERE NOT stays GROUP BY sx, sy),
e AS (SELECT list({{'n': n, 'x': x, 'y': y}} ORDER BY n DESC, x DESC, y DESC) AS l FROM (SELECT max(n) AS n, x, y FROM m WHERE stays GROUP BY x, y)),
k AS (SELECT list_reduce(l, lambda a, b: CASE WHEN len([c FOR c IN a IF pow(c.x - b[1].x, 2) + pow(c.y - b[1].y, 2) {far}]) > 0 THEN a ELSE list_concat(a, b) END) AS l FROM (SELECT [[c] FOR c IN l] AS l FROM e)),
c AS (SELECT i - 1 AS cluster, l[i] AS c FROM k, range(1, 100000) t(i) WHERE i <= len(l))
SELECT id, cluster FROM p, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY pow(p.x - c.c.x, 2) + pow(p.y - c.c.y, 2), cluster) = 1"""


@C.add("mean_shift", _shift_sql("SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings", 0.15))
def _(spark, d):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return mean_shift(x, "id", ["x", "y"], 0.15)[0]
