"""Measures on simple predictions: order status by price, price by line totals, toxicity by quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import measures as M
from ..sources.readers import table
from .catalogue import Catalogue

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# A made-up rule on real columns: status by price band; and a probability.
_RULE = "CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 300000 THEN 'O' ELSE 'P' END"
_PRED = f"pred AS (SELECT o_orderkey, o_orderstatus AS truth, {_RULE} AS response, round(1.0::DOUBLE / (1.0::DOUBLE + o_totalprice / 200000.0::DOUBLE), 3) AS prob, o_orderpriority AS grp FROM orders)"


def _pred(spark, d):
    p = F.round(F.lit(1.0) / (F.lit(1.0) + F.col("o_totalprice") / F.lit(200000.0)), 3)
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("truth"), F.expr(_RULE).alias("response"), p.alias("prob"), F.col("o_orderpriority").alias("grp"))


@C.add("acc_ce", f"WITH {_PRED} SELECT grp, count(*) AS n, round(avg(CASE WHEN truth = response THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc, round(1 - avg(CASE WHEN truth = response THEN 1.0::DOUBLE ELSE 0 END), 6) AS ce FROM pred GROUP BY grp")
def _(spark, d):
    return _rounded(M.accuracy(_pred(spark, d), "truth", "response", ["grp"]), "acc", "ce")


@C.add("confusion", f"WITH {_PRED} SELECT truth, response, count(*) AS n FROM pred GROUP BY 1, 2")
def _(spark, d):
    return M.confusion(_pred(spark, d), "truth", "response")


_CLASS = f"WITH {_PRED}, l AS (SELECT DISTINCT truth AS label FROM pred), k AS (SELECT label, count(*) FILTER (WHERE truth = label) AS support, count(*) FILTER (WHERE response = label) AS predicted, count(*) FILTER (WHERE truth = label AND response = label) AS hits FROM pred, l GROUP BY label), r AS (SELECT *, hits / CAST(predicted AS DOUBLE) AS precision, hits / CAST(support AS DOUBLE) AS recall, 2 * hits / CAST(support + predicted AS DOUBLE) AS f1 FROM k)"


@C.add("precision_recall_f1", f"{_CLASS} SELECT label, support, predicted, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r")
def _(spark, d):
    return _rounded(M.per_class(_pred(spark, d), "truth", "response"), "precision", "recall", "f1")


@C.add(
    "bacc_mcc",
    f"{_CLASS} SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(hits) / CAST(sum(support) AS DOUBLE), 6) AS acc, round(avg(recall), 6) AS bacc, round((sum(hits) * sum(support) - sum(predicted * support)) / sqrt(CAST((sum(support) * sum(support) - sum(predicted * predicted)) * (sum(support) * sum(support) - sum(support * support)) AS DOUBLE)), 6) AS mcc, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM r",
)
def _(spark, d):
    return _rounded(M.multiclass(_pred(spark, d), "truth", "response"), "acc", "bacc", "mcc", "precision", "recall", "f1")


_R = {"tpr": "tp / (tp + fn)", "fpr": "fp / (fp + tn)", "tnr": "tn / (fp + tn)", "fnr": "fn / (tp + fn)", "ppv": "tp / (tp + fp)", "npv": "tn / (tn + fn)", "fdr": "fp / (tp + fp)", "fomr": "fn / (tn + fn)", "dor": "tp * tn / (fp * fn)", "f1": "2 * tp / (2 * tp + fp + fn)"}


@C.add(
    "roc_rates",
    f"WITH {_PRED}, c AS (SELECT count(*) FILTER (WHERE truth = 'F' AND response = 'F') AS tp, count(*) FILTER (WHERE truth <> 'F' AND response = 'F') AS fp, count(*) FILTER (WHERE truth = 'F' AND response <> 'F') AS fn, count(*) FILTER (WHERE truth <> 'F' AND response <> 'F') AS tn FROM pred), x AS (SELECT tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn FROM c) SELECT c.tp, c.fp, c.fn, c.tn, "
    + ", ".join(f"(SELECT round({v}, 6) FROM x) AS {k}" for k, v in _R.items()) + " FROM c",
)
def _(spark, d):
    return _rounded(M.binary_rates(_pred(spark, d), F.col("truth") == "F", F.col("response") == "F"), *_R)


@C.add(
    "auc_logloss",
    f"""WITH {_PRED}, v AS (SELECT prob AS s, count(*) FILTER (WHERE truth = 'F') AS pos, count(*) FILTER (WHERE truth <> 'F') AS neg FROM pred GROUP BY 1),
r AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM v)
SELECT CAST(max(P + N) AS BIGINT) AS n, round(sum(pos * (N - fp + neg / 2.0::DOUBLE)) / CAST(max(P) * max(N) AS DOUBLE), 6) AS auc, round(sum(pos * tp / CAST(tp + fp AS DOUBLE)) / CAST(max(P) AS DOUBLE), 6) AS prauc, round(-sum(pos * ln(s) + neg * ln(1 - s)) / CAST(max(P + N) AS DOUBLE), 6) AS logloss, round(sum(pos * pow(1 - s, 2) + neg * pow(s, 2)) / CAST(max(P + N) AS DOUBLE), 6) AS bbrier FROM r""",
)
def _(spark, d):
    return _rounded(M.scores(_pred(spark, d), F.col("truth") == "F", "prob"), "auc", "prauc", "logloss", "bbrier")


_COSTS = [("F", "O", 1.0), ("F", "P", 2.5), ("O", "F", 0.5), ("P", "F", 4.0)]


@C.add("costs", f"WITH {_PRED}, c(t, r, cost) AS (VALUES {', '.join(f'({chr(39)}{t}{chr(39)}, {chr(39)}{r}{chr(39)}, {v}::DOUBLE)' for t, r, v in _COSTS)}) SELECT round(sum(coalesce(cost, 0)), 6) AS total, round(avg(coalesce(cost, 0)), 6) AS mean FROM pred LEFT JOIN c ON truth = t AND response = r")
def _(spark, d):
    return _rounded(M.costs(_pred(spark, d), "truth", "response", spark.createDataFrame(_COSTS, "truth string, response string, cost double")), "total", "mean")


_REG = "reg AS (SELECT l_returnflag AS g, l_extendedprice AS t, l_quantity * 1500 + 800 * l_discount AS p FROM lineitem)"
_E = "reg2 AS (SELECT *, p - t AS e, abs(p - t) AS ae, avg(t) OVER (PARTITION BY g) AS m FROM reg)"
_REG_MEASURES = {
    "bias": "avg(e)", "pbias": "avg((t - p) / nullif(abs(t), 0))", "mse": "avg(e * e)", "rmse": "sqrt(avg(e * e))", "mae": "avg(ae)", "medae": "quantile_cont(ae, 0.5)",
    "medse": "quantile_cont(e * e, 0.5)", "maxae": "max(ae)", "sae": "sum(ae)", "mape": "100 * avg(CASE WHEN abs(t) > 1e-8 THEN ae / abs(t) END)",
    "smape": "avg(2 * ae / nullif(abs(t) + abs(p), 0))", "msle": "avg(CASE WHEN t >= 0 AND p >= 0 THEN pow(ln(1 + p) - ln(1 + t), 2) END)",
    "rmsle": "sqrt(avg(CASE WHEN t >= 0 AND p >= 0 THEN pow(ln(1 + p) - ln(1 + t), 2) END))", "rsq": "1 - sum(e * e) / sum(pow(t - m, 2))",
}
_DIGITS = {"mse": 0, "medse": 0, "sae": 0, "sse": -4, "maxae": 4, "rmse": 3, "mae": 3, "medae": 3, "bias": 3, "rmsle": 5, "msle": 5}


@C.add("regr_all", f"WITH {_REG}, {_E} SELECT g, count(*) AS n, " + ", ".join(f"round({v}, {_DIGITS.get(k, 5)}) AS {k}" for k, v in _REG_MEASURES.items()) + " FROM reg2 GROUP BY g")
def _(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("t0"), (F.col("l_quantity") * 1500 + 800 * F.col("l_discount")).alias("p0"))
    out = M.regression(r, "t0", "p0", ["g"]).drop("sse")
    return out.withColumns({k: F.round(k, _DIGITS.get(k, 5)) for k in _REG_MEASURES})


@C.add("pinball", f"WITH {_REG} SELECT round(avg(greatest(0.9::DOUBLE * (t - p), (0.9::DOUBLE - 1) * (t - p))), 4) AS pinball FROM reg")
def _(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500 + 800 * F.col("l_discount")).alias("p"))
    return _rounded(M.pinball(r, "t", "p", 0.9), "pinball", digits=4)


_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"


@C.add("spearman", f"WITH r AS (SELECT {_RANK.format(c='l_quantity')} AS x, {_RANK.format(c='l_extendedprice')} AS y FROM lineitem) SELECT round(corr(x, y), 6) AS srho FROM r")
def _(spark, d):
    return _rounded(M.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), "srho")


@C.add(
    "kendall",
    """WITH v AS (SELECT p_size AS x, length(p_type) AS y, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT sum(n) AS n FROM v),
s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y) * a.n * b.n) AS s FROM v a JOIN v b ON a.x < b.x),
tx AS (SELECT sum(k * (k - 1) / 2.0::DOUBLE) AS t FROM (SELECT sum(n) AS k FROM v GROUP BY x)), ty AS (SELECT sum(k * (k - 1) / 2.0::DOUBLE) AS t FROM (SELECT sum(n) AS k FROM v GROUP BY y))
SELECT round(s / sqrt((t.n * (t.n - 1) / 2.0::DOUBLE - tx.t) * (t.n * (t.n - 1) / 2.0::DOUBLE - ty.t)), 6) AS ktau FROM s, t, tx, ty""",
)
def _(spark, d):
    return _rounded(M.kendall(table(spark, d, "part").withColumn("len", F.length("p_type")), "p_size", "len"), "ktau")


_F = "SELECT lang AS g, quality = 1 AS t, n_chars >= 1000 AS p FROM documents JOIN labels USING (doc_id)"


@C.add(
    "fairness_groups",
    f"""WITH x AS ({_F}), g AS (SELECT g AS "group", count(*) AS n, avg(CASE WHEN p THEN 1.0::DOUBLE ELSE 0 END) AS positive_rate, avg(CASE WHEN t THEN CASE WHEN p THEN 1.0::DOUBLE ELSE 0 END END) AS tpr, avg(CASE WHEN NOT t THEN CASE WHEN p THEN 1.0::DOUBLE ELSE 0 END END) AS fpr, avg(CASE WHEN t = p THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM x GROUP BY 1),
b AS (SELECT positive_rate AS p, tpr AS t, fpr AS f FROM g ORDER BY positive_rate DESC, "group" LIMIT 1)
SELECT "group", n, round(positive_rate, 6) AS positive_rate, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(acc, 6) AS acc, round(positive_rate - p, 6) AS demographic_parity, round(tpr - t, 6) AS equal_opportunity, round(greatest(abs(tpr - t), abs(fpr - f)), 6) AS equalized_odds, round(positive_rate / p, 6) AS disparate_impact FROM g, b""",
)
def _(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    out = M.fairness(x, "lang", F.col("quality") == 1, F.col("n_chars") >= 1000)
    return _rounded(out, "positive_rate", "tpr", "fpr", "acc", "demographic_parity", "equal_opportunity", "equalized_odds", "disparate_impact")


@C.add(
    "data_bias_kl",
    """WITH k AS (SELECT o_orderpriority AS g, o_orderstatus AS l, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY g) AS ng, sum(n) OVER (PARTITION BY l) AS nl, sum(n) OVER () AS nn FROM k)
SELECT g AS "group", CAST(max(ng) AS BIGINT) AS n, round(max(ng / nn::DOUBLE), 6) AS share, round(max(ng * (SELECT count(DISTINCT g) FROM k) / nn::DOUBLE), 6) AS representation, round(sum(nl / nn::DOUBLE * ln(nl / nn::DOUBLE / (n / ng::DOUBLE))), 6) AS kl FROM s GROUP BY g""",
)
def _(spark, d):
    return _rounded(M.data_bias(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus"), "share", "representation", "kl")
