"""Drift, monitoring and A/B statistics: January's first half against its second."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..sources.readers import table
from .catalogue import Catalogue

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql


def _halves(spark, d):
    return table(spark, d, "events").withColumn("ref", F.col("ts") < F.lit("2024-01-16").cast("timestamp"))


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_EV = "ev AS (SELECT *, ts < TIMESTAMP '2024-01-16' AS ref FROM events)"
_BINS = f"{_EV}, e AS (SELECT {{g}} quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM ev WHERE ref {{gb}}), k AS (SELECT {{g}} len([y FOR y IN q IF y <= value]) AS bin, count(*) FILTER (WHERE ref) AS r, count(*) FILTER (WHERE NOT ref) AS c FROM ev {{join}} GROUP BY {{g}} 2)"
_PSI = f"""WITH {_BINS.format(g="event_type,", gb="GROUP BY event_type", join="JOIN e USING (event_type)")},
s AS (SELECT *, r / CAST(sum(r) OVER w AS DOUBLE) AS p, c / CAST(sum(c) OVER w AS DOUBLE) AS o, sum(r) OVER w AS nr, sum(c) OVER w AS nc FROM k WINDOW w AS (PARTITION BY event_type)),
f AS (SELECT event_type, sum((o - p) * ln((o + 1e-10) / (p + 1e-10))) AS psi, CAST(max(nr) AS BIGINT) AS n_reference, CAST(max(nc) AS BIGINT) AS n_current FROM s GROUP BY event_type)
SELECT event_type, round(psi, 6) AS psi, n_reference, n_current, CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.25 THEN 'moderate' ELSE 'large' END AS band FROM f"""


@C.add("psi_value", _PSI)
def _(spark, d):
    return _rounded(D.psi(_halves(spark, d), "value", "ref", ["event_type"]), "psi")


_WIDTH = f"""{_EV}, e AS (SELECT min(value) AS lo, max(value) AS hi FROM ev WHERE ref), k AS (SELECT len([i FOR i IN [1,2,3,4,5,6,7,8,9] IF lo + (hi - lo) * i / 10.0::DOUBLE <= value]) AS bin, count(*) FILTER (WHERE ref) AS r, count(*) FILTER (WHERE NOT ref) AS c FROM ev, e GROUP BY 1),
s AS (SELECT (r + 1e-10) / sum(r + 1e-10) OVER () AS a, (c + 1e-10) / sum(c + 1e-10) OVER () AS b, r, c FROM k)"""


@C.add("psi_smoothed", f"WITH {_WIDTH} SELECT round(sum((b - a) * ln(b / a)), 6) AS psi FROM s")
def _(spark, d):
    return _rounded(D.psi_smoothed(_halves(spark, d), "value", "ref"), "psi")


@C.add(
    "divergences",
    f"WITH {_WIDTH} SELECT round(sum((b - a) * ln(b / a)), 6) AS psi, round(sum(a * ln(a / b)), 6) AS kl, round(sum(a * ln(2 * a / (a + b)) / 2 + b * ln(2 * b / (a + b)) / 2), 6) AS js, round(sqrt(greatest(0.0::DOUBLE, 1 - sum(sqrt(a * b)))), 6) AS hellinger, round(sum(abs(a - b)) / 2, 6) AS total_variation, round(sum(pow(c - r, 2) / (r + 1e-10)), 6) AS chi2 FROM s",
)
def _(spark, d):
    counts = D.bin_counts(_halves(spark, d), "value", "ref", equal_width=True)
    return _rounded(D.divergences(counts, "r", "c"), "psi", "kl", "js", "hellinger", "total_variation", "chi2")


_CDF = f"WITH {_EV}, v AS (SELECT value AS v, count(*) FILTER (WHERE ref) AS r, count(*) FILTER (WHERE NOT ref) AS c FROM ev GROUP BY 1), g AS (SELECT *, sum(r) OVER (ORDER BY v) / CAST(sum(r) OVER () AS DOUBLE) AS f, sum(c) OVER (ORDER BY v) / CAST(sum(c) OVER () AS DOUBLE) AS g, lead(v) OVER (ORDER BY v) AS nx, sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM v)"


@C.add(
    "two_sample",
    f"{_CDF} SELECT round(max(abs(f - g)), 6) AS ks, round(sum(abs(f - g) * (coalesce(nx, v) - v)), 6) AS wasserstein, CAST(max(nr) AS BIGINT) AS n_reference, CAST(max(nc) AS BIGINT) AS n_current, round(sum((f - g) * (f - g) * (r + c)) * CAST(max(nr) AS DOUBLE) * max(nc) / pow(CAST(max(nr) + max(nc) AS DOUBLE), 2), 6) AS cramer_von_mises FROM g",
)
def _(spark, d):
    return _rounded(D.two_sample(_halves(spark, d), "value", "ref"), "ks", "wasserstein", "cramer_von_mises")


@C.add("chi2_categories", f"WITH {_EV}, k AS (SELECT event_type, count(*) FILTER (WHERE ref) AS r, count(*) FILTER (WHERE NOT ref) AS c FROM ev GROUP BY 1) SELECT round(sum(pow(c - r, 2) / r), 6) AS chi2, count(*) - 1 AS df FROM k")
def _(spark, d):
    return _rounded(D.chi2_categories(_halves(spark, d), "event_type", "ref"), "chi2")


_HOLE = "(SELECT CASE WHEN event_id % 8 <> 0 THEN value END AS holed, value FROM events)"


@C.add(
    "quality_alerts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS missing_rate, round(count(*) FILTER (WHERE abs({c} - m) > 3.0 * s) / CAST(count({c}) AS DOUBLE), 6) AS outlier_rate, (count(*) - count({c})) / CAST(count(*) AS DOUBLE) > 0.1 AS missing_alert, count(*) FILTER (WHERE abs({c} - m) > 3.0 * s) / CAST(count({c}) AS DOUBLE) > 0.01 AS outlier_alert FROM {_HOLE}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {_HOLE})"
        for c in ("holed", "value")
    ),
)
def _(spark, d):
    e = table(spark, d, "events").selectExpr("case when event_id % 8 <> 0 then value end holed", "value")
    return _rounded(D.quality_alerts(e, ["holed", "value"]), "missing_rate", "outlier_rate")


@C.add(
    "ab_ttest",
    """WITH s AS (SELECT user_id % 2 AS g, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), o AS (SELECT max(n) FILTER (WHERE g = 0) AS n0, max(n) FILTER (WHERE g = 1) AS n1, max(m) FILTER (WHERE g = 0) AS m0, max(m) FILTER (WHERE g = 1) AS m1, max(v) FILTER (WHERE g = 0) AS v0, max(v) FILTER (WHERE g = 1) AS v1 FROM s)
SELECT n0 AS n_control, n1 AS n_treatment, round(m0, 6) AS mean_control, round(m1, 6) AS mean_treatment, round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0::DOUBLE / n0 + 1.0::DOUBLE / n1)), 6) AS t_statistic, round(100.0::DOUBLE * (m1 - m0) / abs(m0), 6) AS lift_percent FROM o""",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("variant", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    return _rounded(D.ab_test(e, "variant", "value", "a", "b"), "mean_control", "mean_treatment", "t_statistic", "lift_percent")


@C.add(
    "variant_summary",
    "SELECT user_id % 3 AS variant, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, round(1 - count(*) FILTER (WHERE event_type = 'error') / CAST(count(*) AS DOUBLE), 6) AS success_rate, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_pop, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("arm", F.col("user_id") % 3).withColumn("failed", F.col("event_type") == "error")
    return _rounded(D.variant_summary(e, "arm", "value", "failed"), "success_rate", "mean", "std_pop", "median")
