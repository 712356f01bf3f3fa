"""Evaluation measures as aggregates over predictions.

Predictions are rows with a truth and a response (or a score); rows where either
is null don't count. Functions take column names and return one row, unless
they say otherwise; ``by`` groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import cell_of, cumulative, mid_ranks, with_quantiles


def _both(df: DataFrame, t: str, p: str) -> DataFrame:
    return df.filter(F.col(t).isNotNull() & F.col(p).isNotNull())


def accuracy(df: DataFrame, truth: str, response: str, by: Sequence[str] = ()) -> DataFrame:
    hit = (F.col(truth) == F.col(response)).cast("double")
    return _both(df, truth, response).groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit).alias("acc"), (1 - F.avg(hit)).alias("ce"))


def confusion(df: DataFrame, truth: str, response: str) -> DataFrame:
    """(truth, response, n)."""
    return _both(df, truth, response).groupBy(F.col(truth).alias("truth"), F.col(response).alias("response")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, truth: str, response: str) -> DataFrame:
    """(label, support, predicted, hits, precision, recall, f1) of every label; 0 where undefined."""
    c = confusion(df, truth, response)
    sides = c.select(F.col("truth").alias("label"), F.col("n").alias("s"), F.lit(0).alias("p"), F.when(F.col("truth") == F.col("response"), F.col("n")).otherwise(0).alias("h"))
    sides = sides.unionByName(c.select(F.col("response").alias("label"), F.lit(0).alias("s"), F.col("n").alias("p"), F.lit(0).alias("h")))
    k = sides.groupBy("label").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return k.select(
        "*", ratio("hits", "predicted").alias("precision"), ratio("hits", "support").alias("recall"),
        ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def multiclass(df: DataFrame, truth: str, response: str) -> DataFrame:
    """n, acc, bacc, mcc and the support-weighted precision, recall and f1."""
    k = per_class(df, truth, response)
    w = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    # Products of four counts pass 64 bits from some 70,000 rows on.
    big = lambda x: x.cast("decimal(19,0)")
    both = lambda a, b: F.sum(big(F.col(a)) * big(F.col(b)))
    s, c = F.sum("support"), F.sum("hits")
    pt, pp, tt = both("predicted", "support"), both("predicted", "predicted"), both("support", "support")
    low = F.sqrt((big(s) * big(s) - pp).cast("double") * (big(s) * big(s) - tt).cast("double"))
    return k.agg(
        s.alias("n"), F.try_divide(c, s).alias("acc"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("bacc"),
        F.coalesce(F.try_divide((big(c) * big(s) - pt).cast("double"), low), F.lit(0.0)).alias("mcc"), w("precision").alias("precision"), w("recall").alias("recall"), w("f1").alias("f1"),
    )


def binary_rates(df: DataFrame, truth: Column, response: Column) -> DataFrame:
    """The rates of one two-by-two table; ``truth`` and ``response`` are booleans."""
    c = df.select(truth.alias("t"), response.alias("p")).filter("t is not null and p is not null").agg(
        F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"),
        F.count_if(F.col("t") & ~F.col("p")).alias("fn"), F.count_if(~F.col("t") & ~F.col("p")).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    d = F.try_divide
    return c.select(
        "tp", "fp", "fn", "tn", d(tp, tp + fn).alias("tpr"), d(fp, fp + tn).alias("fpr"), d(tn, fp + tn).alias("tnr"), d(fn, tp + fn).alias("fnr"),
        d(tp, tp + fp).alias("ppv"), d(tn, tn + fn).alias("npv"), d(fp, tp + fp).alias("fdr"), d(fn, tn + fn).alias("fomr"), d(tp * tn, fp * fn).alias("dor"),
        d(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def scores(df: DataFrame, positive: Column, score: str, eps: float = 1e-15) -> DataFrame:
    """auc (ties count half), prauc (average precision), logloss and bbrier of a probability."""
    rows = df.select(positive.cast("long").alias("y"), F.col(score).cast("double").alias("s")).filter("y is not null and s is not null")
    values = rows.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    run = cumulative(values.withColumn("_down", -F.col("s")), "_down", {"tp": "pos", "fp": "neg"})
    total = values.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    run = run.crossJoin(F.broadcast(total))  # one row
    won = F.sum(F.col("pos") * (F.col("N") - F.col("fp") + F.col("neg") / F.lit(2.0)))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    p = F.least(F.greatest(F.col("s"), F.lit(eps)), F.lit(1 - eps))
    n = F.max(F.col("P") + F.col("N"))
    return run.agg(
        n.alias("n"), F.try_divide(won, (F.max("P") * F.max("N")).cast("double")).alias("auc"), F.try_divide(ap, F.max("P").cast("double")).alias("prauc"),
        (-F.sum(F.col("pos") * F.ln(p) + F.col("neg") * F.ln(1 - p)) / n).alias("logloss"),
        (F.sum(F.col("pos") * F.pow(1 - F.col("s"), F.lit(2)) + F.col("neg") * F.pow("s", F.lit(2))) / n).alias("bbrier"),
    )


def class_auc(df: DataFrame, truth: str, probabilities: dict[str, str]) -> DataFrame:
    """(label, n, auc) of each label's probability column against the rest, and with it aunu and aunp by averaging."""
    out = None
    for label, column in probabilities.items():
        one = scores(df, F.col(truth) == label, column).select(F.lit(label).alias("label"), "auc")
        support = df.agg(F.count_if(F.col(truth) == label).alias("n"))
        one = one.crossJoin(F.broadcast(support))  # one row
        out = one if out is None else out.unionByName(one)
    return out


def costs(df: DataFrame, truth: str, response: str, table: DataFrame) -> DataFrame:
    """Total and mean cost; ``table`` has truth, response and cost."""
    c = confusion(df, truth, response).join(table, ["truth", "response"], "left")
    return c.agg(F.sum(F.col("n") * F.coalesce("cost", F.lit(0.0))).alias("total"), (F.sum(F.col("n") * F.coalesce("cost", F.lit(0.0))) / F.sum("n")).alias("mean"))


def regression(df: DataFrame, truth: str, response: str, by: Sequence[str] = (), eps: float = 1e-8) -> DataFrame:
    """n, bias, pbias, mse, rmse, mae, medae, medse, maxae, sae, sse, mape, smape, msle, rmsle and rsq.

    The mean of truth comes first, so that rsq sums squares around it."""
    rows = _both(df.select(*by, F.col(truth).cast("double").alias("t"), F.col(response).cast("double").alias("p")), "t", "p")
    mean = rows.groupBy(*by).agg(F.avg("t").alias("_m"))
    rows = rows.join(mean, list(by)) if by else rows.crossJoin(F.broadcast(mean))  # one row
    e, ae = F.col("p") - F.col("t"), F.abs(F.col("p") - F.col("t"))
    log_ok = (F.col("t") >= 0) & (F.col("p") >= 0)
    se_log = F.pow(F.log1p("p") - F.log1p("t"), F.lit(2))
    sse, sst = F.sum(e * e), F.sum(F.pow(F.col("t") - F.col("_m"), F.lit(2)))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(e).alias("bias"), F.avg(F.try_divide(F.col("t") - F.col("p"), F.abs("t"))).alias("pbias"), F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(ae).alias("mae"),
        F.max(ae).alias("maxae"), F.sum(ae).alias("sae"), sse.alias("sse"), (100 * F.avg(F.when(F.abs("t") > eps, ae / F.abs("t")))).alias("mape"),
        F.avg(F.try_divide(2 * ae, F.abs("t") + F.abs("p"))).alias("smape"), F.avg(F.when(log_ok, se_log)).alias("msle"), F.sqrt(F.avg(F.when(log_ok, se_log))).alias("rmsle"),
        F.when(F.count("*") > 1, 1 - F.try_divide(sse, sst)).alias("rsq"),
    )
    return with_quantiles(with_quantiles(out, ae, {"medae": 0.5}, by, rows), e * e, {"medse": 0.5}, by, rows)


def pinball(df: DataFrame, truth: str, response: str, alpha: float = 0.5) -> DataFrame:
    e = F.col(truth) - F.col(response)
    return _both(df, truth, response).agg(F.avg(F.greatest(alpha * e, (alpha - 1) * e)).alias("pinball"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """srho: the correlation of average ranks."""
    rows = mid_ranks(mid_ranks(_both(df, x, y), x, "_rx"), y, "_ry")
    return rows.agg(F.corr("_rx", "_ry").alias("srho"))


def _signed_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Sum over pairs of distinct points (x, y), n times each, of the signs of both differences.

    In the order of x, a pair's sign shows at the highest bit in which the ranks of y differ;
    pairs of equal x count as rising there and are taken off at the end."""
    order = np.lexsort((rows["y"].to_numpy(), rows["x"].to_numpy()))
    x, w = rows["x"].to_numpy()[order], rows["n"].to_numpy()[order].astype(float)
    rank = np.unique(rows["y"].to_numpy()[order], return_inverse=True)[1]
    total = 0.0
    for bit in range(int(rank.max()).bit_length()):
        upper = rank >> (bit + 1)
        o = np.argsort(upper, kind="stable")
        one, k, first = (rank[o] >> bit) & 1, w[o], np.searchsorted(upper[o], upper[o])
        zeros, ones = np.cumsum(k * (1 - one)) - k * (1 - one), np.cumsum(k * one) - k * one
        total += float(np.sum(k * np.where(one == 1, zeros - zeros[first], ones[first] - ones)))
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    total -= float(np.sum(np.add.reduceat(w, starts) ** 2 - np.add.reduceat(w * w, starts))) / 2
    return pd.DataFrame({"s": [total]})


def kendall(df: DataFrame, x: str, y: str, per_cell: int = 50_000) -> DataFrame:
    """ktau (tau-b) of two columns, compared as doubles, in time n log n.

    Pairs of values are counted first. Both axes are cut into cells of about ``per_cell``
    pairs of values, at most 1,024: pairs in different columns and rows of this grid are
    compared by the grid's counts alone, the others within a column or a row, less those
    counted twice within one field. A column or row of one value has no pair to compare."""
    v = _both(df, x, y).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("n"))
    cells = max(1, min(1024, -(-v.count() // per_cell)))
    if cells == 1:
        parts = v.withColumn("g", F.lit("all")).withColumn("f", F.lit(1))
    else:
        v = v.withColumns({"i": cell_of(v, "x", cells), "j": cell_of(v, "y", cells)})
        inside = F.explode(F.array(
            F.struct(F.format_string("x%d", "i").alias("g"), F.lit(1).alias("f")), F.struct(F.format_string("y%d", "j").alias("g"), F.lit(1).alias("f")),
            F.struct(F.format_string("%d-%d", "i", "j").alias("g"), F.lit(-1).alias("f")),
        ))
        grid = v.groupBy("i", "j").agg(F.sum("n").alias("n")).select(F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), "n", F.lit("grid").alias("g"), F.lit(1).alias("f"))
        parts = v.select("x", "y", "n", inside.alias("p")).select("x", "y", "n", "p.g", "p.f")
        spans = parts.groupBy("g").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).filter("a < b and c < d")
        parts = parts.join(spans, "g", "left_semi").unionByName(grid)
    s = parts.groupBy("g", "f").applyInPandas(lambda key, rows: _signed_pairs(rows) * key[1], "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("_s"))
    pairs = lambda c: v.groupBy(c).agg(F.sum("n").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias(f"_t{c}"))
    n = v.agg(F.sum("n").alias("_n"))
    one = s.crossJoin(pairs("x")).crossJoin(pairs("y")).crossJoin(n)  # one row each
    all_ = F.col("_n") * (F.col("_n") - 1) / 2
    return one.select(F.try_divide("_s", F.sqrt((all_ - F.col("_tx")) * (all_ - F.col("_ty")))).alias("ktau"))


def fairness(df: DataFrame, group: str, truth: Column, response: Column) -> DataFrame:
    """(group, n, positive_rate, tpr, fpr, acc) and each difference and ratio
    against the group with the highest positive rate (ties: the first by name)."""
    t, p = truth, response
    g = df.groupBy(F.col(group).alias("group")).agg(
        F.count("*").alias("n"), F.avg(p.cast("double")).alias("positive_rate"), F.avg(F.when(t, p.cast("double"))).alias("tpr"),
        F.avg(F.when(~t, p.cast("double"))).alias("fpr"), F.avg((t == p).cast("double")).alias("acc"),
    )
    best = g.orderBy(F.desc("positive_rate"), "group").limit(1).select(F.col("positive_rate").alias("_p"), F.col("tpr").alias("_t"), F.col("fpr").alias("_f"))
    return g.crossJoin(F.broadcast(best)).select(  # one row
        "group", "n", "positive_rate", "tpr", "fpr", "acc", (F.col("positive_rate") - F.col("_p")).alias("demographic_parity"), (F.col("tpr") - F.col("_t")).alias("equal_opportunity"),
        F.greatest(F.abs(F.col("tpr") - F.col("_t")), F.abs(F.col("fpr") - F.col("_f"))).alias("equalized_odds"), F.try_divide("positive_rate", "_p").alias("disparate_impact"),
    )


def data_bias(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, n, share, representation, kl): how far each group's labels are from all labels' shares."""
    k = df.groupBy(F.col(group).alias("group"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    by_g, by_l, all_ = Window.partitionBy("group"), Window.partitionBy("label"), k.agg(F.sum("n").alias("_n"), F.count_distinct("group").alias("_k"))
    k = k.withColumn("ng", F.sum("n").over(by_g)).withColumn("nl", F.sum("n").over(by_l)).crossJoin(F.broadcast(all_))  # one row
    p, q = F.col("nl") / F.col("_n"), F.col("n") / F.col("ng")
    return k.groupBy("group").agg(
        F.max("ng").alias("n"), F.max(F.col("ng") / F.col("_n")).alias("share"), F.max(F.col("ng") * F.col("_k") / F.col("_n")).alias("representation"), F.sum(p * F.ln(p / q)).alias("kl")
    )


def cluster_quality(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """One row: n, clusters, inertia, calinski_harabasz, davies_bouldin and silhouette, the
    last by squared distances: a row's mean squared distance to a cluster is that to its
    centre plus the cluster's variance, so no pairs of rows are made. Rows with a null
    don't count; a cluster of one row has silhouette 0. The centres, a row a cluster, go to every task."""
    xs = [f"x{i}" for i in range(len(features))]
    rows = df.select(F.col(cluster).alias("c"), *[F.col(f).cast("double").alias(x) for f, x in zip(features, xs, strict=True)]).dropna()
    centres = rows.groupBy("c").agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{x}") for x in xs])
    apart = lambda a, b: sum((F.pow(a(x) - b(x), F.lit(2)) for x in xs), F.lit(0.0))
    own = apart(F.col, lambda x: F.col(f"m{x}"))
    per = rows.join(centres, "c").groupBy("c", "n", *[f"m{x}" for x in xs]).agg(F.sum(own).alias("w"), F.avg(F.sqrt(own)).alias("s"))
    every = per.agg(F.collect_list(F.struct("c", "n", "w", "s", *[f"m{x}" for x in xs])).alias("all"), F.sum("w").alias("inertia"), F.sum("n").alias("n"), F.count("*").alias("clusters"))
    centre = lambda o: lambda x: o[f"m{x}"]
    others = lambda c: F.filter("all", lambda o: o["c"] != c)
    mean = lambda x: F.aggregate("all", F.lit(0.0), lambda t, o: t + o["n"] * o[f"m{x}"]) / F.col("n")
    every = every.withColumns({f"g{x}": mean(x) for x in xs})
    between = F.aggregate("all", F.lit(0.0), lambda t, o: t + o["n"] * apart(centre(o), lambda x: F.col(f"g{x}")))
    worst = F.transform("all", lambda a: F.array_max(F.transform(others(a["c"]), lambda o: F.try_divide(a["s"] + o["s"], F.sqrt(apart(centre(a), centre(o)))))))
    every = every.withColumn("calinski_harabasz", F.try_divide(between * (F.col("n") - F.col("clusters")), F.col("inertia") * (F.col("clusters") - 1)))
    every = every.withColumn("davies_bouldin", F.aggregate(worst, F.lit(0.0), lambda t, q: t + q) / F.col("clusters"))
    away = lambda o: apart(F.col, centre(o)) + o["w"] / o["n"]
    mine = F.get(F.filter("all", lambda o: o["c"] == F.col("c")), F.lit(0))
    each = rows.crossJoin(F.broadcast(every.select("all")))  # one row
    each = each.select(mine["n"].alias("n"), (away(mine) * F.try_divide(mine["n"], mine["n"] - 1)).alias("a"), F.array_min(F.transform(others(F.col("c")), away)).alias("b"))
    width = F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return every.drop("all", *[f"g{x}" for x in xs]).crossJoin(F.broadcast(each.agg(F.avg(width).alias("silhouette"))))  # one row


def brier_multi(df: DataFrame, truth: str, probabilities: dict[str, str]) -> DataFrame:
    """mbrier: mean over rows of the squared distance to the truth's indicator."""
    each = sum((F.pow((F.col(truth) == label).cast("double") - F.col(c), F.lit(2)) for label, c in probabilities.items()), F.lit(0.0))
    return df.filter(F.col(truth).isNotNull()).agg(F.count("*").alias("n"), F.avg(each).alias("mbrier"))


def auc_multi(df: DataFrame, truth: str, probabilities: dict[str, str]) -> DataFrame:
    """aunu and aunp: each class against the rest, averaged evenly and by class size."""
    per = class_auc(df, truth, probabilities)
    return per.agg(F.avg("auc").alias("aunu"), F.try_divide(F.sum(F.col("auc") * F.col("n")), F.sum("n")).alias("aunp"))


def auc_pairs(df: DataFrame, truth: str, probabilities: dict[str, str]) -> DataFrame:
    """au1u: each ordered pair of classes against each other by the first one's probability, averaged evenly."""
    out = None
    for a, c in probabilities.items():
        for b in probabilities:
            if a != b:
                one = scores(df.filter(F.col(truth).isin(a, b)), F.col(truth) == a, c).select("auc")
                out = one if out is None else out.unionByName(one)
    return out.agg(F.avg("auc").alias("au1u"))


def rqr(df: DataFrame, truth: str, response: str, alpha: float = 0.5) -> DataFrame:
    """Quantile R squared: one less the pinball loss over that of the truth's own quantile."""
    loss = lambda e: F.greatest(alpha * e, (alpha - 1) * e)
    rows = with_quantiles(_both(df, truth, response), truth, {"_quantile": alpha})
    return rows.agg((1 - F.try_divide(F.sum(loss(F.col(truth) - F.col(response))), F.sum(loss(F.col(truth) - F.col("_quantile"))))).alias("rqr"))


#: Measures by short id: kind, function of (frame, truth, response or score), column.
MEASURES: dict[str, tuple[str, str]] = {
    **{f"classif.{m}": ("multiclass", m) for m in ("acc", "bacc", "mcc", "precision", "recall", "f1")},
    "classif.ce": ("accuracy", "ce"),
    **{f"regr.{m}": ("regression", m) for m in ("bias", "pbias", "mse", "rmse", "mae", "medae", "medse", "maxae", "sae", "sse", "mape", "smape", "msle", "rmsle", "rsq")},
    "regr.srho": ("spearman", "srho"),
    "regr.ktau": ("kendall", "ktau"),
    "regr.pinball": ("pinball", "pinball"),
    "regr.rqr": ("rqr", "rqr"),
}


def create_measure(name: str):
    """(frame, truth, response) to one row with the measure of a short id, in ``score``."""
    if name not in MEASURES:
        raise ValueError(f"no measure {name}; known: {', '.join(sorted(MEASURES))}")
    function, column = MEASURES[name]
    return lambda df, truth, response: globals()[function](df, truth, response).select(F.col(column).alias("score"))
