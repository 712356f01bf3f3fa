"""Nulls, ties, constant columns, single rows, empty tables and edges."""

from __future__ import annotations

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lathework.operators import drift, feature_store, measures, models, ordered, profile, resample, scores, timeseries, transform
from lathework.plans import registry
from lathework.sources import readers

from .conftest import DATA


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 0.0), (4, -1.0)], "id long, x double")
    assert profile.missing_counts(df, ["x"]).first()["missing"] == 2
    assert readers.nan_to_null(df).filter("x is null").count() == 2


def test_profile_of_empty_table(spark):
    df = spark.createDataFrame([], "id long, x double")
    r = profile.col_info(df).filter("column = 'x'").first()
    assert (r["missing"], r["distinct_values"]) == (0, 0)
    assert profile.duplicate_ratio(df).first()["duplicate_ratio"] is None


def test_mid_ranks_and_positions(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, None), (5, 2.0)], "id long, x double")
    assert rows(ordered.mid_ranks(df, "x", "r"), "id", "r") == [(1, 3.5), (2, 1.0), (3, 3.5), (4, None), (5, 2.0)]
    assert rows(ordered.positions(df, "id", "at"), "id", "at") == [(i, i - 1) for i in range(1, 6)]


def test_cumulative_over_many_cells(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("v"), F.lit(1).alias("n"))
    got = ordered.cumulative(df, "v", {"upto": "n"}, following="nx", cells=16)
    assert got.filter("upto <> v + 1 or coalesce(nx, 5000) <> v + 1").count() == 0


def test_psi_of_equal_samples_is_zero(spark):
    one = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    both = one.withColumn("ref", F.lit(True)).unionByName(one.withColumn("ref", F.lit(False)))
    assert drift.psi(both, "x", "ref").first()["psi"] == pytest.approx(0)
    r = drift.two_sample(both, "x", "ref").first()
    assert (r["ks"], r["wasserstein"], r["cramer_von_mises"]) == (0, 0, 0)
    assert drift.ks_p_value(0.0, 10, 10) == 1.0
    assert drift.ks_p_value(1.0, 100, 100) < 1e-6


def test_measures_by_hand(spark):
    df = spark.createDataFrame([("cat", "cat", 0.3), ("dog", "dog", 0.7), ("dog", "cat", 0.4), ("cat", "cat", 0.2), ("dog", "dog", 0.8)], "t string, p string, s double")
    r = measures.accuracy(df, "t", "p").first()
    assert (r["acc"], r["ce"]) == (pytest.approx(0.8), pytest.approx(0.2))
    assert measures.scores(df, F.col("t") == "dog", "s").first()["auc"] == pytest.approx(1.0)
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double")
    assert measures.scores(ties, F.col("y") == 1, "s").first()["auc"] == pytest.approx(0.5)
    reg = spark.createDataFrame(list(zip([1.0, 2.0, 3.0, 4.0, 5.0], [1.1, 2.2, 2.8, 4.1, 4.9])), "t double, p double")
    r = measures.regression(reg, "t", "p").first()
    assert r["mse"] == pytest.approx(0.022)
    assert r["rsq"] == pytest.approx(1 - 0.11 / 10)
    assert measures.regression(reg.limit(1), "t", "p").first()["rsq"] is None


def test_scale_of_constant_column(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, x double")
    assert rows(transform.scale(df, ["x"]), "x") == [(0.0,), (0.0,)]


def test_encoders_on_unseen_values(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("b", 5.0)], "c string, y double")
    new = spark.createDataFrame([("a",), ("c",), (None,)], "c string")
    assert rows(transform.one_hot(new.withColumn("k", F.col("c")), "c", ["a", "b"]), "k", "c_a", "c_b") == [("a", 1, 0), ("c", 0, 0), (None, 0, 0)]
    assert rows(transform.label_encode(new, "c", train), "c") == [(-1,), (-1,), (0,)]
    got = rows(transform.target_encode(new, "c", "y", 0.0, 1, train), "c")
    assert got == [(1.0,), (3.0,), (3.0,)]


def test_bin_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in range(0, 11)], "x double")
    assert dict(rows(transform.bins(df, "x", 2, "uniform", "b"), "x", "b"))[5.0] == 1
    cut = dict(rows(transform.cut(df, "x", [0, 5, 10], "c"), "x", "c"))
    assert (cut[0.0], cut[5.0], cut[6.0], cut[10.0]) == (None, 0, 1, 1)


def test_impute_mode_takes_the_least_on_a_tie(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id long, c string")
    assert rows(transform.impute(df, {"c": "mode"}), "id", "c") == [(1, "b"), (2, "a"), (3, "a")]


def test_chunks_cover_the_text(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "ab")], "id long, t string")
    assert rows(transform.chunks(df, "id", "t", 4, 1), "id", "chunk", "content") == [(1, 0, "abcd"), (1, 1, "defg"), (1, 2, "ghij"), (4, 0, "ab")]
    with pytest.raises(ValueError):
        transform.chunks(df, "id", "t", 4, 4)


def test_rolling_std_of_one_row_is_null(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0)], "id long, v double")
    out = rows(timeseries.rolling(df, ["v"], 3, ["mean", "std"], ["id"]), "id", "v_rolling_mean_3", "v_rolling_std_3")
    assert out == [(1, 2.0, None), (2, 3.0, pytest.approx(math.sqrt(2)))]


@pytest.mark.parametrize("n,folds", [(10, 3), (7, 7), (3, 5)])
def test_folds_partition_rows(spark, n, folds):
    got = rows(resample.cv(spark.range(n), "id", folds, 1), "id", "fold")
    sizes = [sum(f == k for _, f in got) for k in range(folds)]
    assert len(got) == n
    assert sorted(sizes, reverse=True) == sizes
    assert max(sizes) - min(sizes) <= 1


def test_bootstrap_draws_n_rows(spark):
    got = resample.bootstrap(spark.range(50), "id", 2, 1.0, 3).groupBy("iter").agg(F.sum("draws").alias("n"), F.count("*").alias("k"))
    assert rows(got, "n", "k") == [(50, 50), (50, 50)]


def test_buffer_keeps_train_away(spark):
    df = spark.range(40).select("id", (F.col("id") % 8).cast("double").alias("x"), F.floor(F.col("id") / 8).cast("double").alias("y"))
    got = resample.buffered(df, "id", "x", "y", 1.5, 0.2, 1).collect()
    test = [r for r in got if r["role"] == "test"]
    assert len(test) == 8
    for r in got:
        close = any((r["x"] - t["x"]) ** 2 + (r["y"] - t["y"]) ** 2 <= 2.25 for t in test)
        assert r["role"] == "test" or (r["role"] is None) == close


def test_entropy_scores(spark):
    df = spark.createDataFrame([(0.0, "a"), (1.0, "b"), (0.0, "a"), (1.0, "b")], "x double, y string")
    r = scores.information(scores.binned(df, ["x"], "y", 2)).first()
    assert (r["info_gain"], r["sym_uncertainty"]) == (pytest.approx(1.0), pytest.approx(1.0))


def test_as_of_join_takes_the_last_not_later(spark):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    b = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (1, 6, "z")], "k int, at int, v string")
    assert rows(feature_store.as_of(a, b, "k", "t", ["v"], "at"), "k", "t", "v") == [(1, 1, None), (1, 5, "y"), (2, 9, None)]


def test_lineage(spark):
    e = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", "c")], "feature string, depends_on string")
    assert rows(feature_store.lineage(e, "c"), "feature", "level") == [("a", 2), ("b", 1), ("c", 3)]


def test_linear_fit(spark):
    df = spark.range(50).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")).withColumn("y", 1 + 2 * F.col("a") - 3 * F.col("b"))
    got = models.linear_fit(df, ["a", "b"], "y")
    assert [got[k] for k in ("intercept", "a", "b")] == pytest.approx([1, 2, -3])


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, c string")
    for suffix in ("csv", "parquet", "orc"):
        readers.write(df, f"{tmp_path}/x.{suffix}", **({"header": True} if suffix == "csv" else {}))
        assert readers.read(spark, f"{tmp_path}/x.{suffix}").count() == 2
    assert readers.unique_key(df, "id") and not readers.unique_key(df.union(df), "id")
    with pytest.raises(ValueError):
        readers.read(spark, "x.pickle")


def test_whole_tables_are_queried(spark):
    if not os.path.isdir(DATA):
        pytest.skip("needs the driver's tables")
    queries = registry.queries()
    customers = spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey")
    got = queries["latest_features_whole"](spark, DATA)
    assert customers.join(got, F.col("c_custkey") == F.col("o_custkey"), "left_anti").count() == 0
    assert queries["label_encode_whole"](spark, DATA).filter("p_brand < 0").count() == 0


def test_knn_broadcasts_blocks(spark, monkeypatch):
    train = spark.createDataFrame([(i, float(i % 17), float(i % 5), i % 3) for i in range(60)], "id long, x double, y double, lab long")
    test = spark.createDataFrame([(100 + i, i / 3, i / 7) for i in range(40)], "id long, x double, y double")
    whole = rows(models.knn(train, test, "id", ["x", "y"], "lab"), "id", "response")
    monkeypatch.setattr(models, "BLOCK", 10, raising=False)
    cut = models.knn(train, test, "id", ["x", "y"], "lab")
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("Join") == 4
    assert rows(cut, "id", "response") == whole and len(whole) == 40


def test_null_strata_keep_their_rows(spark):
    df = spark.range(100).select("id", F.expr("case when id % 10 = 0 then null when id % 2 = 0 then 'a' else 'b' end").alias("s"))
    assert resample.cv(df, "id", 5, 1, "s").count() == 100
    assert resample.holdout(df, "id", 0.5, 1, "s").filter("s is null").groupBy("is_train").count().count() == 2
    assert resample.repeated_cv(df, "id", 5, 2, 1, "s").count() == 200
    assert resample.subsampling(df, "id", 3, 0.5, 1, "s").groupBy("iter", "s").agg(F.count_if("is_train").alias("k"), F.count("*").alias("n")).filter("k <> floor(n * 0.5)").count() == 0
    drawn = resample.stratified_bootstrap(df, "id", "s", 2, 1).join(df, "id").groupBy("iter", "s").agg(F.sum("draws").alias("d"), F.count("*").alias("n"))
    assert drawn.filter("d <> n").count() == 0 and drawn.count() == 6


def test_repeats_are_single_plans_with_their_seeds(spark):
    df = spark.range(57)
    both = resample.repeated_cv(df, "id", 4, 2, 3)
    for r in range(2):
        assert rows(both.filter(F.col("repeat") == r), "id", "fold") == rows(resample.cv(df, "id", 4, 3 + r), "id", "fold")


def test_a_new_category_is_drift(spark):
    df = spark.createDataFrame([("a", True)] * 50 + [("a", False)] * 50 + [("new", False)] * 5 + [(None, True)] * 3 + [(None, False)] * 3, "x string, ref boolean")
    r = drift.chi2_categories(df, "x", "ref").first()
    assert r["df"] == 2 and r["chi2"] > 1e9
    same = drift.chi2_categories(df.filter("x is null or x <> 'new'"), "x", "ref").first()
    assert same["chi2"] == pytest.approx(0, abs=1e-6)


def test_quantiles_equal_percentiles(spark):
    df = spark.range(3000).select((F.col("id") % 4).alias("g"), F.expr("case when id % 11 = 0 then null else (id * 7919) % 701 / 3 end").alias("x"))
    df = df.unionByName(spark.createDataFrame([(None, 1.5), (None, 2.5), (9, None)], "g long, x double"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, probs))).alias("q")).filter("q is not null")
    got = ordered.quantiles(df, "x", probs, ["g"], "q", cells=16)
    assert [(g, pytest.approx(q)) for g, q in rows(want, "g", "q")] == rows(got, "g", "q")
    assert ordered.quantiles(df, "x", probs, out="q", cells=8).first()["q"] == pytest.approx(df.agg(F.percentile("x", F.array(*map(F.lit, probs)))).first()[0])
    assert [r["_q"] for r in ordered.quantiles(df.limit(0), "x", [0.5, 1.0]).collect()] == [[None, None]]
    assert ordered.quantiles(df.limit(0), "x", [0.5], ["g"]).count() == 0
    assert transform.impute(df.filter("g = 9"), {"x": "median"}).first()["x"] is None


def test_categories_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(transform, "MOST_COLUMNS", 3)
    with pytest.raises(ValueError):
        transform.categories(spark.range(5).select(F.col("id").cast("string").alias("c")), "c")


@pytest.mark.parametrize("per_cell", [7, 40, 10_000])
def test_kendall_equals_all_pairs(spark, per_cell):
    """Ties on both axes, one value of x in a third of the rows, and nulls."""
    rng = random.Random(5)
    rows = [(7.0 if i % 3 == 0 else float(rng.randrange(40)), float(rng.randrange(60)) + (i % 2) / 4) for i in range(400)]
    got = measures.kendall(spark.createDataFrame([*rows, (None, 1.0), (2.0, None)], "x double, y double"), "x", "y", per_cell).first()["ktau"]
    sign = lambda a: (a > 0) - (a < 0)
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[:i]]
    s = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for a, b in pairs)
    x, y = (sum(a[k] != b[k] for a, b in pairs) for k in (0, 1))
    assert math.isclose(got, s / math.sqrt(x * y), rel_tol=1e-12)


def test_kendall_of_nothing_and_of_one_value_is_null(spark):
    assert measures.kendall(spark.createDataFrame([], "x double, y double"), "x", "y").first()["ktau"] is None
    assert measures.kendall(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").first()["ktau"] is None


def test_outliers_keep_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(900.0,), (None,)], "v double")
    assert [r["is_outlier"] for r in transform.outliers(df, ["v"]).collect()] == [0] * 10 + [1, 0]
    assert transform.outliers(df, ["v"], "remove").count() == 11
    assert sorted(r["v"] for r in transform.outliers(df, ["v"], "impute").filter("v is not null").collect())[-1] == 9.0


def test_cluster_quality_of_single_rows(spark):
    df = spark.createDataFrame([(0.0, "a"), (1.0, "a"), (9.0, "b"), (None, "b")], "x double, c string")
    r = measures.cluster_quality(df, ["x"], "c").first()
    assert (r["n"], r["clusters"], r["inertia"]) == (3, 2, 0.5)
    assert abs(r["silhouette"] - ((1 - 1 / 81) + (1 - 1 / 64) + 0) / 3) < 1e-12


def test_positions_within_groups(spark):
    import datetime as dt

    rng = random.Random(5)
    data = [(rng.choice(["hot"] * 8 + ["a", None]), dt.datetime(2020, 1, 1) + dt.timedelta(seconds=rng.randrange(400)) if rng.random() > 0.05 else None, i) for i in range(1500)]
    df = spark.createDataFrame(data, "g string, t timestamp, id long")
    for down in (False, True):
        want, seen = [], {}
        for g, t, i in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2]), reverse=down):
            seen[g] = seen.get(g, -1) + 1
            want.append((i, seen[g]))
        assert rows(ordered.positions_within(df, ["g"], ["t", "id"], "at", down, cells=16), "id", "at") == sorted(want, key=repr)
    assert ordered.positions_within(df.limit(0), ["g"], ["t", "id"], "at").count() == 0


@pytest.mark.parametrize("alpha", [0.3, 1.0])
def test_smoothing_is_the_recursion(spark, alpha):
    rng = random.Random(6)
    data = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(10_000), rng.choice([None, rng.uniform(-5, 5)])) for _ in range(1200)] + [("one", 1, 2.0), ("none", 1, None)]
    levels = {}
    for g, t, v in sorted((r for r in data if r[2] is not None), key=lambda r: r[1:]):
        n, level = levels.get(g, (0, v))
        levels[g] = (n + 1, alpha * v + (1 - alpha) * level)
    got = {r["g"]: (r["n"], r["level"]) for r in timeseries.smooth(spark.createDataFrame(data, "g string, t long, v double"), ["g"], "t", "v", alpha).collect()}
    assert got.keys() == levels.keys()
    for g, (n, level) in levels.items():
        assert got[g] == (n, pytest.approx(level, abs=1e-9))


def test_a_null_feature_is_nobodys_neighbour(spark):
    train = spark.createDataFrame([(1, None, 1.0), (2, 5.0, 2.0), (3, 6.0, 3.0), (4, float("nan"), 9.0), (5, 5.0, None)], "id long, x double, y double")
    test = spark.createDataFrame([(10, 5.0), (11, None), (12, float("nan"))], "id long, x double")
    assert rows(models.knn(train, test, "id", ["x"], "y", k=1, classify=False), "id", "response") == [(10, 2.0), (11, None), (12, None)]
    assert rows(models.knn(train, test, "id", ["x"], "y", k=3), "id", "response") == [(10, 2.0), (11, None), (12, None)]
