"""Cases that only larger tables reach: counts past 64 bits, copies, many queries."""

from __future__ import annotations

import functools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lathework.operators import measures, models, nearest, resample, retrieval


def test_mcc_of_many_rows(spark):
    n = 300_000
    df = spark.range(n).select((F.col("id") % 3).alias("t"), F.when(F.col("id") % 7 < 4, F.col("id") % 3).otherwise(F.col("id") % 4).alias("p"))
    pairs = Counter((i % 3, i % 3 if i % 7 < 4 else i % 4) for i in range(n))
    t, p = Counter(), Counter()
    for (a, b), k in pairs.items():
        t[a] += k
        p[b] += k
    hits = sum(k for (a, b), k in pairs.items() if a == b)
    low = (n * n - sum(k * k for k in p.values())) * (n * n - sum(k * k for k in t.values()))
    got = measures.multiclass(df, "t", "p").first()
    assert got["mcc"] == pytest.approx((hits * n - sum(t[x] * p[x] for x in p)) / low**0.5, abs=1e-12)
    assert got["n"] == n and got["acc"] == hits / n


def made_by_joins(df):
    """Rows that the joins of a collected table made."""

    def walk(plan):
        kids = [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.nodeName() == "AdaptiveSparkPlan":
            kids = [plan.executedPlan()]
        elif plan.getClass().getSimpleName().endswith("QueryStageExec"):
            kids = [plan.plan()]
        own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
        return own + sum(map(walk, kids))

    return walk(df._jdf.queryExecution().executedPlan())


def neighbours(train, test, k, metric):
    """{query: [(distance, id, target)]} over all pairs, in Python's floats."""
    out = {}
    for q, *at in test:
        gaps = [([a - b for a, b in zip(x, at, strict=True)], i, y) for i, *x, y in train]
        far = [((sum(g * g for g in gap) ** 0.5 if metric == "euclidean" else sum(map(abs, gap))), i, y) for gap, i, y in gaps]
        out[q] = sorted((x for x in far), key=lambda x: (x[0] != x[0], x[:2]))[:k]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_knn_compares_near_chunks_only(spark, monkeypatch, metric):
    monkeypatch.setattr(nearest, "ROWS", 100)
    rng = random.Random(4)
    spot = lambda: rng.choice([(3.0, 4.0), (rng.uniform(-5, 5), rng.uniform(-5, 5)), (rng.randrange(4), rng.randrange(4)), (1e9 * rng.random(), 0.0), (float("inf"), 1.0), (-float("inf"), 2.0)])
    train = [(i, *map(float, spot()), rng.uniform(0, 9)) for i in range(3000)]
    test = [(9000 + i, *map(float, spot())) for i in range(150)]
    a, b = spark.createDataFrame(train, "id long, x double, y double, v double"), spark.createDataFrame(test, "id long, x double, y double")
    got = models.knn(a, b, "id", ["x", "y"], "v", k=7, classify=False, metric=metric)
    found = {r["id"]: r["response"] for r in got.collect()}
    want = {q: sum(y for _, _, y in near) / 7 for q, near in neighbours(train, test, 7, metric).items()}
    assert found == pytest.approx(want, rel=1e-12)
    assert made_by_joins(got) < 1000  # chunks and blocks, not the 450,000 pairs


def test_knn_of_many_features_text_ids_and_few_rows(spark):
    rng = random.Random(5)
    train = [(f"t{i}", *[rng.choice([0.0, 1.0, rng.random()]) for _ in range(70)], float(i)) for i in range(300)]
    test = [(f"q{i}", *[rng.choice([0.0, 1.0, rng.random()]) for _ in range(70)]) for i in range(20)]
    names = [f"x{i}" for i in range(70)]
    kinds = ", ".join(f"{x} double" for x in names)
    b = spark.createDataFrame(test, f"id string, {kinds}")
    for n in (300, 3, 0):
        a = spark.createDataFrame(train[:n], f"id string, {kinds}, v double")
        found = {r["id"]: r["response"] for r in models.knn(a, b, "id", names, "v", k=4, classify=False).collect()}
        want = {q: sum(y for _, _, y in near) / len(near) if near else None for q, near in neighbours(train[:n], test, 4, "euclidean").items()}
        assert found == (pytest.approx(want, rel=1e-12) if n else want)


def test_weighted_knn_at_copies(spark):
    train = [(i, float(i % 10), float(i % 7)) for i in range(700)]
    test = [(1000 + i, i / 2) for i in range(21)]
    a, b = spark.createDataFrame(train, "id long, x double, v double"), spark.createDataFrame(test, "id long, x double")
    got = models.knn(a, b, "id", ["x"], "v", k=3, classify=False, weights="distance")
    want = {}
    for q, near in neighbours(train, test, 3, "euclidean").items():
        weights = [1 / d if d else 1e10 for d, _, _ in near]
        want[q] = sum(w * y for w, (_, _, y) in zip(weights, near, strict=True)) / sum(weights)
    assert {r["id"]: r["response"] for r in got.collect()} == pytest.approx(want, rel=1e-12)
    assert made_by_joins(got) < 100  # not the 14,700 pairs


def test_knn_votes_of_copies(spark):
    rng = random.Random(6)
    train = [(i, float(rng.randrange(3)), float(rng.randrange(2)), rng.choice("abc")) for i in range(900)]
    test = [(2000 + i, rng.randrange(7) / 3, rng.randrange(7) / 3) for i in range(40)]
    a, b = spark.createDataFrame(train, "id long, x double, y double, v string"), spark.createDataFrame(test, "id long, x double, y double")
    got = models.knn(a, b, "id", ["x", "y"], "v", k=6)
    want = {}
    for q, near in neighbours(train, test, 6, "euclidean").items():
        votes = Counter(y for _, _, y in near)
        want[q] = min(votes, key=lambda v: (-votes[v], v))
    assert {r["id"]: r["response"] for r in got.collect()} == want
    assert made_by_joins(got) < 100  # not the 36,000 pairs


def scored(a, b, metric):
    """Summed in order; None where a vector or component is missing, lengths differ or there is no direction."""
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    dot = lambda x, y: functools.reduce(lambda t, z: t + z[0] * z[1], zip(x, y, strict=True), 0.0)  # noqa: E731  sum() would compensate
    if metric == "dot":
        return dot(a, b)
    if metric == "euclidean":
        gap = [i - j for i, j in zip(a, b, strict=True)]
        return -math.sqrt(dot(gap, gap))
    size = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    return dot(a, b) / size if size else None


def best_of(rows, queries, k, metric):
    out = []
    for q, b in queries:
        found = [(scored(a, b, metric), i) for i, a in rows if i != q]
        order = sorted(found, key=lambda x: (x[0] is None, x[0] is not None and x[0] == x[0], -(x[0] if x[0] is not None and x[0] == x[0] else 0), x[1]))
        out += [(q, i, s) for s, i in order[:k]]
    return sorted(out, key=lambda x: x[:2])


def same_scores(got, want):
    got = sorted(((r["query_id"], r["id"], r["score"]) for r in got.collect()), key=lambda x: x[:2])
    text = lambda rows: [(q, i, s if s is None else repr(s + 0.0)) for q, i, s in rows]
    assert text(got) == text(want)


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("metric", ["dot", "cosine", "euclidean"])
def test_top_k_scores_few_pairs(spark, monkeypatch, metric, kind):
    monkeypatch.setattr(retrieval, "CELLS", 64 * 8 * 2)
    rng = random.Random(7)
    one = lambda: [float(rng.randrange(-8, 9)) / 4 for _ in range(8)]
    hot = one()
    odd = [None, [0.0] * 8, [None, *[1.0] * 7], [1.0] * 3, [2.0] * 3, [], [float("nan")] * 8, [float("inf"), *[1.0] * 7], [-float("inf"), *[1.0] * 7], [1e30] * 8]
    if kind == "double":
        odd += [[1e200] * 8, [1e-200] * 8, [1e-170, *[0.0] * 7], [5e160, *[-5e160] * 7]]
    rows = [(i, hot if i % 3 == 0 else odd[i // 50 % len(odd)] if i % 50 == 1 else one()) for i in range(1200)]
    table = spark.createDataFrame(rows, f"id long, v array<{kind}>")
    asked = table.filter("id % 40 = 0 or id % 50 = 1")
    got = retrieval.top_k(table, asked, "id", "v", 5, metric)
    real = {r["id"]: r["v"] for r in table.collect()}
    same_scores(got, best_of(list(real.items()), [(i, v) for i, v in real.items() if i % 40 == 0 or i % 50 == 1], 5, metric))
    assert made_by_joins(got) < 1000  # not the 60,000 pairs


def test_near_pairs_at_edges_crowds_and_infinity(spark, monkeypatch):
    monkeypatch.setattr(resample, "CROWD", 30, raising=False)
    rng = random.Random(8)
    spots = [(8.0, 0.0), (-1e-17, 0.0), (16.0, 0.0), (0.0, -8.0), (float("inf"), 0.0), (-float("inf"), 0.0), (float("nan"), 1.0), (None, 1.0), (1e12, 1e12), (1e12 + 8, 1e12)]
    spots += [(3.0, 3.0)] * 100 + [(rng.uniform(-30, 30), rng.choice([-8.0, 0.0, 4.0, 8.0, rng.uniform(-30, 30)])) for _ in range(250)]
    rows = [(i, *s) for i, s in enumerate(spots)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    want = []
    for i, a, b in rows:
        for j, c, d in rows:
            if None not in (a, c) and (a - c) * (a - c) + (b - d) * (b - d) <= 64:
                want.append((i, j, (a - c) * (a - c) + (b - d) * (b - d)))
    got = resample.near(p, p, "x", "y", 8.0, ("id", "id"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert (0, 1, 64.0) in want
