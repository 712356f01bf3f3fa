from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lathework.llm import mixing

from ..conftest import DATA
from ..oracle import compare


def targets(sizes, weights, cap):
    """Resharing step by step: names in order, the excess goes to those under their cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_equals_sql(spark):
    compare(spark, DATA, mixing.op7_mix, mixing.OP7_SQL)


def test_targets_and_taken(documents):
    rows = [(i, "w " * (1 + i % 9), "en", "abcde"[i % 5] if i < 200 else "f") for i in range(1000)] + [(2000 + i, "x y", "en", None) for i in range(3)]
    got = mixing.mix(documents(rows)).collect()
    sizes = {}
    for (_, t, _, s) in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes, mixing.WEIGHTS, 3)
    source = {r[0]: r[3] for r in rows}
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 9
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(documents(rows).repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_importance_changes_inclusion(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'a b c d' as text", "if(id % 2 = 0, 's', 't') as source", "if(id % 4 < 2, 0.2, 1.8) as imp")
    got = mixing.mix(df, weights=(1, 3), importance="imp").collect()
    low = sum(r["copies"] for r in got if r["doc_id"] % 4 == 0) / 1000
    high = sum(r["copies"] for r in got if r["doc_id"] % 4 == 2) / 1000
    assert low < 0.2 and high > 0.7


def test_repeat_keeps_columns(documents):
    df = documents([(i, "a b c", "en", "s" if i % 2 else "t") for i in range(100)])
    out = mixing.repeat(df)
    assert out.columns == df.columns
    counts = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    assert out.count() > 0 and sum(counts.values()) == pytest.approx(out.count(), abs=2)


def test_reruns_agree_on_repeated_ids(documents):
    rows = [(i % 40, " ".join(["w"] * (1 + i % 7)) + f" x{i}", "en", "ab"[i % 2]) for i in range(400)]
    taken = []
    for parts in (3, 8):
        df = documents(rows).repartition(parts, "text")
        got = mixing.mix(df).select("row", "copies").join(df.withColumn("row", F.monotonically_increasing_id()).select("row", "text"), "row")
        taken.append(sorted((r["text"], r["copies"]) for r in got.collect()))
    assert taken[0] == taken[1]


def test_odd_rows(odd, documents):
    got = mixing.mix(odd).collect()
    assert len(got) == 10
    assert {r["size"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}
    assert mixing.mix(documents([])).count() == 0
    assert mixing.mix(documents([(1, None, None, None)])).first()["taken"] == 0
