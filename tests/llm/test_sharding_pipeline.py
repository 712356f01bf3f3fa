from __future__ import annotations

import json
import os

import pytest

import corpus_pipeline
from lathework.llm import mixing, nearcopies, private, sharding, toxicity

from ..conftest import DATA
from ..oracle import compare


def test_versions_and_compaction(spark, tmp_path, documents):
    df = documents([(i, f"text {i}", "en", "a") for i in range(400)])
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target=1 << 20, fan=4)
    for k in range(5):
        store.append(df.filter(f"doc_id % 5 = {k}").repartition(3))
    before = store.manifest()
    assert store.version() == 5 and len(before["shards"]) == 15
    version = store.compact()
    after = store.manifest()
    assert version == 6 and len(after["shards"]) < 4
    assert sum(s.rows for s in after["shards"]) == 400
    assert sorted(r["doc_id"] for r in store.read(5).collect()) == list(range(400))  # an old version still reads
    assert store.compact() == 6
    assert store.vacuum() == 0 and store.read(5).count() == 400  # too young to go
    assert store.vacuum(older_than=0) == 15
    with pytest.raises(sharding.Gone):
        store.read(5)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, df.collect()))


def test_a_version_is_committed_once(spark, tmp_path, documents):
    store = sharding.ShardStore(spark, str(tmp_path / "store"))
    store.append(documents([(1, "a", "en", "a")]))
    with pytest.raises(sharding.Conflict):
        store.commit(1, None, [])
    files = [f for f in os.listdir(tmp_path / "store" / "manifests") if f.endswith(".json")]
    assert files == ["v000000001.json"]
    json.loads((tmp_path / "store" / "manifests" / files[0]).read_text())


def test_two_writers_race(spark, tmp_path, documents):
    """Both write, then both commit the same next version: one commits again on top."""
    from concurrent.futures import ThreadPoolExecutor

    one, two = (sharding.ShardStore(spark, str(tmp_path / "store")) for _ in range(2))
    parts = [documents([(i, f"text {i}", "en", "a") for i in range(k, k + 10)]) for k in range(0, 60, 10)]
    with ThreadPoolExecutor(2) as pool:
        versions = list(pool.map(lambda kp: (one, two)[kp[0] % 2].append(kp[1]), enumerate(parts)))
    assert sorted(versions) == [1, 2, 3, 4, 5, 6]
    assert sorted(r["doc_id"] for r in one.read().collect()) == list(range(60))
    with ThreadPoolExecutor(8) as pool:
        wins = list(pool.map(lambda k: _commits((one, two)[k % 2], 7), range(8)))
    assert sum(wins) == 1


def _commits(store, version):
    try:
        return store.commit(version, None, []) == version
    except sharding.Conflict:
        return False


def test_a_writer_that_has_not_committed_loses_nothing(spark, tmp_path, documents):
    one, two = (sharding.ShardStore(spark, str(tmp_path / "store")) for _ in range(2))
    one.append(documents([(1, "a", "en", "a")]))
    written = one._write(documents([(2, "b", "en", "a")]))
    assert two.vacuum() == 0
    old = one.manifest()
    one.commit(2, old["schema"], [*old["shards"], *written])
    assert two.read().count() == 2


def test_merges_that_cross(spark, tmp_path, documents, monkeypatch):
    one, two = (sharding.ShardStore(spark, str(tmp_path / "store")) for _ in range(2))
    for k in range(4):
        one.append(documents([(k, "a", "en", "a")]))
    write = one._write
    monkeypatch.setattr(one, "_write", lambda df: (two.compact(force=True), write(df))[1])
    one.compact(force=True)
    assert sorted(r["doc_id"] for r in one.read().collect()) == [0, 1, 2, 3]


def test_merged_files_have_the_target_size(spark, tmp_path):
    df = spark.range(60_000).selectExpr("id as doc_id", "sha2(cast(id as string), 256) as text")
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target=1 << 20, least=1 << 14)
    store.append(df.repartition(24))
    store.append(df.coalesce(1))  # one large shard beside small ones
    store.compact()
    sizes = [s.size for s in store.manifest()["shards"]]
    assert max(s for s in sizes if s < 3 << 20) <= 1.3 * (1 << 20)
    assert sum(s.rows for s in store.manifest()["shards"]) == 120_000
    assert sum(s < 1 << 19 for s in sizes) <= 1


def test_new_columns_stay_and_other_types_are_refused(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"))
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([(2, "b", "kept")], "doc_id long, text string, note string"))
    store.append(spark.createDataFrame([("c",)], "text string"))
    for bad in ("doc_id string, text string", "Doc_ID long, text string"):
        with pytest.raises(sharding.SchemaMismatch):
            store.append(spark.createDataFrame([], bad))
    want = {(1, "a", None), (2, "b", "kept"), (None, "c", None)}
    assert {tuple(r) for r in store.read().collect()} == want
    store.compact(force=True)
    store.vacuum(older_than=0)
    assert {tuple(r) for r in store.read().collect()} == want


def test_empty_arrivals(spark, tmp_path, documents, odd):
    store = sharding.ShardStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0
    store.append(documents([]))
    assert store.read().count() == 0
    store.append(odd)
    assert store.read().count() == 10


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_query_equals_sql(spark):
    compare(spark, DATA, sharding.op2_shards, sharding.OP2_SQL)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_pipeline(spark, tmp_path):
    """Every stage against its operator's own result on the stage's input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "pack":
            assert out.columns == docs.columns
        ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
        if name == "toxicity":
            clean = toxicity.score(docs, toxicity.train(docs, labels)).filter("predicted = 0")
            assert ids(out) == ids(clean)
        elif name == "near_copies":
            assert ids(out) == ids(nearcopies.near_copies(docs).filter("kept"))
        elif name == "private":
            assert ids(out) == ids(docs)
            changed = {r["doc_id"] for r in private.digest(private.find(docs)).filter("spans <> ''").collect()}
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert {r["doc_id"] for r in out.collect() if r["text"] != texts[r["doc_id"]]} == changed
        elif name == "mix":
            want = sorted(r["doc_id"] for r in mixing.mix(docs).collect() for _ in range(r["copies"]))
            assert ids(out) == want
        else:
            fill = {}
            for r in out.collect():
                fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
            assert max(fill.values()) <= 2048
            assert sum(r["piece"] == 0 for r in out.collect()) == docs.count()
        docs = out
