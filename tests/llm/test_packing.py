from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lathework.llm import packing


def reference_ids(text):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids
    return [*own, 0]


def check(rows, texts, capacity, repeated=()):
    """Every document's pieces put together are its ids, and sequences are gapless."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for doc_id, own in by_doc.items():
        if doc_id in repeated:
            continue
        ids = reference_ids(texts[doc_id])
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == capacity for r in own[1:])
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity


def test_same_ids_as_the_json_file():
    ids = packing.tokenizer()
    texts = ["", "a<|endoftext|>b", "été 中文 don't  stop\n\n\nnow ", "ab cd " * 40_000, "1" * 3000, " " * 500 + "x", "\U0001f600 'll 've"]
    for t in texts:
        assert ids(t).tolist() == reference_ids(t)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(sizes):
    sizes = np.array(sizes, np.int64)
    where, offset = packing.best_fit(sizes, 50)
    for b in set(where.tolist()):
        own = sorted((offset[i], sizes[i]) for i in np.flatnonzero(where == b))
        assert all(o + s == nxt for (o, s), (nxt, _) in zip(own, own[1:]))
        assert sum(s for _, s in own) <= 50
    # no bin could take another whole one
    loads = sorted(np.bincount(where, weights=sizes)) if len(sizes) else []
    assert len(loads) < 2 or loads[0] + loads[1] > 50


def test_cut():
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]
    assert packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]
    assert packing.cut(7, 2048) == [(0, 7)]


def test_pack_over_many_partitions(spark, documents, monkeypatch):
    texts = {i: " ".join(f"w{(i * 31 + j) % 500}" for j in range(3 + (i * 7919) % 90)) for i in range(300)}
    df = documents([(i, t, "en", "a") for i, t in texts.items()]).repartition(40)
    got = packing.pack(df, capacity=256).collect()
    check(got, texts, 256)
    total = sum(r["length"] for r in got)
    sequences = len({r["sequence_id"] for r in got})
    assert sequences <= 1.15 * -(-total // 256)  # seven documents a partition: bins close early
    assert len({(r["doc_id"], r["piece"]) for r in got}) == len(got)


def test_odd_rows(odd):
    got = packing.pack(odd).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    check(got, texts, packing.CAPACITY, repeated={2})
    assert sorted(r["length"] for r in got if r["doc_id"] in (3, 4)) == [1, 1]
    assert sum(r["doc_id"] == 2 for r in got) == 2


def test_more_bins_than_a_node_holds(documents):
    """No bin is cut off: nodes multiply instead, and the packing stays as good."""
    texts = {i: " ".join(f"w{(i * 31 + j) % 500}" for j in range(3 + (i * 7919) % 90)) for i in range(400)}
    df = documents([(i, t, "en", "a") for i, t in texts.items()]).repartition(40)
    whole, dealt = (packing.pack(df, capacity=256, node_bins=n).collect() for n in (10_000, 60))
    for got in (whole, dealt):
        check(got, texts, 256)
        assert {r["doc_id"] for r in got} == set(texts)
    sequences = [len({r["sequence_id"] for r in got}) for got in (whole, dealt)]
    assert sequences[1] <= 1.1 * sequences[0]


def test_bins_too_full_for_each_other_end_the_tree(documents):
    texts = {i: "x " * (100 + i) for i in range(60)}
    got = packing.pack(documents([(i, t, "en", "a") for i, t in texts.items()]).repartition(6), capacity=200, node_bins=20).collect()
    check(got, texts, 200)
    assert {r["doc_id"] for r in got} == set(texts)


def test_wide_ids_beside_a_null(documents):
    wide = [9007199254740993, -9100000000000000000, 9100000000000000000, None]
    df = documents([(i, f"text {i}", "en", "a") for i in wide])
    assert {r["doc_id"] for r in packing.pack(df).collect()} == set(wide)
    assert {r["doc_id"] for r in packing.pieces(df).collect()} == set(wide)


def test_empty(documents):
    assert packing.pack(documents([])).count() == 0
    assert packing.pieces(documents([(1, "a b", "en", "a")]), with_ids=True).first()["ids"] == reference_ids("a b")
