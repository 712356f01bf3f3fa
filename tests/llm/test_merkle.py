"""The Merkle manifest against a plain recursive version and its SQL."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lathework.llm import merkle
from tests.conftest import DATA
from tests.oracle import compare


def sha(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes: list[str]):
    """(root, paths): a path is a list of what stands before and after."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(places):
            run = at // 8 * 8
            paths[i].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 8])))
            places[i] = at // 8
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    key = lambda v: (v is not None, v if isinstance(v, int) else (v or "").encode())
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    langs = sorted(trees, key=key)
    for lang in langs:
        trees[lang].sort(key=lambda r: ((r[0] is not None, r[0] or 0), leaf(r)))
    low = {lang: climb([leaf(r) for r in trees[lang]]) for lang in langs}
    root, high = climb([low[lang][0] for lang in langs])
    out = []
    for lang, up in zip(langs, high, strict=True):
        for row, path in zip(trees[lang], low[lang][1], strict=True):
            path, text = path + up, row[4]
            if text is not None and zlib.crc32(str("" if row[0] is None else row[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf((*row[:4], text))
            for before, after in path:
                node = sha(before, node, after)
            out.append((row[0], leaf(row), low[lang][0], root, sha(*[b + a for b, a in path]), node, node == root))
    return sorted(out, key=repr)


def table(spark, tmp_path, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    if extra:
        for name in ("pos", "n", "grp", "node", "digest", "path", "root", "leaf", "_task", "_at", "_tie", "c0"):
            df = df.withColumn(name, F.lit("clash"))
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, merkle.op13_merkle(spark, str(tmp_path)).collect()), key=repr)


def rows_of(n, lang="en", start=0):
    return [(start + i, "s", lang, i, f"Text No {i} É") for i in range(n)]


@pytest.mark.parametrize("rows", [
    rows_of(1), rows_of(8), rows_of(9), rows_of(73) + rows_of(65, "fr", 1000) + rows_of(1, None, 5000),
    [r for i in range(11) for r in rows_of(i + 1, f"l{i}", 100 * i)],
])
def test_runs_of_every_length(spark, tmp_path, rows):
    assert table(spark, tmp_path, rows) == brute(rows)


def test_nulls_repeats_empty_and_long_texts(spark, tmp_path):
    rows = [
        (None, None, None, None, None), (None, "b", "en", 2, "UPPER"), (3, "s", "en", 0, ""), (3, "s", "en", 0, ""), (3, "s", "en", 4, "Ties"),
        (4, "s", "fr", None, "\U0001d400 É ab C"), (-5, "s", "", 1, "A"), (2**62, "s", "en", 1, "Lang " * 100_000), *rows_of(9, "de"),
    ]
    assert table(spark, tmp_path, rows) == brute(rows)


def test_many_repeats_of_one_row_fill_many_tasks(spark, tmp_path):
    rows = [(7, "s", "en", 1, "Same")] * 200 + rows_of(20, "fr")
    assert table(spark, tmp_path, rows) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert table(spark, tmp_path, []) == []


def test_query_equals_sql(spark):
    compare(spark, DATA, merkle.op13_merkle, merkle.OP13_SQL)
