"""Holds a registered query against its SQL on the driver's tables, as the driver does."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def compare(spark, folder: str, query, sql: str) -> None:
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = db.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want
