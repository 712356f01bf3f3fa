"""Nearest rows in a few dimensions, exactly: near rows are stored together and far ones skipped.

Rows are dealt by range of a key that interleaves the features' ranks, so that a chunk of
them fills a small box. A query's distance to its k-th nearest row of a sample bounds what it
looks for; only chunks whose box is within that are compared, in tasks that hold one chunk and
one block of queries. Of rows at one place the k least ids are kept, as no other can count."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a chunk, sampled rows, and distances held at once.
ROWS, SAMPLE, HELD = 4096, 4096, 1 << 20

Batches = Iterator[pa.RecordBatch]


def _far(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Distances of queries (down) from rows (across), summed feature by feature."""
    out = np.zeros((len(queries), len(rows)))
    with np.errstate(all="ignore"):
        for i in range(rows.shape[1]):
            gap = rows[None, :, i] - queries[:, None, i]
            out += gap * gap if metric == "euclidean" else np.abs(gap)
        return np.sqrt(out) if metric == "euclidean" else out


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype("f8", copy=False).reshape(-1, width)


def _placed(sample: np.ndarray) -> Callable[[Batches], Batches]:
    """Adds ``_z``: the bits of each feature's rank in the sample, interleaved."""
    edges, width = np.sort(sample, axis=0), sample.shape[1]
    used = min(width, 60)
    bits = min(12, 60 // used)

    def place(batches: Batches) -> Batches:
        for batch in batches:
            x, z = _matrix(batch.column("_x"), width), np.zeros(batch.num_rows, "i8")
            for i in range(used):
                cell = np.searchsorted(edges[:, i], x[:, i]) * (1 << bits) // (len(edges) + 1)
                for j in range(bits):
                    z |= ((cell >> j) & 1) << (j * used + i)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z)], names=[*batch.schema.names, "_z"])

    return place


def _packed(batches: Batches) -> Batches:
    """One row a chunk, its rows by id."""
    held, n = [], 0

    def one() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("_id", "ascending")]))
        columns = [rows.column(c).combine_chunks() for c in ("_id", "_x", "_y")]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        whole = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], "int32"), c) for c in columns]
        return pa.RecordBatch.from_arrays(whole, names=["_ids", "_xs", "_ys"])

    for batch in batches:
        while batch.num_rows:
            part, batch = batch.slice(0, ROWS - n), batch.slice(ROWS - n)
            held.append(part)
            n += part.num_rows
            if n == ROWS:
                yield one()
                held, n = [], 0
    if n:
        yield one()


def _bounded(sample: np.ndarray, k: int, metric: str) -> Callable[[Batches], Batches]:
    """Adds ``_r``: the distance of the k-th nearest row of the sample."""

    def bound(batches: Batches) -> Batches:
        for batch in batches:
            q, r = _matrix(batch.column("_x"), sample.shape[1]), np.full(batch.num_rows, np.inf)
            step = max(1, HELD // max(len(sample), 1))
            for at in range(0, len(q) if len(sample) >= k else 0, step):
                r[at : at + step] = np.partition(_far(sample, q[at : at + step], metric), k - 1, axis=1)[:, k - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], names=[*batch.schema.names, "_r"])

    return bound


def _searched(width: int, k: int, metric: str) -> Callable[[Batches], Batches]:
    """Of each pair of a chunk and a block, the k best rows of each query, ties by id."""

    def search(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ys = batch.column("_ids")[i].values, batch.column("_ys")[i].values
                x = _matrix(batch.column("_xs")[i].values, width)
                asked = batch.column("_block")[i].values
                names, q, r = asked.field("_q"), _matrix(asked.field("_x"), width), asked.field("_r").to_numpy(zero_copy_only=False)
                with np.errstate(all="ignore"):
                    gap = np.maximum(np.maximum(x.min(0) - q, q - x.max(0)), 0)
                    least = np.sqrt((gap * gap).sum(1)) if metric == "euclidean" else gap.sum(1)
                    near = np.flatnonzero(~(least * (1 - 1e-9) > r))
                step = max(1, HELD // len(x))
                for at in range(0, len(near), step):
                    own = near[at : at + step]
                    d, most = _far(x, q[own], metric), r[own]
                    if len(x) > k:
                        most = np.fmin(most, np.partition(d, k - 1, axis=1)[:, k - 1])
                    who, which = np.nonzero(~(d > most[:, None]))
                    order = np.lexsort((which, d[who, which], who))
                    who, which = who[order], which[order]
                    first = np.arange(len(who)) - np.searchsorted(who, who) < k
                    who, which = who[first], which[first]
                    if len(who):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(own[who])), ids.take(pa.array(which)), ys.take(pa.array(which)), pa.array(d[who, which])], names=["_q", "_id", "_y", "_d"])

    return search


def nearest(train: DataFrame, asked: DataFrame, features: Sequence[str], k: int, metric: str, block: int) -> DataFrame:
    """(_q, _id, _y, _d): the k nearest rows of ``train`` (_id, _y and features) to each of
    ``asked`` (_q and features), ties by id. No feature is null. ``asked`` goes in
    blocks of about ``block`` rows by hash, each of which is one broadcast row."""
    place = F.array(*[F.col(f).cast("double") for f in features]).alias("_x")
    of = Window.partitionBy(*[F.col("_x")[i] for i in range(len(features))]).orderBy("_id")
    kept = train.select("_id", "_y", place).withColumn("_n", F.row_number().over(of)).filter(F.col("_n") <= k).drop("_n")
    n, blocks = kept.count(), max(1, -(-asked.count() // block))
    sample = np.array([r["_x"] for r in kept.select("_x", F.xxhash64("_id").alias("_h"), "_id").orderBy("_h", "_id").limit(SAMPLE).collect()], "f8").reshape(-1, len(features))

    kinds = {c: kept.schema[c].dataType for c in ("_id", "_y", "_x")}
    placed = kept.mapInArrow(_placed(sample), T.StructType([*kept.schema.fields, T.StructField("_z", T.LongType())]))
    placed = placed.repartitionByRange(max(1, -(-n // ROWS)), "_z", "_id").sortWithinPartitions("_z", "_id")
    chunks = placed.mapInArrow(_packed, T.StructType([T.StructField(f"{c}s", T.ArrayType(kinds[c])) for c in ("_id", "_x", "_y")]))

    asked = asked.select("_q", place)
    query = asked.schema["_q"].dataType
    bounds = T.StructType([*asked.schema.fields, T.StructField("_r", T.DoubleType())])
    found = T.StructType([T.StructField("_q", query), T.StructField("_id", kinds["_id"]), T.StructField("_y", kinds["_y"]), T.StructField("_d", T.DoubleType())])
    near = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == b).mapInArrow(_bounded(sample, k, metric), bounds)
        part = part.agg(F.collect_list(F.struct("_q", "_x", "_r")).alias("_block"))
        one = chunks.crossJoin(F.broadcast(part)).mapInArrow(_searched(len(features), k, metric), found)
        near = one if near is None else near.unionByName(one)
    best = Window.partitionBy("_q").orderBy("_d", "_id")
    return near.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")
