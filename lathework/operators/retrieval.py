"""Exact top-k vector retrieval: a stated set of queries against every row.

Rows are dealt to chunks and queries to blocks, by hash of their ids; a task holds one chunk and one
block. There a matrix product says which pairs can be among the k best, with a margin for its
rounding, and only those are scored, component by component in order as SQL does."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Components of a chunk of rows (a block of queries has half as many), and scores held at once.
CELLS, HELD = 1 << 19, 1 << 20
#: Sizes of vectors whose squares and products neither overflow nor lose digits.
SMALL, LARGE = 1e-140, 1e140


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    whole = lists.combine_chunks()
    whole = whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole
    parts = whole.flatten()
    return parts.to_numpy(zero_copy_only=False).astype("f8").reshape(len(whole), len(parts) // max(len(whole), 1))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in order."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _scored(v: np.ndarray, q: np.ndarray, metric: str, sizes: np.ndarray) -> np.ndarray:
    if metric == "euclidean":
        return -np.sqrt(_dot(v - q, v - q))
    return _dot(v, q) / sizes if metric == "cosine" else _dot(v, q)


def _distinct(v: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` rows of each vector, as others come after them for every query."""
    if not v.size or len(v) <= most:
        return np.arange(len(v))
    _, of = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(of, kind="stable")
    return np.sort(order[np.arange(len(of)) - np.searchsorted(of[order], of[order]) < most])


def _best(k: int, metric: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a chunk and a block, the k best rows of each query, ties by id."""

    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("_id", "ascending")]))
        v, q = _matrix(rows.column("_v")), _matrix(asked.column("_v"))
        kept = _distinct(v, k + 1)
        with np.errstate(all="ignore"):
            l, m = np.sqrt(_dot(v, v)), np.sqrt(_dot(q, q))  # noqa: E741
            v, l, ids = v[kept], l[kept], rows.column("_id").take(pa.array(kept))  # noqa: E741
            own = pc.index_in(asked.column("_q"), ids).to_numpy()
            odd, odd_q = ~((l > SMALL) & (l < LARGE)), ~((m > SMALL) & (m < LARGE))
            if metric == "cosine":
                a, b, slack = v / l[:, None], q / m[:, None], np.ones(len(q))
            else:
                top = l[~odd].max(initial=0)
                a, b, slack = v, q, m * top if metric == "dot" else m * m + top * top
            slack = 4e-15 * (v.shape[1] + 16) * slack + 1e-300
            found, step = [], max(1, HELD // max(len(v), 1))
            for at in range(0, len(q) if len(v) else 0, step):
                s = b[at : at + step] @ a.T
                if metric == "euclidean":
                    s = 2 * s - (l * l)[None, :]
                s[:, odd] = s[odd_q[at : at + step]] = np.nan
                mine = own[at : at + step]
                here = np.flatnonzero(~np.isnan(mine.astype("f8")))
                s[here, mine[here].astype("i8")] = -np.inf
                if len(v) > k:
                    least = np.partition(np.where(np.isnan(s), -np.inf, s), len(v) - k, axis=1)[:, len(v) - k] - slack[at : at + step]
                    keep = ~(s < least[:, None])
                else:
                    keep = np.ones(s.shape, bool)
                keep[here, mine[here].astype("i8")] = False
                if metric == "cosine":  # no score where the sizes' product is 0
                    sized = m[at : at + step]
                    keep[np.ix_(np.isfinite(sized), l == 0)] = False
                    keep[np.ix_(sized == 0, np.isfinite(l))] = False
                who, which = np.nonzero(keep)
                part = max(1, HELD // max(v.shape[1], 1))
                score = [_scored(v[y], q[at + x], metric, l[y] * m[at + x]) for x, y in ((who[i : i + part], which[i : i + part]) for i in range(0, len(who), part))]
                score = np.concatenate(score) if score else np.zeros(0)
                nan = np.isnan(score)
                order = np.lexsort((which, np.where(nan, 0, -score), ~nan, who))
                who, which, score = who[order], which[order], score[order]
                first = np.arange(len(who)) - np.searchsorted(who, who) < k
                found.append((who[first] + at, which[first], score[first]))
        who, which, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))
        return pa.table({"_q": asked.column("_q").take(pa.array(who)), "_id": ids.take(pa.array(which)), "_s": pa.array(score)})

    return best


def top_k(table: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, metric: str = "cosine") -> DataFrame:
    """(query_id, key, score) of the k best rows but the query's own, ties by key.

    Pairs without a score (a null vector or component, other lengths, no direction) come last, by key."""
    kind = table.schema[vector].dataType.elementType
    v = F.col(vector) if isinstance(kind, T.FloatType) else F.transform(vector, lambda x: x.cast("double"))
    every = table.select(F.col(key).alias("_id"), v.alias("_v")).filter("_id is not null")
    asked = queries.select(F.col(key).alias("_q"), v.alias("_v")).filter("_q is not null")
    whole = lambda df: df.filter(F.forall("_v", lambda x: x.isNotNull())).withColumn("_width", F.size("_v"))
    n, wide = every.agg(F.count("*"), F.max(F.size("_v"))).first()
    cells = CELLS // max(wide or 1, 1)
    chunks, blocks = -(-max(n, 1) // max(64, cells)), -(-max(asked.count(), 1) // max(64, cells // 2))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = whole(every).withColumn("_chunk", deal("_id", chunks)).withColumn("_block", each(blocks))
    right = whole(asked).withColumn("_block", deal("_q", blocks)).withColumn("_chunk", each(chunks))
    place = ["_width", "_chunk", "_block"]
    found = T.StructType([T.StructField("_q", asked.schema["_q"].dataType), T.StructField("_id", every.schema["_id"].dataType), T.StructField("_s", T.DoubleType())])
    near = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(_best(k, metric), found)
    by = Window.partitionBy("_q").orderBy(F.desc_nulls_last("_s"), "_id")
    near = near.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k).drop("_r")

    # Of the least 2k + 1 ids, a query with fewer than k scores lacks k others at least.
    rest = every.select("_id").orderBy("_id").limit(2 * k + 1)
    rest = asked.select("_q").crossJoin(F.broadcast(rest)).filter("_id <> _q").withColumn("_s", F.lit(None).cast("double"))
    both = near.withColumn("_had", F.lit(1)).unionByName(rest.withColumn("_had", F.lit(0)))
    both = both.withColumn("_most", F.max("_had").over(Window.partitionBy("_q", "_id"))).filter("_had = _most")
    out = both.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k)
    return out.select(F.col("_q").alias("query_id"), F.col("_id").alias(key), F.col("_s").alias("score"))
