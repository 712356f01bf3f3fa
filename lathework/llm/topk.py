"""Operator 11: exact top-k search by a three-phase uniform threshold.

A vector is cut into ``LISTS`` segments; a query's inner products with one segment of
all rows make a list, and a row's score is the sum of its places in the lists. Lists are
held in blocks: a task has ``ROWS`` rows and ``QUERIES`` queries.

1. *Gather.* Every block gives, of each list, the ``k`` highest entries, and their rows'
   whole scores. The k-th highest of all blocks' scores is a cutoff that at least k rows
   reach, so no row below it is needed.
2. *Cut.* A row whose entries are all below cutoff / ``LISTS`` has a score below the
   cutoff. With the cutoff at hand, a block collects the entries at or above that uniform
   threshold; what it leaves out can't be among the k highest, ties included.
3. *Resolve.* The scores of the collected rows are completed exactly; those at or above the
   cutoff, k a block and query at most, meet in the final ranking.

Fewer lists give a sharper threshold: with two, of vectors without structure about a
fifteenth of the rows is resolved, with four a third. Scores are sums of integers: by
floating-point products where none can exceed 2^53, by 64-bit integers where none can
exceed 2^63, by Python's beyond.

All rows meet all queries, as the contract asks (a twentieth of the rows are queries), block
by block; a row travels once per ``QUERIES`` queries and a query once per ``ROWS`` rows, in
two bytes a component where that holds them. Only the query's cutoff is joined back.

Cases: rows with null id, and vectors that are null or hold a null or a non-finite
component, take no part; an empty vector and a zero one do; vectors have scores with others
of their length only; a query id that is repeated is asked once, with the least of its vectors;
repeated candidates are found as often as they appear, except under the query's own id; any
number of equal vectors fills many blocks; with fewer than ``k`` candidates all are returned;
components and scores beyond 64 bits stay at the end of their range; an empty table
gives an empty result; more columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs, portable, scratch, small, store

K, SCALE, LISTS = 20, 64, 2
ROWS, QUERIES = 4096, 1024
#: Queries of one product, and pairs whose scores are resolved at a time.
SLICE, PAIRS = 256, 1 << 16
MOST = (1 << 63) - 1


def parts_of(x: np.ndarray, largest: int) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Rows of ``x`` by what holds their products with numbers up to ``largest``."""
    bound = np.abs(x).max(axis=1, initial=0).astype(object) * largest * max(1, x.shape[1])
    kinds = np.where(bound < 1 << 53, "f8", np.where(bound < 1 << 63, "i8", "O"))
    return [(at, x[at].astype(kind), kind) for kind in ("f8", "i8", "O") if len(at := np.flatnonzero(kinds == kind))]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``q`` with all of ``x`` (64-bit integers), exactly."""
    out = np.empty((len(q), len(x)), np.int64)
    for at, part, kind in parts_of(x, int(np.abs(q).max(initial=0))):
        out[:, at] = np.clip(q.astype(kind) @ part.T, -MOST, MOST) if kind == "O" else q.astype(kind) @ part.T
    return out


def pairwise(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``q`` with the same rows of ``x``, exactly."""
    out = np.empty(len(q), np.int64)
    for at, part, kind in parts_of(x, int(np.abs(q).max(initial=0))):
        both = (q[at].astype(kind) * part).sum(axis=1)
        out[at] = np.clip(both, -MOST, MOST) if kind == "O" else both
    return out


def segments(width: int, lists: int) -> list[slice]:
    edges = np.linspace(0, width, min(lists, max(1, width)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def resolved(q: np.ndarray, x: np.ndarray, asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whole scores of the pairs (asked, row)."""
    steps = range(0, len(asked), PAIRS)
    return np.concatenate([pairwise(q[asked[i : i + PAIRS]], x[rows[i : i + PAIRS]]) for i in steps]) if len(asked) else np.empty(0, np.int64)


def best(asked: np.ndarray, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Pairs among the ``k`` best of their query: highest score, then smallest id."""
    order = np.lexsort((ids[rows], ~score, asked))  # ~score falls as score rises, at both ends of the range, too
    _, begin, n = np.unique(asked[order], return_index=True, return_counts=True)
    return order[np.arange(len(order)) - np.repeat(begin, n) < k]


def gather(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: the rows with one of the k highest entries of a list, with their scores.
    ``own`` marks the pairs of a query with itself."""
    seen = np.zeros(own.shape, bool)
    for s in segments(x.shape[1], lists):
        entries = products(q[:, s], x[:, s])
        entries[own] = -MOST - 1
        top = np.argpartition(entries, len(x) - min(k, len(x)), axis=1)[:, len(x) - min(k, len(x)) :]
        np.put_along_axis(seen, top, True, axis=1)
    asked, rows = np.nonzero(seen & ~own)
    return asked, rows, resolved(q, x, asked, rows)


def collect(q: np.ndarray, x: np.ndarray, own: np.ndarray, cutoff: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: rows with an entry at or above the uniform threshold whose
    score is at or above the cutoff."""
    parts = segments(x.shape[1], lists)
    enough = np.array([-(-int(c) // len(parts)) for c in cutoff])[:, None]
    seen = np.zeros(own.shape, bool)
    for s in parts:
        seen |= products(q[:, s], x[:, s]) >= enough
    asked, rows = np.nonzero(seen & ~own)
    score = resolved(q, x, asked, rows)
    kept = score >= cutoff[asked]
    return asked[kept], rows[kept], score[kept]


def _block(k: int, lists: int):
    """A block's k best rows of each query, of those that its phase lets through."""

    def look(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            x, ids = np.stack(rows["v"].to_numpy()).astype(np.int64), rows["vec_id"].to_numpy()
            for low in range(0, len(queries), SLICE):
                part = queries.iloc[low : low + SLICE]
                q, names = np.stack(part["q"].to_numpy()).astype(np.int64), part["query_id"].to_numpy()
                own = ids[None] == names[:, None]
                found = collect(q, x, own, part["cutoff"].to_numpy(), lists) if "cutoff" in part else gather(q, x, own, k, lists)
                asked, at, score = found
                keep = best(asked, at, score, ids, k)
                out.append(pd.DataFrame({"query_id": names[asked[keep]], "vec_id": ids[at[keep]], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return look


def vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, row, v): floor(scale * x) of the vectors that take part, and a number a row."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = table.filter("vec_id is not null and embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    whole = F.transform("v", lambda x: F.greatest(F.floor(x * float(scale)), F.lit(-MOST)))
    return good.filter(F.coalesce(finite, F.lit(False))).select("vec_id", F.monotonically_increasing_id().alias("row"), whole.alias("v"))


def search(table: DataFrame, queries: DataFrame, k: int = K, lists: int = LISTS, rows: int = ROWS, asked: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): exactly the k highest inner products of every query
    with the rows of its length, under another id. ``table`` is stored and has vec_id, row and
    v (longs), ``queries`` query_id, unique, and q."""
    most = table.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0
    kind = "array<smallint>" if most < 1 << 15 else "array<bigint>"
    sizes = table.groupBy(F.size("v").alias("width")).agg(F.ceil(F.count("*") / rows).cast("int").alias("row_blocks"))
    blocks = queries.groupBy(F.size("q").alias("width")).agg(F.ceil(F.count("*") / asked).cast("int").alias("query_blocks"))
    plan = store(blocks.join(sizes, "width"), "plan")
    plan = small(plan, plan.count())

    def dealt(name: str, own: str, other: str) -> tuple[Column, Column]:
        return F.pmod(F.xxhash64(F.lit("block"), name), own).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))

    keys = ["width", "row_block", "query_block"]
    mine, every = dealt("row", "row_blocks", "query_blocks")
    left = table.select("vec_id", "row", F.col("v").cast(kind).alias("v"), F.size("v").alias("width")).join(plan, "width")
    left = left.withColumn("row_block", mine).withColumn("query_block", every).select(*keys, "vec_id", "v")

    def met(queries: DataFrame) -> DataFrame:
        mine, every = dealt("query_id", "query_blocks", "row_blocks")
        right = queries.withColumn("q", F.col("q").cast(kind)).withColumn("width", F.size("q")).join(plan, "width")
        right = right.withColumn("query_block", mine).withColumn("row_block", every).drop("query_blocks", "row_blocks")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_block(k, lists), "query_id long, vec_id long, score long")

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    scores = met(queries).withColumn("rank", F.row_number().over(by_score))
    cutoff = scores.filter(F.col("rank") <= k).groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("cutoff"))
    cutoff = queries.join(cutoff, "query_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(-MOST - 1)))
    ranked = met(store(cutoff, "cutoffs")).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth row with all the others."""
    with scratch(spark):
        table = store(vectors(docs(spark, sf_dir, "embeddings")), "vectors")
        queries = table.filter("vec_id % 20 = 0").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
        return store(search(table, store(queries, "queries")), "found", lasting=True)


OP11_SQL = """
WITH whole AS (
 SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
 SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
 FROM (SELECT vec_id, min(v) AS v FROM whole WHERE vec_id % 20 = 0 GROUP BY vec_id) q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs)
SELECT query_id, place::INTEGER AS "rank", vec_id, score FROM ranked WHERE place <= 20
"""

portable(__name__)
