"""Operator 3: approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE`` rows); every vector is then
assigned to a leaf. A query walks the tree best bin first: a priority queue
holds the nodes seen so far by the distance to their centre, and the nearest is
opened next. How many leaves a query visits is calibrated: for a bounded set of
queries the true neighbours are found by brute force over all rows, and the
number of visits is widened until the wanted recall is reached.

Neighbouring leaves share a block of about ``BLOCK`` rows, in which a query
looks at the leaves it visits only; a larger leaf, one that holds a third of
all rows, is split into many blocks, and so are a block's queries. Distances are summed one component after another in
double precision on the original vectors.

Cases: rows with null id, and vectors that are null, zero, hold a null or a
non-finite component take no part; vectors are near only to others of their
length, and every length is searched; a repeated query id is asked once, with the
least of its vectors; repeated candidates are found as often as they appear,
except under the query's own id; with fewer than ``k`` candidates all are
returned; finite vectors of any size are measured (a distance beyond the doubles is infinite, the
last in order); an empty table gives an empty result; more columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs, portable, scratch, store

K = 10
SAMPLE = 20_000
SAMPLE_VALUES = 8_000_000
BRANCHES, LEAF_ROWS, LEAF_SAMPLE = 8, 512, 16
CALIBRATION, RECALL = 100, 0.95
#: Rows of one length up to which they are searched without a tree.
FEW = 10_000
BLOCK, VISITS = 4096, 4096
#: Components beyond this count as this where leaves are chosen, as squares would overflow.
LARGE = 1e140
#: Queries of one matrix product.
SLICE = 256


@dataclass(frozen=True)
class Tree:
    """Nodes in one list; a leaf has no children and a number."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector: the nearest child, level by level."""
        out, todo = np.empty(len(vectors), np.int64), [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            own = self.children[node]
            if not own:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = squared(vectors[rows], self.centres[own]).argmin(axis=1)
                todo += [(c, rows[near == i]) for i, c in enumerate(own)]
        return out

    def order(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            own = self.children[node]
            if own:
                for d, c in zip(squared(query[None], self.centres[own])[0], own, strict=True):
                    heapq.heappush(queue, (float(d), c))
            else:
                yield self.leaf[node]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances for choosing branches (not for scores); far beyond what can be squared
    all is alike."""
    a, b = np.clip(a, -LARGE, LARGE), np.clip(b, -LARGE, LARGE)
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances summed component by component, the same for equal vectors wherever they stand."""
    total = np.zeros((len(a), len(b)))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(a.shape[1]):
            total += (a[:, j, None] - b[None, :, j]) ** 2
        total = np.sqrt(total)
        for i, k in zip(*np.nonzero(~np.isfinite(total)), strict=True):  # too large to be squared: in units of a power of two
            gap = np.abs(a[i] - b[k])
            unit = 2.0 ** np.floor(np.log2(gap.max())) if np.isfinite(gap).all() else np.inf
            total[i, k] = np.sqrt(((gap / unit) ** 2).sum()) * unit if np.isfinite(unit) else np.inf
    return total


def grow(sample: np.ndarray, leaf_sample: int, branches: int = BRANCHES) -> Tree:
    """Hierarchical k-means, split until a node's sample is small or all alike."""
    rng = np.random.default_rng(1)
    sample = np.clip(sample, -LARGE, LARGE)
    centres, children, leaf, todo = [sample.mean(axis=0)], [[]], [-1], [(0, np.arange(len(sample)))]
    n_leaves = 0
    while todo:
        node, rows = todo.pop()
        own = sample[rows]
        kinds = np.unique(own, axis=0) if len(rows) > leaf_sample else own[:1]
        if len(kinds) < 2:
            leaf[node], n_leaves = n_leaves, n_leaves + 1
            continue
        c = kinds[rng.choice(len(kinds), min(branches, len(kinds)), replace=False)]
        for _ in range(12):
            near = squared(own, c).argmin(axis=1)
            n = np.bincount(near, minlength=len(c))
            sums = np.stack([np.bincount(near, weights=own[:, j], minlength=len(c)) for j in range(own.shape[1])], axis=1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        near = squared(own, c).argmin(axis=1)
        parts = [(i, rows[near == i]) for i in range(len(c)) if (near == i).any()]
        if len(parts) < 2:
            leaf[node], n_leaves = n_leaves, n_leaves + 1
            continue
        for i, members in parts:
            children[node].append(len(centres))
            todo.append((len(centres), members))
            centres.append(c[i])
            children.append([])
            leaf.append(-1)
    return Tree(np.array(centres), children, leaf)


def nearest(queries: pd.DataFrame, rows: pd.DataFrame, k: int, more: tuple[str, ...] = ()) -> pd.DataFrame:
    """Each query's k nearest of ``rows``; both have id and vector columns. A
    query with ``leaves`` looks at the rows of those leaves only.

    Matrix products give distances up to rounding; what they put within rounding
    of the k-th one is measured exactly."""
    x, ids = np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy()
    with np.errstate(over="ignore"):
        lengths = (x * x).sum(1)
    names, leaf = np.unique(rows["leaf"].to_numpy(), return_inverse=True) if "leaves" in queries else (None, None)
    out = []
    for low in range(0, len(queries), SLICE):
        part = queries.iloc[low : low + SLICE]
        q, asked = np.stack(part["q"].to_numpy()), part["query_id"].to_numpy()
        with np.errstate(over="ignore", invalid="ignore"):
            own = (q * q).sum(1)
            near = own[:, None] - 2 * (q @ x.T) + lengths[None]
        huge = ~np.isfinite(near)  # measured exactly, as their squares overflow
        near[huge] = np.inf
        out_of_sight = ids[None] == asked[:, None]
        if leaf is not None:
            seen = np.stack([np.isin(names, visits) for visits in part["leaves"]])
            out_of_sight |= ~seen[:, leaf]
        near[out_of_sight] = np.inf
        huge &= ~out_of_sight
        rounding = 1e-12 * x.shape[1] * (own + lengths[np.isfinite(lengths)].max(initial=0))
        for i, query in enumerate(asked):
            d = near[i]
            open_ = np.isfinite(d).sum()
            if not open_ and not huge[i].any():
                continue
            least = max(0, min(k, open_) - 1)
            close = np.isfinite(d) & (d <= np.partition(d, least)[least] + 2 * rounding[i])
            look = np.flatnonzero(close | huge[i])
            d = exact(x[look], q[i][None])[:, 0]
            best = np.lexsort((ids[look], d))[:k]
            best, d = look[best], d[best]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[best], "score": d, **{m: rows[m].to_numpy()[best] for m in more}}))
    return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", "vec_id", "score", *more)})


def blocks(rows_of: dict[int, int], asked_of: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(leaf, block, row_blocks, query_blocks) of the visited leaves: neighbours in
    the tree (their numbers are close) share a block of about BLOCK rows; a
    larger leaf is a block of its own, which is split."""
    out, block, held = [], 0, 0
    for leaf in sorted(asked_of):
        n = rows_of[leaf]
        if held and held + n > BLOCK:
            block, held = block + 1, 0
        out.append((leaf, block, -(-n // BLOCK), n))
        held += n
    asked: dict[int, int] = {}
    for leaf, b, _, _ in out:
        asked[b] = asked.get(b, 0) + asked_of[leaf]
    return [(leaf, b, row_blocks, -(-asked[b] // (VISITS * 8))) for leaf, b, row_blocks, _ in out]


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = table.filter("vec_id is not null and embedding is not null").select("vec_id", v.alias("v"))
    return good.filter(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))


def search(table: DataFrame, queries: DataFrame, k: int = K, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every
    query, among the rows of its length. ``table`` has vec_id and v, ``queries``
    query_id and q. The commonest length and those of more than ``FEW`` rows get a
    tree; all the others are searched row by row in one job."""
    by_length = table.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k"))
    common = by_length.orderBy(F.desc("k"), "n").limit(1).unionByName(by_length.filter(F.col("k") > FEW)).collect()
    sizes = sorted({r["n"] for r in common})  # the commonest, and at most rows / FEW others
    out = None
    for n in sizes:
        one = tree_search(table.filter(F.size("v") == n), queries.filter(F.size("q") == n), k, recall)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return table.sparkSession.createDataFrame([], FOUND)
    few = table.select(F.size("v").alias("n"), "vec_id", "v").filter(~F.col("n").isin(*sizes))
    if few.isEmpty():
        return out
    asked = queries.select(F.size("q").alias("n"), "query_id", "q")
    found = few.groupBy("n").cogroup(asked.groupBy("n")).applyInPandas(_all_pairs(k), "query_id long, vec_id long, score double")
    return out.unionByName(_ranked(found, k))


FOUND = "query_id long, rank int, vec_id long, score double"


def _all_pairs(k: int):
    def look(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return nearest(queries, rows, k)

    return look


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def tree_search(table: DataFrame, queries: DataFrame, k: int = K, recall: float = RECALL) -> DataFrame:
    """The k nearest rows found for every query, all vectors of one length."""
    spark = table.sparkSession
    n = table.count()
    if not n:
        return spark.createDataFrame([], FOUND)
    dim = len(table.select("v").first()[0])
    bound = min(SAMPLE, max(1000, SAMPLE_VALUES // dim))
    share = F.pmod(F.xxhash64(F.lit("tree"), "vec_id"), F.lit(1 << 30)) < int(min(1.0, bound / n) * (1 << 30))
    rows = table.filter(share).select("v").collect() or table.limit(1).select("v").collect()
    sample = np.array([r[0] for r in rows])
    tree = grow(sample, max(LEAF_SAMPLE, LEAF_ROWS * len(sample) // n))
    shared = spark.sparkContext.broadcast((tree.centres, tree.children, tree.leaf))

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree(*shared.value)
        for part in parts:
            if len(part):
                yield part.assign(leaf=tree.assign(np.stack(part["v"].to_numpy())))

    index = store(table.mapInPandas(assign, "vec_id long, v array<double>, leaf long"), "index")
    # At most as many leaves as the sample has rows.
    rows_of = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}

    hashed = F.pmod(F.xxhash64(F.lit("asked"), "query_id"), F.lit(1 << 30))
    n_queries = queries.count()
    few = queries.filter(hashed < int(min(1.0, CALIBRATION / max(1, n_queries)) * (1 << 30))).toPandas()
    if not len(few):
        few = queries.limit(1).toPandas()
    if not len(few):
        return spark.createDataFrame([], FOUND)
    asked = spark.sparkContext.broadcast(few.to_dict("list"))

    def brute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = pd.DataFrame(asked.value)
        for part in parts:
            if len(part):
                yield nearest(queries, part, k, ("leaf",))

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    true = index.mapInPandas(brute, "query_id long, vec_id long, score double, leaf long")
    true = true.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    wanted: dict[int, list[int]] = {}
    for r in true.select("query_id", "leaf").collect():  # CALIBRATION x k rows
        wanted.setdefault(r["query_id"], []).append(r["leaf"])
    needs = []
    for query, q in zip(few["query_id"], few["q"], strict=True):
        at = {leaf: i + 1 for i, leaf in enumerate(tree.order(np.asarray(q)))}
        needs += [at[x] for x in wanted.get(query, [])]
    needs.sort()
    visits = needs[max(0, -(-int(recall * 1000) * len(needs) // 1000) - 1)] if needs else 1

    counts = spark.sparkContext.broadcast(rows_of)

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, rows_of = Tree(*shared.value), counts.value
        for part in parts:
            out = []
            for query, q in zip(part["query_id"], part["q"], strict=True):
                seen = 0
                for i, leaf in enumerate(tree.order(np.asarray(q))):
                    if i >= visits and seen > k:
                        break
                    if leaf in rows_of:
                        seen += rows_of[leaf]
                        out.append((query, leaf))
            yield pd.DataFrame(out, columns=["query_id", "leaf"])

    routed = store(queries.mapInPandas(route, "query_id long, leaf long"), "visits")
    # At most a row a leaf, as many as the sample has rows.
    asked_of = {r["leaf"]: r["n"] for r in routed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    dealt_leaves = blocks(rows_of, asked_of) or [(-1, -1, 1, 1)]

    def plan() -> DataFrame:
        return F.broadcast(spark.createDataFrame(dealt_leaves, "leaf long, block long, row_blocks int, query_blocks int"))

    def dealt(ids: str, own: str, other: str):
        mine = F.pmod(F.xxhash64(F.lit("block"), ids), own).cast("int")
        return mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1))

    mine, every = dealt("vec_id", "row_blocks", "query_blocks")
    left = index.join(plan(), "leaf").withColumn("row_block", mine).withColumn("query_block", every)
    keys = ["block", "row_block", "query_block"]
    right = routed.join(plan(), "leaf").groupBy("query_id", "block", "row_blocks", "query_blocks").agg(F.collect_list("leaf").alias("leaves"))
    mine, every = dealt("query_id", "query_blocks", "row_blocks")
    right = right.withColumn("query_block", mine).withColumn("row_block", every).join(queries, "query_id")

    found = (
        left.select(*keys, "vec_id", "leaf", "v").groupBy(*keys)
        .cogroup(right.select(*keys, "query_id", "leaves", "q").groupBy(*keys))
        .applyInPandas(_all_pairs(k), "query_id long, vec_id long, score double")
    )
    return _ranked(found, k)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        table = store(vectors(docs(spark, sf_dir, "embeddings")), "vectors")
        queries = table.filter("vec_id % 100 = 0").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
        return store(search(table, store(queries, "queries")), "neighbours", lasting=True)


portable(__name__)
