"""Spectral clustering by cells.

Rows stand at the mean of their cell, so that the affinity graph has a node an occupied cell and
edges to the cells around it only: its size is linear in the rows, and a hot cell is one node with its
number of rows as weight. The leading eigenvectors of the normalised graph come from subspace iteration
with a Chebyshev filter; a multiplication is one aggregation of what each node sends to its
neighbours, and the driver sees matrices as wide as the number of vectors only."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

MAX_FEATURES = 4
MAX_CLUSTERS = 10
#: Cells along an axis up to which two cells have an affinity.
REACH = 2
#: Vectors beyond those wanted, and multiplications between two orthonormalisations.
SPARE, DEGREE = 4, 12


def _total(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _numbers(features: Sequence[str], names: Sequence[str]) -> list[Column]:
    return [(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) + 0.0).alias(n) for f, n in zip(features, names, strict=True)]


def affinity(df: DataFrame, features: Sequence[str], width: float, gamma: float | None = None, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (cell, n, degree, a mean a feature as m0, m1, ...) and edges (a, b, weight) of the affinity
    graph: cells of ``width`` with at least ``least`` rows, each edge n_a n_b exp(-gamma d^2) of the distance
    d of the means, both ways, for cells at most ``REACH`` steps apart along every axis, itself included.
    ``gamma`` is 1 / width^2 unless given. Rows with a null or NaN feature are left out."""
    if not 1 <= len(features) <= MAX_FEATURES:
        raise ValueError(f"affinity takes one to {MAX_FEATURES} features")
    if width <= 0 or (gamma is not None and gamma <= 0):
        raise ValueError("width and gamma are above zero")
    names = [f"m{i}" for i in range(len(features))]
    sharp = 1 / width**2 if gamma is None else gamma
    rows = df.select(*_numbers(features, names)).dropna()
    cell = F.array(*[F.floor(F.col(n) / width) for n in names])
    cells = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), *[F.avg(n).alias(n) for n in names])
    cells = cut(cells.filter(F.col("n") >= least))
    around = F.array(*[F.array(*[F.col("cell")[i] + x for i, x in enumerate(o)]) for o in product(range(-REACH, REACH + 1), repeat=len(names))])
    a = cells.select(F.col("cell").alias("a"), F.col("n").alias("na"), *[F.col(n).alias(f"a{n}") for n in names], F.explode(around).alias("b"))
    b = cells.select(F.col("cell").alias("b"), F.col("n").alias("nb"), *names)
    gap = _total([(F.col(n) - F.col(f"a{n}")) * (F.col(n) - F.col(f"a{n}")) for n in names])
    edges = cut(a.join(b, "b").select("a", "b", (F.col("na") * F.col("nb") * F.exp(-F.lit(sharp) * gap)).alias("weight")))
    degrees = edges.groupBy(F.col("a").alias("cell")).agg(F.sum("weight").alias("degree"))
    return cells.join(degrees, "cell").select("cell", "n", "degree", *names), edges


def _times(state: DataFrame, wide: int, scale: float, own: float, old: float) -> DataFrame:
    """(cell, near, p, v): p becomes v and v becomes scale * S v + own * v + old * p. A node sends to those in ``near``,
    itself among them, and what it sends to itself carries its own state, so that a multiplication is one aggregation
    and no join."""
    met = state.select("cell", "near", "p", "v", F.explode("near").alias("to"))
    each = range(wide)
    sent = [f"to.s * {scale!r}D * v[{i}] + IF(cell = to.a, {own!r}D * v[{i}] + {old!r}D * p[{i}], 0D) AS v{i}" for i in each]
    kept = [f"IF(cell = to.a, v[{i}], 0D) AS p{i}" for i in each]
    met = met.selectExpr("to.a AS _to", "IF(cell = to.a, near, NULL) AS near", *sent, *kept)
    sums = [F.expr(f"sum({x}{i}) AS {x}{i}") for x in "vp" for i in each]
    out = met.groupBy(F.col("_to").alias("cell")).agg(F.expr("first(near, true) AS near"), *sums)
    return out.selectExpr("cell", "near", *[f"array({', '.join(f'{x}{i}' for i in each)}) AS {x}" for x in "pv"])


def _grams(state: DataFrame, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of p with p, p with v and v with v, summed over the nodes; v is S p."""
    pairs = [(i, j) for i in range(wide) for j in range(i, wide)]
    row = state.selectExpr(*[f"sum({x}[{i}] * {y}[{j}]) AS {x}{y}{i}_{j}" for x, y in ("pp", "pv", "vv") for i, j in pairs]).first()
    out = []
    for k in ("pp", "pv", "vv"):
        m = np.zeros((wide, wide))
        for i, j in pairs:
            m[i, j] = m[j, i] = row[f"{k}{i}_{j}"]
        out.append(m)
    return tuple(out)


def _turned(column: str, by: np.ndarray) -> Column:
    """The array times the matrix ``by``."""
    terms = [" + ".join(f"{column}[{i}] * {float(by[i, j])!r}D" for i in range(by.shape[0])) for j in range(by.shape[1])]
    return F.expr(f"array({', '.join(terms)})")


def eigenvectors(nodes: DataFrame, edges: DataFrame, wanted: int, rounds: int = 30, tolerance: float = 1e-4) -> tuple[DataFrame, list[float]]:
    """(cell, u) with the ``wanted`` leading eigenvectors of the graph's D^-1/2 W D^-1/2 as an array, orthonormal over
    the nodes, and their eigenvalues, falling. It starts at numbers from the cell's md5 and ends when each residual is below
    ``tolerance``, or after ``rounds``. Fewer nodes than vectors give as many as there are."""
    root = nodes.select("cell", F.sqrt("degree").alias("r"))
    a, b = root.select(F.col("cell").alias("a"), F.col("r").alias("ra")), root.select(F.col("cell").alias("b"), F.col("r").alias("rb"))
    met = edges.join(a, "a").join(b, "b").select(F.col("b").alias("cell"), F.struct("a", (F.col("weight") / (F.col("ra") * F.col("rb"))).alias("s")).alias("e"))
    near = met.groupBy("cell").agg(F.collect_list("e").alias("near"))  # at most the cells around one
    wide = min(wanted + SPARE, nodes.count())
    if not wide:
        return root.select("cell", F.array().cast("array<double>").alias("u")), []
    dice = [F.conv(F.md5(F.concat_ws(":", F.lit(i), F.array_join(F.col("cell").cast("array<string>"), ",")))[0:8], 16, 10).cast("double") / 2**31 - 1 for i in range(1, wide)]
    start = F.array(F.col("r"), *[F.col("r") * x for x in dice])
    state = near.join(root, "cell").select("cell", "near", start.alias("p"), start.alias("v"))
    for i in range(rounds):
        state = cut(_times(state, wide, 1.0, 0.0, 0.0))
        own, mixed, double = _grams(state, wide)
        size, base = np.linalg.eigh(own)
        good = size > size[-1] * 1e-12
        base = base[:, good] / np.sqrt(size[good])
        values, turn = np.linalg.eigh(base.T @ mixed @ base)
        values, turn = values[::-1], (base @ turn)[:, ::-1]
        left = np.sqrt(np.maximum(np.diag(turn.T @ double @ turn) - values**2, 0.0))
        wide, wanted = len(values), min(wanted, len(values))
        # Where the vectors span every node, or all are found, there is nothing left to filter.
        if i == rounds - 1 or left[:wanted].max() < tolerance or left.max() < 1e-7:
            return cut(state.select("cell", _turned("p", turn[:, :wanted]).alias("u"))), [float(x) for x in values[:wanted]]
        # Eigenvalues between -1 and the least one held are kept small, those above grow.
        top = min(float(values[-1]), 1 - 1e-6)
        half, middle = (top + 1) / 2, (top - 1) / 2
        state = state.select("cell", "near", _turned("p", turn).alias("p"), _turned("p", turn).alias("v"))
        state = _times(state, wide, 1 / half, -middle / half, 0.0)
        for _ in range(DEGREE - 1):
            state = _times(state, wide, 2 / half, -2 * middle / half, -1.0)
    raise AssertionError("unreachable")


def _centres(places: DataFrame, k: int) -> np.ndarray:
    """The places to start from: the heaviest one, then each time the one with most weight outside of
    the directions taken (a pivoted QR decomposition)."""
    taken: list[np.ndarray] = []
    out = []
    for _ in range(k):
        rest = F.lit(1.0) - _total([F.lit(0.0), *[_total([F.col("u")[i] * float(q[i]) for i in range(k)]) ** 2 for q in taken]])
        row = places.agg(F.max_by("u", F.struct(F.round(rest * F.col("n"), 6), "cell")).alias("u")).first()
        u = np.array(row["u"], dtype=float)
        out.append(u)
        left = u - sum(((u @ q) * q for q in taken), np.zeros(k))
        size = np.linalg.norm(left)
        taken.append(left / size if size > 1e-9 else np.zeros(k))
    return np.array(out)


def spectral(df: DataFrame, key: str, features: Sequence[str], k: int | None, width: float, gamma: float | None = None, least: int = 1) -> DataFrame:
    """(key, cluster): ``k`` clusters of the affinity graph, the one with most rows first (ties: the least
    cell). Without ``k`` it is the one from 2 to ``MAX_CLUSTERS`` after which the eigenvalues fall most. Rows of cells with fewer than ``least``
    rows aren't in the graph; they take the cluster of the nearest graph cell at most ``REACH`` steps away (ties: the least), or null
    if there is none. Rows with a null or NaN feature have a null cluster. Up to four features.

    Each part of the graph that has no edge to the rest is worth a cluster, so ``width`` and ``least`` must
    leave fewer such parts than there are clusters. Fewer cells than ``k`` are a cluster each."""
    if k is not None and not 1 <= k <= MAX_CLUSTERS:
        raise ValueError(f"spectral takes one to {MAX_CLUSTERS} clusters")
    names = [f"m{i}" for i in range(len(features))]
    nodes, edges = affinity(df, features, width, gamma, least)
    nodes = cut(nodes)
    vectors, values = eigenvectors(nodes, edges, k or MAX_CLUSTERS + 1)
    if k is None:
        k = max(range(2, len(values)), key=lambda i: (values[i - 1] - values[i], -i)) if len(values) > 2 else max(1, len(values))
    k = min(k, len(values))
    labels = _labels(nodes, vectors, k) if k else nodes.select("cell", F.lit(None).cast("int").alias("cluster"))
    rows = df.select(F.col(key).alias("_key"), *_numbers(features, names))
    cell = F.when(_total([F.col(n) for n in names]).isNotNull(), F.array(*[F.floor(F.col(n) / width) for n in names]))
    rows = rows.withColumn("cell", cell)
    if least > 1:
        labels = labels.unionByName(_light(rows, nodes, labels, names))
    return rows.join(labels, "cell", "left").select(F.col("_key").alias(key), "cluster")


def _labels(nodes: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(cell, cluster): k-means over the directions of the nodes' rows of eigenvectors, weighted by rows."""
    length = F.sqrt(_total([F.col("u")[i] ** 2 for i in range(k)]))
    unit = F.array(*[F.coalesce(F.try_divide(F.col("u")[i], length), F.lit(0.0)) for i in range(k)])
    places = cut(vectors.select("cell", unit.alias("u")).join(nodes.select("cell", "n"), "cell"))
    centres = _centres(places, k)

    def nearest() -> Column:
        far = [F.struct(_total([(F.col("u")[i] - float(c[i])) ** 2 for i in range(k)]).alias("d"), F.lit(j).alias("j")) for j, c in enumerate(centres)]
        return F.least(*far)["j"] if k > 1 else F.lit(0)

    for _ in range(50):
        met = places.withColumn("j", nearest()).groupBy("j").agg(*[(F.sum(F.col("u")[i] * F.col("n")) / F.sum("n")).alias(f"c{i}") for i in range(k)])
        moved = centres.copy()
        for r in met.collect():  # a row a cluster
            moved[r["j"]] = [r[f"c{i}"] for i in range(k)]
        still, centres = np.abs(moved - centres).max() < 1e-9, moved
        if still:
            break
    found = places.select("cell", "n", nearest().alias("j"))
    order = found.groupBy("j").agg(F.sum("n").alias("n"), F.min("cell").alias("c")).orderBy(F.desc("n"), "c").collect()  # a row a cluster
    name = F.lit(None).cast("int")
    for at, r in enumerate(order):
        name = F.when(F.col("j") == r["j"], F.lit(at)).otherwise(name)
    return found.select("cell", name.alias("cluster"))


def _light(rows: DataFrame, nodes: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """(cell, cluster) of the cells near the graph that aren't in it, by the nearest mean."""
    light = rows.dropna(subset=["cell"]).groupBy("cell").agg(*[F.avg(n).alias(f"x{n}") for n in names]).join(nodes, "cell", "left_anti")
    around = F.array(*[F.array(*[F.col("cell")[i] + x for i, x in enumerate(o)]) for o in product(range(-REACH, REACH + 1), repeat=len(names))])
    there = nodes.join(labels, "cell").select(F.col("cell").alias("at"), "cluster", *names)
    met = light.withColumn("at", F.explode(around)).join(there, "at")
    gap = _total([(F.col(n) - F.col(f"x{n}")) ** 2 for n in names])
    return met.groupBy("cell").agg(F.min_by("cluster", F.struct(gap, "at")).alias("cluster"))
