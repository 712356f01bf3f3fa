"""Density clustering by cells.

``dbscan`` cuts space into cells whose points are all within ``eps`` of one another, so
that a cell with ``min_samples`` points is core as it stands: no pair of its points
is looked at. Only points of sparser cells are counted, against the few cells around
them; a cell has fewer than ``min_samples`` of these, so that the pairs grow with the rows.
Core cells are joined where two of their points are within ``eps``: boxes around the
points decide that, and those that leave it open are halved until they don't."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import components

MAX_FEATURES = 4
#: Points of a box up to which a pair of boxes is decided point by point.
FEW = 32


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def around(dims: int, reach: float) -> list[tuple[int, ...]]:
    """Steps to the cells that may hold a point within ``reach`` cell widths."""
    r = ceil(reach)
    return [o for o in product(range(-r, r + 1), repeat=dims) if sum(max(0, abs(x) - 1) ** 2 for x in o) <= reach * reach]


def _moved(cell: str, step: tuple[int, ...]) -> Column:
    return F.array(*[F.col(cell)[i] + x for i, x in enumerate(step)])


def dbscan(df: DataFrame, key: str, features: Sequence[str], eps: float, min_samples: int) -> DataFrame:
    """(key, cluster, core): a row of ``df`` is core if ``min_samples`` rows, itself included, are
    within ``eps``; core rows within ``eps`` share a cluster, named by its least core key; other
    rows within ``eps`` of a core row take the least such cluster, and the rest have a null one.

    Up to four features. Rows with a null or NaN feature are in no cluster. Rows alike in
    all features are looked at once, with their number as weight."""
    dims = len(features)
    if not 1 <= dims <= MAX_FEATURES:
        raise ValueError(f"dbscan takes one to {MAX_FEATURES} features")
    names = [f"_x{i}" for i in range(dims)]
    # A hair narrower than eps / sqrt(dims), so that rounding can't part what shares a cell.
    width = eps / sqrt(dims) * (1 - 1e-9)
    steps = around(dims, eps / width)
    rows = df.select(F.col(key).alias("_key"), *[(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) + 0.0).alias(n) for f, n in zip(features, names, strict=True)])
    good = rows.dropna(subset=names)
    scaled = [F.col(n) / width for n in names]
    places = good.groupBy(*names).agg(F.count("*").alias("w"), F.min("_key").alias("k"))
    places = cut(places.withColumn("cell", F.array(*[F.floor(s) for s in scaled])))

    def gap(a: str, b: str) -> Column:
        return _sum([(F.col(f"{a}{n}") - F.col(f"{b}{n}")) * (F.col(f"{a}{n}") - F.col(f"{b}{n}")) for n in names])

    def spread(some: DataFrame) -> DataFrame:
        """(cell, near): for every cell, the places of ``some`` in and around it, fewer than
        ``min_samples`` a cell around it."""
        each = some.select(F.explode(F.array(*[_moved("cell", s) for s in steps])).alias("cell"), F.struct("k", *names).alias("p"))
        return each.groupBy("cell").agg(F.collect_list("p").alias("near"))

    def pairs(some: DataFrame, others: DataFrame) -> DataFrame:
        """(k, *): places of ``some`` (prefix q) within eps of each of ``others``."""
        met = others.join(spread(some), "cell").select("w", F.col("k").alias("own"), *[F.col(n).alias(f"p{n}") for n in names], F.explode("near").alias("q"))
        met = met.select("w", "own", *[f"p{n}" for n in names], F.col("q.k").alias("k"), *[F.col(f"q.{n}").alias(f"q{n}") for n in names])
        return met.filter(gap("p", "q") <= F.lit(eps * eps))

    full = places.groupBy("cell").agg(F.sum("w").alias("n"))
    sparse = places.join(full.filter(F.col("n") < min_samples), "cell", "left_semi")
    counted = pairs(sparse, places).groupBy("k").agg(F.sum("w").alias("n")).filter(F.col("n") >= min_samples).select("k")
    dense = full.filter(F.col("n") >= min_samples).select("cell")
    core = cut(places.join(dense, "cell", "left_semi").unionByName(sparse.join(counted, "k", "left_semi").select(places.columns)))

    cells = core.groupBy("cell").agg(F.min("k").alias("label"))
    joined = _linked_cells(core, names, scaled, steps, eps)
    graph = joined.unionByName(cells.select(F.col("cell").alias("a"), F.col("cell").alias("b")))
    labels = components(graph).join(cells, F.col("node") == F.col("cell")).select("cell", "component", "label")
    least = labels.groupBy("component").agg(F.min("label").alias("cluster"))
    of_cell = labels.join(least, "component").select("cell", "cluster")
    of_core = cut(core.join(of_cell, "cell"))

    border = sparse.join(of_core.select("k"), "k", "left_anti")
    reached = pairs(border, of_core.select("cell", "k", *names, F.col("cluster").alias("w"))).groupBy("k").agg(F.min("w").alias("cluster"))
    of_border = places.join(reached, "k").select(*names, "cluster", F.lit(False).alias("core"))
    found = of_core.select(*names, "cluster", F.lit(True).alias("core")).unionByName(of_border)
    out = rows.join(found, names, "left")
    return out.select(F.col("_key").alias(key), "cluster", F.coalesce("core", F.lit(False)).alias("core"))


def _linked_cells(core: DataFrame, names: list[str], scaled: list[Column], steps: list[tuple[int, ...]], eps: float) -> DataFrame:
    """(a, b): pairs of cells with a core place each within ``eps`` of one another.

    Places are held in boxes, a cell each at first. A pair of boxes whose farthest corners are within
    ``eps`` links its cells; one whose nearest aren't is dropped; the boxes of others are halved along
    every axis, down to boxes of ``FEW`` places, which are compared one by one."""
    limit = F.lit(eps * eps)
    linked, level, open_ = None, 0, None
    edges = [f(n).alias(f"{side}{n}") for n in names for side, f in (("lo", F.min), ("hi", F.max))]
    columns = [f"{side}{n}" for n in names for side in ("lo", "hi")]
    while True:
        boxes = core.withColumn("box", F.array(*[F.floor(s * float(1 << level)) for s in scaled]))
        boxes = boxes.groupBy("cell", "box").agg(F.count("*").alias("n"), *edges)
        a = boxes.select(F.col("cell").alias("a"), F.col("box").alias("boxa"), F.col("n").alias("na"), *[F.col(c).alias(f"a{c}") for c in columns])
        b = boxes.select(F.col("cell").alias("b"), F.col("box").alias("boxb"), F.col("n").alias("nb"), *[F.col(c).alias(f"b{c}") for c in columns])
        if open_ is None:
            half = [s for s in steps if s > (0,) * len(names)]
            both = a.withColumn("b", F.explode(F.array(*[_moved("a", s) for s in half]))).join(b, "b")
        else:
            up = lambda box: F.transform(box, lambda x: F.floor(x / 2))
            both = open_.select("a", "b", "boxa", "boxb").withColumnsRenamed({"boxa": "upa", "boxb": "upb"})
            both = both.join(a.withColumn("upa", up(F.col("boxa"))), ["a", "upa"]).join(b.withColumn("upb", up(F.col("boxb"))), ["b", "upb"])
        far, near = [], []
        for n in names:
            al, ah, bl, bh = (F.col(f"{x}{side}{n}") for x in "ab" for side in ("lo", "hi"))
            most = F.greatest(F.abs(ah - bl), F.abs(bh - al))
            least = F.greatest(bl - ah, al - bh, F.lit(0.0))
            far.append(most * most)
            near.append(least * least)
        both = cut(both.withColumn("sure", _sum(far) <= limit).filter(_sum(near) <= limit).select("a", "b", "boxa", "boxb", "na", "nb", "sure"))
        sure = both.filter("sure").select("a", "b").distinct()
        linked = sure if linked is None else cut(linked.unionByName(sure))
        open_ = both.filter("not sure").join(linked, ["a", "b"], "left_anti")
        few = open_.filter((F.col("na") <= FEW) & (F.col("nb") <= FEW))
        linked = linked.unionByName(_near_places(core, few, names, scaled, level, limit))
        open_ = open_.filter((F.col("na") > FEW) | (F.col("nb") > FEW))
        if open_.isEmpty():
            return linked.distinct()
        level += 1


def _near_places(core: DataFrame, pairs: DataFrame, names: list[str], scaled: list[Column], level: int, limit: Column) -> DataFrame:
    boxes = core.withColumn("box", F.array(*[F.floor(s * float(1 << level)) for s in scaled]))
    side = lambda x: boxes.select(F.col("cell").alias(x), F.col("box").alias(f"box{x}"), *[F.col(n).alias(f"{x}{n}") for n in names])
    met = pairs.select("a", "b", "boxa", "boxb").join(side("a"), ["a", "boxa"]).join(side("b"), ["b", "boxb"])
    gap = _sum([(F.col(f"a{n}") - F.col(f"b{n}")) * (F.col(f"a{n}") - F.col(f"b{n}")) for n in names])
    return met.filter(gap <= limit).select("a", "b").distinct()
