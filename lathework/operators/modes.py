"""Mean shift by cells.

Seeds are the occupied bins of the window's width. A seed moves to the mean of the rows within the
window until it stays; of seeds that end close together the one with most rows is a
centre, and every row belongs to its nearest centre."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ordered import positions_within

MAX_FEATURES = 4
#: Centres up to which the rows see all of them at once; further ones are met by cells.
FEW = 2000


def _total(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def mean_shift(df: DataFrame, key: str, features: Sequence[str], bandwidth: float, steps: int = 300, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(key, cluster) of every row and (cluster, n, a column a feature) of every centre, the one with most
    rows in its window first (ties: the greater coordinates). A seed whose window is empty vanishes; it stays when
    it moves less than a thousandth of ``bandwidth``, or after ``steps`` moves. Bins with fewer than ``least``
    rows are no seeds. Up to four features; rows with a null or NaN feature have a null cluster.

    Rows alike are moved as one with their number. A step joins them with the seeds of the cells around theirs,
    of which each cell has 3 to the power of the features at most as long as seeds haven't moved, and adds up
    before the shuffle, so that a hot cell's rows meet in no task. Seeds that stay are set aside. Where seeds are many they grow with the
    space that rows occupy, not with the rows."""
    dims = len(features)
    if not 1 <= dims <= MAX_FEATURES:
        raise ValueError(f"mean_shift takes one to {MAX_FEATURES} features")
    names = [f"_x{i}" for i in range(dims)]
    rows = df.select(F.col(key).alias("_key"), *[(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) + 0.0).alias(n) for f, n in zip(features, names, strict=True)])
    cell = F.array(*[F.floor(F.col(n) / bandwidth) for n in names])
    places = cut(rows.dropna(subset=names).groupBy(*names).agg(F.count("*").alias("w")).withColumn("cell", cell))
    bins = [F.round(F.col(n) / bandwidth) * bandwidth for n in names]
    seeds = places.groupBy(*[b.alias(n) for b, n in zip(bins, names, strict=True)]).agg(F.sum("w").alias("w")).filter(F.col("w") >= least).drop("w")
    active = cut(seeds.withColumn("seed", F.array(*names)).withColumn("n", F.lit(0).cast("long")))
    steps_around = list(product((-1, 0, 1), repeat=dims))
    done = active.limit(0)
    for step in range(steps):
        if active.isEmpty():
            break
        at = [F.floor(F.col(n) / bandwidth) for n in names]
        near = F.array(*[F.array(*[a + o for a, o in zip(at, some, strict=True)]) for some in steps_around])
        asked = active.select("seed", *[F.col(n).alias(f"s{n}") for n in names], F.explode(near).alias("cell"))
        gap = _total([(F.col(n) - F.col(f"s{n}")) * (F.col(n) - F.col(f"s{n}")) for n in names])
        met = places.join(asked, "cell").filter(gap <= F.lit(bandwidth * bandwidth))
        old = [F.first(f"s{n}").alias(f"s{n}") for n in names]
        moved = met.groupBy("seed").agg(F.sum("w").alias("n"), *[(F.sum(F.col(n) * F.col("w")) / F.sum("w")).alias(n) for n in names], *old)
        far = _total([(F.col(n) - F.col(f"s{n}")) * (F.col(n) - F.col(f"s{n}")) for n in names])
        moved = cut(moved.withColumn("_stays", far <= F.lit((1e-3 * bandwidth) ** 2)))
        kept = moved.filter(F.col("_stays") | F.lit(step == steps - 1))
        done = done.unionByName(kept.select(done.columns))
        active = moved.filter(~F.col("_stays")).select(active.columns)
    centres = _best(cut(done), names, bandwidth)
    labelled = rows.join(_nearest(places, centres, names, bandwidth), names, "left")
    named = centres.select("cluster", "n", *[F.col(n).alias(f) for n, f in zip(names, features, strict=True)])
    return labelled.select(F.col("_key").alias(key), "cluster"), named


def _best(ended: DataFrame, names: list[str], bandwidth: float) -> DataFrame:
    """(cluster, n, place): the ends that no better one lies within ``bandwidth`` of, unless that
    one fell away itself. Ends are decided in rounds: an end with no better undecided one near it is a
    centre and takes those near it away."""
    ends = ended.groupBy(*names).agg(F.max("n").alias("n"))
    ends = cut(ends.withColumn("rank", F.struct("n", *names)).withColumn("cell", F.array(*[F.floor(F.col(n) / bandwidth) for n in names])))
    around = F.array(*[F.array(*[F.col("cell")[i] + x for i, x in enumerate(o)]) for o in product((-1, 0, 1), repeat=len(names))])
    left, centres = ends, None

    def pairs(some: DataFrame, others: DataFrame) -> DataFrame:
        there = others.select(F.explode(around).alias("cell"), F.col("rank").alias("other"))
        gap = _total([(F.col(n) - F.col("other")[n]) * (F.col(n) - F.col("other")[n]) for n in names])
        return some.join(there, "cell").filter(gap <= F.lit(bandwidth * bandwidth))

    while not left.isEmpty():
        beaten = pairs(left, left).filter(F.col("other") > F.col("rank")).select("rank").distinct()
        top = cut(left.join(beaten, "rank", "left_anti"))
        centres = top if centres is None else centres.unionByName(top.select(centres.columns))
        left = cut(left.join(pairs(left, top).select("rank").distinct(), "rank", "left_anti"))
    if centres is None:
        centres = ends
    return cut(positions_within(centres.select("n", *names), [], ["n", *names], "cluster", descending=True))


def _nearest(places: DataFrame, centres: DataFrame, names: list[str], bandwidth: float) -> DataFrame:
    """(place, cluster): the nearest centre, ties to the lower cluster."""
    def far(c: Column) -> Column:
        gap = _total([(F.col(n) - c[n]) * (F.col(n) - c[n]) for n in names])
        return F.struct(gap.alias("d"), c["cluster"].alias("cluster"))

    there = centres.select(F.struct("cluster", *names).alias("_c"))
    if centres.count() <= FEW:
        every = there.agg(F.collect_list("_c").alias("_all"))  # one row of at most FEW centres
        return places.crossJoin(F.broadcast(every)).select(*names, F.array_min(F.transform("_all", far))["cluster"].alias("cluster"))
    best = F.min(far(F.col("_c")))["cluster"].alias("cluster")
    # A row's bin was a seed or is within a window of one, mostly; the rest widen their search.
    reach, open_, out = 1, places, None
    while not open_.isEmpty():
        width = bandwidth * reach
        cell = F.array(*[F.floor(F.col(n) / width) for n in names])
        at = [F.floor(F.col("_c")[n] / width) for n in names]
        near = F.array(*[F.array(*[a + x for a, x in zip(at, o, strict=True)]) for o in product((-1, 0, 1), repeat=len(names))])
        met = open_.withColumn("cell", cell).join(there.withColumn("cell", F.explode(near)), "cell").filter(far(F.col("_c"))["d"] <= F.lit(width * width))
        found = cut(met.groupBy(*names).agg(best))
        out = found if out is None else out.unionByName(found)
        open_, reach = cut(open_.join(found, names, "left_anti")), reach * 2
    return out if out is not None else places.select(*names, F.lit(None).cast("long").alias("cluster"))
