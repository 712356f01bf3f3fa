"""Mutual information from nearest-neighbour distances (Kraskov's and Ross's estimators).

Values are held as integers of 2^-40 standard deviations, so that "nearer than the k-th
neighbour" is exact. One dimension: a row's neighbours stand within ``k`` places of it in
order; places are cut into buckets with ``k`` rows of their neighbours. Two dimensions: rows are
cut into strips of like size by x and these into leaves of like size by y; a row's k-th
distance within its leaf says which other leaves can hold nearer ones, and only these are
looked at. How many rows lie within a distance is the difference of two running counts, where rows
and bounds are sorted together by cells. No step pairs all rows, and none puts a feature
or class into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ordered import CELLS, cell_of, positions_within

UNIT = float(1 << 40)
BUCKET, LEAF = 4096, 32


def digamma(m: Column) -> Column:
    """Of a whole number from 1 on: eight steps up, then the asymptotic series."""
    z = m.cast("double") + 8
    low = F.lit(0.0)
    for i in range(8):
        low = low + 1 / (m.cast("double") + i)
    q = 1 / (z * z)
    return F.ln(z) - 1 / (2 * z) - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132)))) - low


def units(df: DataFrame, key: str, columns: Sequence[str], others: Sequence[str] = ()) -> DataFrame:
    """(id, others, _u0, _u1, ...): columns in units of their deviation; rows with a null or NaN in any go."""
    kept = df.select(F.col(key).alias("id"), *others, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_u{i}") for i, c in enumerate(columns)]).dropna()
    at = kept.agg(*[F.stddev_pop(f"_u{i}") for i in range(len(columns))]).first()
    return kept.withColumns({f"_u{i}": F.round(F.col(f"_u{i}") / F.lit(at[i] or 1.0) * UNIT).cast("long") for i in range(len(columns))})


def _tall(rows: DataFrame, features: Sequence[str], others: Sequence[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_u{i}").alias("v")) for i, f in enumerate(features)]))
    return rows.select("id", *others, each.alias("e")).select("id", *others, "e.*")


def counts_within(rows: DataFrame, value: str, reach: str, out: str) -> DataFrame:
    """(feature, id, out): the rows of a feature whose ``value`` is at most ``reach`` away.

    Every row is an event at its value and asks at both of its bounds; events and questions are
    sorted together by cells, and a running count answers."""
    v, r = F.col(value), F.col(reach)
    asks = F.array(
        F.struct(v.alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("one"), F.lit(0).alias("sign")),
        F.struct((v - r).alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("one"), F.lit(-1).alias("sign")),
        F.struct((v + r).alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("one"), F.lit(1).alias("sign")),
    )
    events = rows.select("feature", "id", F.explode(asks).alias("e")).select("feature", "id", "e.*")
    events = cut(events.withColumn("_cell", cell_of(rows.withColumn("at", v), "at", CELLS)))
    per = events.groupBy("feature", "_cell").agg(F.sum("one").alias("_k"))
    before = Window.partitionBy("feature").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a cell
    per = per.withColumn("_b", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    inside = Window.partitionBy("feature", "_cell").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.join(per, ["feature", "_cell"]).withColumn("_n", F.sum("one").over(inside) + F.col("_b"))
    return seen.filter("sign <> 0").groupBy("feature", "id").agg(F.sum(F.col("_n") * F.col("sign")).alias(out))


def _reach(radius: Column) -> Column:
    """The largest distance below a radius; 0 where the radius is 0."""
    return F.greatest(radius - 1, F.lit(0).cast("long"))


def mutual_info_classif(df: DataFrame, key: str, features: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """(feature, score): information in nats about a class, at least 0. Rows whose class has no other row
    take no part; ids must be distinct."""
    rows = _tall(units(df, key, features, [F.col(label).alias("label")]), features, ["label"])
    sizes = rows.groupBy("feature", "label").agg(F.count("*").alias("n")).filter("n > 1")
    rows = cut(rows.join(sizes, ["feature", "label"]))
    placed = positions_within(rows, ["feature", "label"], ["v", "id"], "p")
    b = F.floor(F.col("p") / BUCKET)
    places = F.array_distinct(F.array(b, F.floor((F.col("p") - k) / BUCKET), F.floor((F.col("p") + k) / BUCKET)))
    dealt = placed.withColumn("own", b).withColumn("bucket", F.explode(places))
    w = Window.partitionBy("feature", "label", "bucket").orderBy("p")
    gaps = [g for j in range(1, k + 1) for g in (F.col("v") - F.lag("v", j).over(w), F.lead("v", j).over(w) - F.col("v"))]
    near = dealt.withColumn("gaps", F.array(*gaps)).filter("bucket = own").withColumn("k", F.least(F.lit(k).cast("long"), F.col("n") - 1))
    radius = F.get(F.array_sort(F.array_compact("gaps")), (F.col("k") - 1).cast("int"))
    near = cut(near.select("feature", "id", "v", "n", "k", _reach(radius).alias("reach")))
    m = counts_within(near, "v", "reach", "m")
    of_m = m.groupBy("feature").agg(F.avg(digamma(F.col("m"))).alias("psi_m"))
    rest = near.groupBy("feature").agg((digamma(F.count("*")) + F.avg(digamma(F.col("k"))) - F.avg(digamma(F.col("n")))).alias("base"))
    return rest.join(of_m, "feature").select("feature", F.greatest(F.col("base") - F.col("psi_m"), F.lit(0.0)).alias("score"))


def _leaves(rows: DataFrame) -> DataFrame:
    """``rows`` (feature, id, v, y) with strip and leaf: strips of like size by v, each cut into leaves of
    ``LEAF`` to twice as many rows by y."""
    n = rows.groupBy("feature").agg(F.count("*").alias("_n"))
    rows = positions_within(rows, ["feature"], ["v", "id"], "_p").join(F.broadcast(n), "feature")  # a row a feature
    strips = F.greatest(F.floor(F.sqrt(F.col("_n") / LEAF)), F.lit(1))
    rows = cut(rows.withColumn("strip", F.floor(F.col("_p") * strips / F.col("_n"))).drop("_p", "_n"))
    n = rows.groupBy("feature", "strip").agg(F.count("*").alias("_n"))
    rows = positions_within(rows, ["feature", "strip"], ["y", "id"], "_p").join(n, ["feature", "strip"])
    leaves = F.greatest(F.floor(F.col("_n") / LEAF), F.lit(1))
    return rows.withColumn("leaf", F.floor(F.col("_p") * leaves / F.col("_n"))).drop("_p", "_n")


def joint_radius(rows: DataFrame, k: int) -> DataFrame:
    """(feature, id, v, y, radius): distance, the larger of both axes', to a row's k-th neighbour."""
    rows = cut(_leaves(rows))
    held = cut(rows.groupBy("feature", "strip", "leaf").agg(F.collect_list(F.struct("id", "v", "y")).alias("points"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.min("y").alias("y0"), F.max("y").alias("y1")))

    def gaps(points: Column, v: Column, y: Column) -> Column:
        return F.array_sort(F.transform(points, lambda p: F.greatest(F.abs(p["v"] - v), F.abs(p["y"] - y))))

    own = held.select("feature", "strip", "leaf", "points", F.explode("points").alias("p"))
    own = own.select("feature", "strip", "leaf", "p.*", F.slice(gaps(F.col("points"), F.col("p.v"), F.col("p.y")), 1, k + 1).alias("near"))
    far = F.lit(1 << 62).cast("long")
    own = cut(own.withColumn("bound", F.coalesce(F.get("near", F.lit(k)), far)))  # the row itself comes first
    strips = held.groupBy("feature", "strip").agg(F.min("v0").alias("v0"), F.max("v1").alias("v1"), F.collect_list(F.struct("leaf", "y0", "y1")).alias("leaves"))
    lines = strips.groupBy("feature").agg(F.collect_list(F.struct("strip", "v0", "v1")).alias("strips"))  # a feature has sqrt(rows / LEAF) strips
    r = F.col("bound")
    cross = own.filter("bound > 0").join(lines, "feature").withColumnRenamed("strip", "strip0").withColumnRenamed("leaf", "leaf0")
    cross = cross.withColumn("strip", F.explode(F.transform(F.filter("strips", lambda s: (s["v0"] - F.col("v") < r) & (F.col("v") - s["v1"] < r)), lambda s: s["strip"]))).drop("strips")
    cross = cross.join(strips.select("feature", "strip", "leaves"), ["feature", "strip"])
    open_ = F.filter("leaves", lambda x: (x["y0"] - F.col("y") < r) & (F.col("y") - x["y1"] < r) & ~((x["leaf"] == F.col("leaf0")) & (F.col("strip") == F.col("strip0"))))
    cross = cross.withColumn("leaf", F.explode(F.transform(open_, lambda x: x["leaf"]))).drop("leaves", "near")
    cross = cross.join(held.select("feature", "strip", "leaf", "points"), ["feature", "strip", "leaf"])
    more = cross.select("feature", "id", F.slice(F.filter(gaps(F.col("points"), F.col("v"), F.col("y")), lambda g: g < r), 1, k).alias("more"))
    more = more.groupBy("feature", "id").agg(F.flatten(F.collect_list("more")).alias("more"))
    both = own.join(more, ["feature", "id"], "left").withColumn("all", F.array_sort(F.concat("near", F.coalesce("more", F.array().cast("array<long>")))))
    return both.select("feature", "id", "v", "y", F.get("all", F.lit(k)).alias("radius"))


def mutual_info_regr(df: DataFrame, key: str, features: Sequence[str], target: str, k: int = 3) -> DataFrame:
    """(feature, score): information in nats about a number, at least 0; null with ``k`` rows or fewer. Ids
    must be distinct."""
    wide = units(df, key, [*features, target])
    y = F.col(f"_u{len(features)}").alias("y")
    rows = _tall(wide.withColumn("y", y), features, ["y"])
    near = cut(joint_radius(rows, k).withColumn("reach", _reach(F.col("radius"))))
    nx = counts_within(near, "v", "reach", "nx")
    ny = counts_within(near, "y", "reach", "ny")
    both = nx.join(ny, ["feature", "id"]).groupBy("feature").agg(F.avg(digamma(F.col("nx")) + digamma(F.col("ny"))).alias("psi"), F.count("*").alias("n"))
    score = digamma(F.col("n")) + digamma(F.lit(k)) - F.col("psi")
    return both.select("feature", F.when(F.col("n") > k, F.greatest(score, F.lit(0.0))).alias("score"))
