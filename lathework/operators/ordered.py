"""Running sums, ranks and neighbours over a whole table's order.

A window without partitions would put every row in one task. Here the order is
cut into cells by approximate quantiles; sums run inside a cell and start from
the total of the cells before, a table of one row a cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 256


def cell_of(df: DataFrame, order: str, cells: int = CELLS) -> Column:
    """Number of the cell of ``order`` (a numeric column without nulls)."""
    edges = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / cells for i in range(1, cells)], 10_000)).first()[0] or []
    edges = sorted(set(edges))
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(order).cast("double")))


def cumulative(df: DataFrame, order: str, sums: dict[str, str], following: str | None = None, cells: int = CELLS) -> DataFrame:
    """Adds, for each (out, column) of ``sums``, the sum of the column up to and
    with the row in ascending ``order``, whose values must be distinct.
    ``following`` names a column for the next value of ``order``."""
    rows = df.withColumn("_cell", cell_of(df, order, cells))
    inside = Window.partitionBy("_cell").orderBy(order)
    per = rows.groupBy("_cell").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()], F.min(order).alias("_first"))
    by_cell = Window.orderBy("_cell")  # one row a cell, CELLS at most
    before = by_cell.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_cell", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums], F.lead("_first").over(by_cell).alias("_after"))
    out = rows.join(F.broadcast(per), "_cell")
    running = {o: F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"_b_{o}") for o, c in sums.items()}
    if following:
        running[following] = F.coalesce(F.lead(order).over(inside), F.col("_after"))
    return out.withColumns(running).drop("_cell", "_after", *[f"_b_{o}" for o in sums])


def mid_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the average rank (from 1) of ``column``; ties share theirs; null stays null."""
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = cumulative(values, "_v", {"_upto": "_n"}).select("_v", (F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).alias(out))
    return df.join(ranked, F.col(column) == F.col("_v"), "left").drop("_v")


def positions(df: DataFrame, order: str, out: str, start: int = 0) -> DataFrame:
    """Numbers rows in ascending ``order``, whose values must be distinct."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return cumulative(one, order, {out: "_one"}).withColumn(out, F.col(out) + start - 1).drop("_one")


def positions_within(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str, descending: bool = False, cells: int = CELLS) -> DataFrame:
    """Numbers rows from 0 inside each group (null is a group), in the order of several
    columns; nulls come first, or last if ``descending``.

    A hot group isn't sorted in one task: the first column of ``order``, numeric or of
    time, is cut into cells, and a row starts from its group's count in the cells before."""
    first = F.col(order[0])
    if isinstance(df.schema[order[0]].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        first = F.unix_micros(first.cast("timestamp"))
    rows = df.withColumn("_key", first.cast("double"))
    rows = rows.withColumn("_cell", F.when(F.col("_key").isNull(), -1).otherwise(cell_of(rows, "_key", cells))).drop("_key")
    way = F.desc if descending else F.asc
    per = rows.groupBy(*group, "_cell").agg(F.count("*").alias("_k"))  # a row a group and cell
    before = Window.partitionBy(*group).orderBy(way("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_b", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k").withColumnsRenamed({k: f"_k_{k}" for k in (*group, "_cell")})
    inside = F.row_number().over(Window.partitionBy(*group, "_cell").orderBy(*map(way, order))) - 1
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*group, "_cell")]
    both = rows.withColumn("_i", inside).join(per, on).withColumn(out, F.col("_b") + F.col("_i"))
    return both.drop("_cell", "_i", "_b", *[f"_k_{k}" for k in (*group, "_cell")])


def quantiles(df: DataFrame, column: str | Column, probs: Sequence[float], by: Sequence[str] = (), out: str = "_q", cells: int = CELLS) -> DataFrame:
    """(by, out): the exact quantiles, linear between neighbours, as an array; a row a
    group that has values, and one row (of nulls, if there are none) without groups.

    Distinct values are counted once, map side first. Approximate quantiles cut them
    into cells; a group's counts by cell, one row a cell, say in which cells the wanted
    ranks lie, and only those are ordered, each by itself."""
    by = list(by)
    v = F.col(column) if isinstance(column, str) else column
    values = df.select(*by, v.cast("double").alias("_v")).filter("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    edges = values.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_v", [i / cells for i in range(1, cells)], 10_000)).alias("_e"), F.sum("_n").alias("_t"))

    def beside(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnsRenamed({k: f"_k_{k}" for k in by})
        if not by:
            return a.crossJoin(F.broadcast(b))  # one row
        return a.join(b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by]).drop(*[f"_k_{k}" for k in by])

    rows = beside(values, edges).withColumn("_c", F.size(F.filter("_e", lambda e: e <= F.col("_v")))).drop("_e")
    run = Window.partitionBy(*by).orderBy("_c")  # a row a cell
    per = rows.groupBy(*by, "_c").agg(F.sum("_n").alias("_k"), F.max("_t").alias("_t"))
    per = per.withColumn("_upto", F.sum("_k").over(run)).withColumn("_b", F.col("_upto") - F.col("_k"))
    ranks = [(i, side, f(F.lit(float(p)) * (F.col("_t") - 1)).cast("long")) for i, p in enumerate(probs) for side, f in (("lo", F.floor), ("hi", F.ceil))]
    here = lambda r: (r >= F.col("_b")) & (r < F.col("_upto"))
    wanted = F.array_compact(F.array(*[F.when(here(r), F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"), r.alias("r"))) for i, s, r in ranks]))
    per = per.withColumn("_w", wanted).filter(F.size("_w") > 0).select(*by, F.col("_c").alias("_c2"), "_b", "_w")
    per = per.withColumnsRenamed({k: f"_k_{k}" for k in by})
    on = [F.col("_c") == F.col("_c2"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by]]
    few = rows.join(per if by else F.broadcast(per), on).drop("_c2", *[f"_k_{k}" for k in by])  # without groups, two cells a quantile
    inside = F.sum("_n").over(Window.partitionBy(*by, "_c").orderBy("_v")) + F.col("_b")
    few = few.withColumn("_upto", inside).withColumn("_x", F.explode("_w"))
    at = few.filter((F.col("_x.r") < F.col("_upto")) & (F.col("_x.r") >= F.col("_upto") - F.col("_n")))
    pick = lambda i, s: F.max(F.when((F.col("_x.i") == i) & (F.col("_x.s") == s), F.col("_v")))
    ends = at.groupBy(*by).agg(F.max("_t").alias("_t"), *[pick(i, s).alias(f"_{s}{i}") for i in range(len(probs)) for s in ("lo", "hi")])

    def between(i: int, p: float) -> Column:
        h = F.lit(float(p)) * (F.col("_t") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when(F.floor(h) == F.ceil(h), lo).otherwise((F.ceil(h) - h) * lo + (h - F.floor(h)) * hi)

    return ends.select(*by, F.array(*[between(i, p) for i, p in enumerate(probs)]).alias(out))


def with_quantiles(df: DataFrame, column: str | Column, names: dict[str, float], by: Sequence[str] = (), of: DataFrame | None = None) -> DataFrame:
    """``df`` (a row a group of ``by``) with a column a named quantile of ``of``'s column."""
    q = quantiles(df if of is None else of, column, list(names.values()), by)
    q = q.select(*[F.col(k).alias(f"_k_{k}") for k in by], *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)])
    if not by:
        return df.join(F.broadcast(q), how="left")  # one row
    return df.join(q, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by], "left").drop(*[f"_k_{k}" for k in by])
