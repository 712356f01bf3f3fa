"""Resampling plans as columns. A row's random place is the md5 of the seed and
its id, which any engine can compute; folds are a function of the place.

Without strata, exact fold sizes need a row's position in the whole table;
positions are found by cells of the hash, never by one window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a grid cell from which on its pairs are made in several tasks.
CROWD = 1000


def place(row_id: str, seed: int | Column) -> Column:
    seed = F.lit(f"{seed}:") if isinstance(seed, int) else F.concat(seed.cast("string"), F.lit(":"))
    return F.md5(F.concat(seed, F.col(row_id).cast("string")).cast("binary"))


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null is a key like any other."""
    b = b.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return a.join(b, on, how).drop(*[f"_k_{k}" for k in keys])


def shuffled(df: DataFrame, row_id: str, seed: int | Column, out: str = "_at", strata: str | None = None, repeat: str | None = None) -> DataFrame:
    """Adds each row's position, from 0, in the random order, inside its stratum if
    given (null is a stratum) and inside ``repeat``, a column that numbers copies of
    the table.

    Cells are the first three hex digits of the place: 4096 of equal size on
    average, whose row counts are summed in a table of one row a cell."""
    keys = [k for k in (repeat, strata) if k]
    rows = df.withColumn("_p", place(row_id, seed)).withColumn("_cell", F.substring("_p", 1, 3))
    per = rows.groupBy(*keys, "_cell").agg(F.count("*").alias("_k"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_b", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    inside = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("_p", row_id)) - 1
    return _join(rows.withColumn("_i", inside), per, [*keys, "_cell"]).withColumn(out, F.col("_b") + F.col("_i")).drop("_p", "_cell", "_i", "_b")


def _with_count(df: DataFrame, *by: str | None) -> DataFrame:
    keys = [k for k in by if k]
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return _join(df, n, keys) if keys else df.crossJoin(F.broadcast(n))  # one row


def _fold(rows: DataFrame, folds: int, strata: str | None, repeat: str | None = None) -> DataFrame:
    if strata:
        return rows.withColumn("fold", (F.col("_at") % folds).cast("int")).drop("_at")
    rows = _with_count(rows, repeat)
    q, r = F.expr(f"_n div {folds}"), F.col("_n") % folds
    long = r * (q + 1)
    fold = F.when(F.col("_at") < long, F.expr(f"_at div (_n div {folds} + 1)")).otherwise(r + F.floor((F.col("_at") - long) / F.greatest(q, F.lit(1))))
    return rows.withColumn("fold", fold.cast("int")).drop("_at", "_n")


def _copies(df: DataFrame, n: int, name: str) -> DataFrame:
    """``df`` n times, numbered, from one scan."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def cv(df: DataFrame, row_id: str, folds: int = 10, seed: int = 0, strata: str | None = None) -> DataFrame:
    """Adds ``fold``, from 0. Plain folds are runs of the random order, the first
    n % folds one longer; strata are dealt round."""
    return _fold(shuffled(df, row_id, seed, strata=strata), folds, strata)


def repeated_cv(df: DataFrame, row_id: str, folds: int = 10, repeats: int = 10, seed: int = 0, strata: str | None = None) -> DataFrame:
    """A row for each repeat: ``repeat`` and ``fold``; each repeat has its own order,
    that of ``cv`` with the seed plus the repeat."""
    rows = _copies(df, repeats, "repeat")
    return _fold(shuffled(rows, row_id, F.col("repeat") + seed, strata=strata, repeat="repeat"), folds, strata, "repeat")


def holdout(df: DataFrame, row_id: str, ratio: float = 0.67, seed: int = 0, strata: str | None = None) -> DataFrame:
    """Adds ``is_train``: the first floor(n * ratio) of the random order, by stratum if given."""
    rows = _with_count(shuffled(df, row_id, seed, strata=strata), strata)
    return rows.withColumn("is_train", F.col("_at") < F.floor(F.col("_n") * F.lit(ratio))).drop("_at", "_n")


def subsampling(df: DataFrame, row_id: str, iters: int = 30, ratio: float = 0.67, seed: int = 0, strata: str | None = None) -> DataFrame:
    """A row for each iteration, ``iter``: ``holdout`` with the seed plus the iteration."""
    rows = shuffled(_copies(df, iters, "iter"), row_id, F.col("iter") + seed, strata=strata, repeat="iter")
    rows = _with_count(rows, "iter", strata)
    return rows.withColumn("is_train", F.col("_at") < F.floor(F.col("_n") * F.lit(ratio))).drop("_at", "_n")


def insample(df: DataFrame) -> DataFrame:
    """Every row for training and for testing: a row each way in ``role``."""
    return df.withColumn("role", F.explode(F.array(F.lit("train"), F.lit("test"))))


def stratified_bootstrap(df: DataFrame, row_id: str, strata: str, iters: int = 30, seed: int = 0) -> DataFrame:
    """(iter, row_id, draws): as many draws in each stratum as it has rows. Draw j of
    iteration b in a stratum takes the position that 32 bits of the md5 of
    seed:b:j give, modulo the stratum's rows."""
    rows = _with_count(shuffled(df.select(row_id, strata), row_id, seed, strata=strata), strata)
    every = _copies(rows, iters, "iter")
    text = F.concat_ws(":", F.lit(str(seed)), F.col("iter").cast("string"), F.col("_at").cast("string"))
    hit = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % F.col("_n")
    hits = every.groupBy("iter", strata, hit.alias("_at")).agg(F.count("*").alias("draws"))
    return _join(every, hits, ["iter", strata, "_at"], "left").select("iter", row_id, F.coalesce("draws", F.lit(0)).alias("draws"))


def bootstrap(df: DataFrame, row_id: str, iters: int = 30, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """(iter, row_id, draws): how often each row is drawn; 0 draws are out of bag.

    Draw j of iteration b takes the position that 32 bits of the md5 of
    seed:b:j give, modulo n."""
    rows = shuffled(df.select(row_id), row_id, seed)
    n = df.count()
    draws = df.sparkSession.range(int(n * ratio)).select(F.col("id").alias("_j"), F.explode(F.sequence(F.lit(0), F.lit(iters - 1))).alias("iter"))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("iter").cast("string"), F.col("_j").cast("string"))
    at = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(max(n, 1))
    hits = draws.groupBy("iter", at.alias("_at")).agg(F.count("*").alias("draws"))
    every = rows.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iters - 1))))
    return every.join(hits, ["iter", "_at"], "left").select("iter", row_id, F.coalesce("draws", F.lit(0)).alias("draws"))


def leave_one_out(df: DataFrame, row_id: str) -> DataFrame:
    """(fold, row_id): each row is a fold's only test row, in ascending id."""
    from .ordered import positions

    return positions(df.select(row_id), row_id, "fold")


def by_column(df: DataFrame, column: str) -> DataFrame:
    """Adds ``fold``, the rank of the column's value among its sorted values, from 0."""
    values = df.select(F.col(column).alias("_v")).distinct().withColumn("fold", (F.row_number().over(Window.orderBy("_v")) - 1).cast("int"))  # a row a value
    return df.join(values, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")


def grid_cells(df: DataFrame, x: str, y: str, rows: int, cols: int) -> DataFrame:
    """Adds ``cell_row`` and ``cell_col`` of a regular grid over the extent; the
    far edges belong to the last cells."""
    box = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    both = df.crossJoin(F.broadcast(box))  # one row
    cell = lambda v, lo, hi, k: F.least(F.lit(k - 1), F.coalesce(F.floor(F.try_divide((F.col(v) - F.col(lo)) * k, F.col(hi) - F.col(lo))), F.lit(0))).cast("int")
    both = both.withColumn("cell_col", cell(x, "_x0", "_x1", cols)).withColumn("cell_row", cell(y, "_y0", "_y1", rows))
    return both.drop("_x0", "_x1", "_y0", "_y1")


def spatial_blocks(df: DataFrame, x: str, y: str, rows: int = 5, cols: int = 5, folds: int = 5) -> DataFrame:
    """Systematic block folds: (row + column) modulo ``folds``."""
    return grid_cells(df, x, y, rows, cols).withColumn("fold", ((F.col("cell_row") + F.col("cell_col")) % folds).cast("int")).drop("cell_row", "cell_col")


def spatial_kfold(df: DataFrame, x: str, y: str, side: int = 4, folds: int = 5) -> DataFrame:
    """Grid folds: the occupied cells are numbered by row and column and dealt round."""
    cells = grid_cells(df, x, y, side, side)
    used = cells.select("cell_row", "cell_col").distinct()
    used = used.withColumn("fold", ((F.row_number().over(Window.orderBy("cell_row", "cell_col")) - 1) % folds).cast("int"))  # side * side rows at most
    return cells.join(F.broadcast(used), ["cell_row", "cell_col"]).drop("cell_row", "cell_col")


def near(a: DataFrame, b: DataFrame, x: str, y: str, distance: float, ids: tuple[str, str]) -> DataFrame:
    """(id_a, id_b, d2): pairs within ``distance``. Both sides meet on grid cells of half
    that size; ``b`` goes to all that it may reach. A cell with more than ``CROWD`` rows of ``a``
    is dealt in parts by hash, each of which meets the cell's rows of ``b``."""
    side, reach = distance / 2, distance * (1 + 1e-9)  # sums and quotients are rounded
    cell = lambda c: F.floor(c / F.lit(side)).cast("long")
    left = a.select(F.col(ids[0]).alias("id_a"), F.col(x).alias("xa"), F.col(y).alias("ya"), cell(F.col(x)).alias("cx"), cell(F.col(y)).alias("cy"))
    to = lambda c: F.explode(F.sequence(cell(F.col(c) - reach), cell(F.col(c) + reach)))
    right = b.select(F.col(ids[1]).alias("id_b"), F.col(x).alias("xb"), F.col(y).alias("yb"))
    right = right.withColumn("cx", to("xb")).withColumn("cy", to("yb"))
    full = left.groupBy("cx", "cy").agg(F.count("*").alias("_n")).filter(F.col("_n") > CROWD)
    full = F.broadcast(full.select("cx", "cy", F.ceil(F.col("_n") / CROWD).cast("int").alias("_parts")))  # a row for CROWD rows at most
    parts = F.coalesce("_parts", F.lit(1))
    left = left.join(full, ["cx", "cy"], "left").withColumn("_part", F.pmod(F.xxhash64("id_a"), parts).cast("int")).drop("_parts")
    right = right.join(full, ["cx", "cy"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    d2 = dx * dx + dy * dy
    return left.join(right, ["cx", "cy", "_part"]).select("id_a", "id_b", d2.alias("d2")).filter(F.col("d2") <= distance * distance)


def buffered(df: DataFrame, row_id: str, x: str, y: str, distance: float, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds ``role``: test for a random share, null for rows within ``distance``
    of a test row, train for the rest."""
    rows = holdout(df, row_id, share, seed).withColumnRenamed("is_train", "_test")
    test = rows.filter("_test")
    cell = lambda c: F.floor(F.col(c) / F.lit(distance)).cast("long")
    around = F.explode(F.array(*[F.struct((cell(x) + i).alias("cx"), (cell(y) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    spots = test.select(F.col(x).alias("_x"), F.col(y).alias("_y"), around.alias("c")).select("_x", "_y", F.col("c.cx").alias("_tx"), F.col("c.cy").alias("_ty"))
    rest = rows.filter("not _test")
    d2 = F.pow(F.col(x) - F.col("_x"), F.lit(2)) + F.pow(F.col(y) - F.col("_y"), F.lit(2))
    near_test = (cell(x) == F.col("_tx")) & (cell(y) == F.col("_ty")) & (d2 <= distance * distance)
    # A semi join stops at a row's first close test row, so that no pairs are made.
    close = rest.join(spots, near_test, "left_semi").select(F.col(row_id).alias("_close"))
    out = rows.join(close, F.col(row_id) == F.col("_close"), "left")
    role = F.when(F.col("_test"), "test").when(F.col("_close").isNull(), "train")
    return out.withColumn("role", role).drop("_test", "_close")


def split_check(train: DataFrame, test: DataFrame, row_id: str, total: int) -> DataFrame:
    """One row: sizes, overlap, union, ids outside 0..total-1, and the share of test rows."""
    a, b = train.select(row_id).distinct(), test.select(row_id).distinct()
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), row_id, "full_outer")
    return both.agg(
        F.count("_a").alias("n_train"), F.count("_b").alias("n_test"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("overlap"), F.count("*").alias("n_union"),
        F.count_if((F.col(row_id) < 0) | (F.col(row_id) >= total)).alias("out_of_bounds"), F.try_divide(F.count("_b"), F.count("*")).alias("test_ratio"),
    )


def environmental(df: DataFrame, place_columns: list[str], environment: list[str], folds: int = 5, weight: float = 0.5, seed: int = 1) -> DataFrame:
    """Adds ``fold``: the cluster of a row among ``folds`` of k-means over standardised
    coordinates, weighted ``weight``, and environment, weighted the rest."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    columns = [*place_columns, *environment]
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    part = lambda c: weight if c in place_columns else 1 - weight
    scaled = df.withColumns({f"_z_{c}": (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) * part(c) for c in columns})
    rows = VectorAssembler(inputCols=[f"_z_{c}" for c in columns], outputCol="_v").transform(scaled)
    model = KMeans(k=folds, seed=seed, featuresCol="_v", predictionCol="fold").fit(rows)
    return model.transform(rows).drop("_v", *[f"_z_{c}" for c in columns])
