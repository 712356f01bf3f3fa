"""Feature transforms. Statistics are one aggregate, joined back as one row or as
a small table of categories; the transform itself is a projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import quantiles, with_quantiles

#: Category tables up to so many rows are broadcast.
BROADCAST_ROWS = 20_000
#: Values that may become a column each.
MOST_COLUMNS = 2_000


def _with_stats(df: DataFrame, stats: Sequence[Column]) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(*stats)))  # one row


def _small(table: DataFrame) -> DataFrame:
    """A broadcast hint only if the table is counted to be small."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard", eps: float = 0.0, sample: bool = False) -> DataFrame:
    """standard, minmax or robust scaling in place.

    With ``eps`` 0 a zero spread counts as 1; otherwise ``eps`` is added to the
    spread. ``sample`` takes the sample deviation."""
    std = F.stddev_samp if sample else F.stddev_pop
    kinds = {
        "standard": lambda c: (F.avg(c), std(c)),
        "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)),
    }
    if method == "robust":
        both = df
        for c in columns:
            both = with_quantiles(both, c, {f"_l_{c}": 0.25, f"_m_{c}": 0.5, f"_h_{c}": 0.75}, of=df).withColumn(f"_s_{c}", F.col(f"_h_{c}") - F.col(f"_l_{c}"))
    else:
        pairs = {c: kinds[method](c) for c in columns}
        both = _with_stats(df, [x.alias(f"_{k}_{c}") for c, p in pairs.items() for k, x in zip("ms", p, strict=True)])
    spread = lambda c: F.col(f"_s_{c}") + eps if eps else F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
    return both.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / spread(c) for c in columns}).select(df.columns)


def mad_scale(df: DataFrame, column: str, eps: float = 1e-10) -> DataFrame:
    """(x - median) / (median absolute deviation + eps), in place; two passes."""
    both = with_quantiles(df, column, {"_m": 0.5})
    both = both.withColumn("_d", F.abs(F.col(column) - F.col("_m")))
    both = with_quantiles(both, "_d", {"_s": 0.5})
    return both.withColumn(column, (F.col(column) - F.col("_m")) / (F.col("_s") + eps)).select(df.columns)


def mode_of(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value, the least on a tie."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_mode")).agg(F.count("*").alias("_n"))
    return counts.orderBy(F.desc("_n"), "_mode").limit(1).select("_mode")


def impute(df: DataFrame, strategies: dict[str, str | tuple], indicator: bool = False) -> DataFrame:
    """``strategies``: column to mean, median, mode or ("constant", value);
    ``indicator`` adds <c>_was_missing."""
    out = df
    if indicator:
        out = out.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in strategies})
    stats = {c: F.avg(c) for c, s in strategies.items() if s == "mean"}
    for c in (c for c, s in strategies.items() if s == "median"):
        out = with_quantiles(out, c, {f"_f_{c}": 0.5}, of=df)
    if stats:
        out = out.crossJoin(F.broadcast(df.agg(*[x.alias(f"_f_{c}") for c, x in stats.items()])))  # one row
    for c, s in strategies.items():
        if s == "mode":
            out = out.join(F.broadcast(mode_of(df, c).withColumnRenamed("_mode", f"_f_{c}")), how="left")  # one row
    fill = lambda c, s: F.lit(s[1]) if isinstance(s, tuple) else F.col(f"_f_{c}")
    return out.withColumns({c: F.coalesce(F.col(c), fill(c, s)) for c, s in strategies.items()}).drop(*[f"_f_{c}" for c in strategies])


def categories(df: DataFrame, column: str) -> list[str]:
    """Sorted values; for encodings that make a column of each. More than
    ``MOST_COLUMNS`` of them are an error."""
    found = df.filter(F.col(column).isNotNull()).select(column).distinct().limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"{column} has more than {MOST_COLUMNS} values; use label_encode or target_encode")
    return sorted(r[0] for r in found)


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """<c>_<value> is 1 or 0; unknown values and null are all 0."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}).drop(column)


def label_encode(df: DataFrame, column: str, fit: DataFrame | None = None) -> DataFrame:
    """<c> becomes its rank among ``fit``'s sorted values, from 0; unknown -1."""
    known = (fit if fit is not None else df).filter(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct()
    known = known.withColumn("_code", F.row_number().over(Window.orderBy("_v")) - 1)  # a row a category
    out = df.join(_small(known), F.col(column) == F.col("_v"), "left")
    return out.withColumn(column, F.coalesce("_code", F.lit(-1)).cast("int")).drop("_v", "_code")


def target_encode(df: DataFrame, column: str, target: str, smoothing: float = 1.0, min_leaf: int = 1, fit: DataFrame | None = None) -> DataFrame:
    """<c> becomes the smoothed mean target of its category; the overall mean if
    the category is unknown or has under ``min_leaf`` rows."""
    learn = fit if fit is not None else df
    stats = learn.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.avg(target).alias("_m"), F.count(target).alias("_n"))
    whole = learn.agg(F.avg(target).alias("_g"))
    out = df.join(_small(stats), F.col(column) == F.col("_v"), "left").crossJoin(F.broadcast(whole))  # one row
    value = (F.col("_n") * F.col("_m") + smoothing * F.col("_g")) / (F.col("_n") + smoothing)
    return out.withColumn(column, F.when(F.col("_n") >= min_leaf, value).otherwise(F.col("_g"))).drop("_v", "_m", "_n", "_g")


def count_frequency(df: DataFrame, column: str) -> DataFrame:
    """Adds <c>_count and <c>_freq, the share among values that are not null."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    out = df.join(_small(counts), F.col(column) == F.col("_v"), "left").crossJoin(F.broadcast(total))  # one row
    n = F.coalesce("_n", F.lit(0))
    return out.withColumns({f"{column}_count": n, f"{column}_freq": n / F.col("_t")}).drop("_v", "_n", "_t")


def group_rare(df: DataFrame, column: str, least: float = 0.01, name: str = "RARE") -> DataFrame:
    """Values with a share under ``least`` become ``name``."""
    out = count_frequency(df, column)
    rare = F.col(column).isNotNull() & (F.col(f"{column}_freq") < least)
    return out.withColumn(column, F.when(rare, F.lit(name)).otherwise(F.col(column))).drop(f"{column}_count", f"{column}_freq")


def bins(df: DataFrame, column: str, n: int = 5, strategy: str = "quantile", out: str | None = None) -> DataFrame:
    """Left-closed bin codes from 0; the last bin is closed on the right and
    equal edges collapse."""
    if strategy == "quantile":
        edges = quantiles(df, column, [i / n for i in range(n + 1)]).select(F.array_distinct("_q").alias("_e"))
    else:
        lo, hi = F.min(column), F.max(column)
        edges = df.agg(F.array(*[lo + (hi - lo) * F.lit(i / n) for i in range(n + 1)]).alias("_e"))
    both = df.crossJoin(F.broadcast(edges))  # one row
    inner = F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0)))
    code = F.when(F.col(column).isNotNull(), F.size(F.filter(inner, lambda e: e <= F.col(column))))
    return both.withColumn(out or f"{column}_bin", code).drop("_e")


def cut(df: DataFrame, column: str, edges: Sequence[float] | int, out: str | None = None) -> DataFrame:
    """Right-closed intervals, as (a, b]; an int cuts the range evenly, its low
    end widened by a thousandth. Outside values are null."""
    name = out or f"{column}_cut"
    if isinstance(edges, int):
        n = edges
        lo, hi = F.min(column).cast("double"), F.max(column).cast("double")
        first = lo - (hi - lo) * F.lit(0.001)
        both = df.crossJoin(F.broadcast(df.agg(F.array(first, *[lo + (hi - lo) * F.lit(i / n) for i in range(1, n + 1)]).alias("_e"))))  # one row
    else:
        both = df.withColumn("_e", F.array(*[F.lit(float(e)) for e in edges]))
    below = F.size(F.filter("_e", lambda e: e < F.col(column)))
    inside = F.col(column).isNotNull() & (below > 0) & (below < F.size("_e"))
    return both.withColumn(name, F.when(inside, below - 1)).drop("_e")


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2, interaction_only: bool = False, bias: bool = False) -> DataFrame:
    """All monomials up to ``degree``, by degree and then order, named "a", "a^2" or "a b"."""
    from itertools import combinations, combinations_with_replacement

    pick = combinations if interaction_only else combinations_with_replacement
    new: dict[str, Column] = {"1": F.lit(1.0)} if bias else {}
    for k in range(1, degree + 1):
        for term in pick(columns, k):
            name = " ".join(c if term.count(c) == 1 else f"{c}^{term.count(c)}" for c in dict.fromkeys(term))
            value = F.col(term[0])
            for c in term[1:]:
                value = value * F.col(c)
            new[name] = value
    return df.select(*[c for c in df.columns if c not in columns], *[v.alias(k) for k, v in new.items()])


def row_stats(df: DataFrame, columns: Sequence[str], prefix: str = "row") -> DataFrame:
    """Adds sum, mean, max, min, std, count and median over a row's values; nulls are left out."""
    v = F.array_sort(F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull()))
    df = df.withColumn("_v", v).withColumn("_k", F.size("_v")).withColumn("_t", F.aggregate("_v", F.lit(0.0), lambda a, x: a + x))
    mean = F.try_divide("_t", "_k")
    var = F.try_divide(F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)), F.col("_k") - 1)
    half = (F.col("_k") / 2).cast("int")
    median = F.when(F.col("_k") % 2 == 1, F.get("_v", half)).otherwise((F.get("_v", half - 1) + F.get("_v", half)) / 2)
    stats = {"sum": F.col("_t"), "mean": mean, "max": F.array_max("_v"), "min": F.array_min("_v"), "std": F.sqrt(var), "count": F.col("_k").cast("long"), "median": median}
    return df.withColumns({f"{prefix}_{k}": x for k, x in stats.items()}).drop("_v", "_k", "_t")


def ratio(numerator: str, denominator: str, eps: float = 1e-10) -> Column:
    return F.try_divide(F.col(numerator), F.col(denominator) + eps)


def interactions(df: DataFrame, numeric: Sequence[str], limit: int = 10) -> DataFrame:
    """Adds a_x_b and a_div_b of pairs of sorted columns, ``limit`` at most."""
    names = sorted(numeric)
    new: dict[str, Column] = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            new[f"{a}_x_{b}"] = F.col(a) * F.col(b)
            new[f"{a}_div_{b}"] = F.try_divide(F.col(a), F.col(b))
    return df.withColumns(dict(list(new.items())[:limit]))


def group_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """Adds the mean of ``value`` in its group, joined from the groups' table, so
    that a large group needs no task of its own."""
    means = df.groupBy(F.col(group).alias("_g")).agg(F.avg(value).alias(f"{value}_by_{group}"))
    return df.join(_small(means), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def auto_numeric(df: DataFrame, column: str) -> DataFrame:
    """Adds log (log1p if the least value is in (-1, 0]), sqrt and square where the range allows, and the reciprocal."""
    lo = df.agg(F.min(column)).first()[0]
    c = F.col(column)
    new = {f"{column}_square": c * c, f"{column}_reciprocal": F.try_divide(F.lit(1.0), c)}
    if lo is not None and lo > -1:
        new[f"{column}_log"] = F.ln(c) if lo > 0 else F.log1p(c)
    if lo is not None and lo >= 0:
        new[f"{column}_sqrt"] = F.sqrt(c)
    return df.withColumns(new)


def tfidf(df: DataFrame, key: str, text: str, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(key, token, tf, tfidf): tokens of two or more word characters, smooth idf, unit length a document."""
    tokens = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))).alias("token"))
    tf = tokens.groupBy(key, "token").agg(F.count("*").alias("tf"))
    n = df.agg(F.count("*").alias("_n"))
    idf = tf.groupBy("token").agg(F.count("*").alias("_df"), F.sum("tf").alias("_tf")).crossJoin(F.broadcast(n))  # one row
    idf = idf.filter((F.col("_df") >= min_df) & (F.col("_df") <= max_df * F.col("_n")))
    if max_features:
        idf = idf.orderBy(F.desc("_tf"), "token").limit(max_features)
    rows = tf.join(idf, "token").withColumn("_w", F.col("tf") * (F.ln((1 + F.col("_n")) / (1 + F.col("_df"))) + 1))
    norm = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"))
    return rows.join(norm, key).select(key, "token", "tf", (F.col("_w") / F.col("_l")).alias("tfidf"))


def ngram_counts(df: DataFrame, key: str, text: str, low: int = 1, high: int = 1, max_features: int | None = None) -> DataFrame:
    """(key, token, n): runs of ``low`` to ``high`` tokens, joined by blanks; with
    ``max_features`` only the most frequent of them, ties by name."""
    words = df.select(key, F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)).alias("_w"))
    run = lambda k: F.when(F.size("_w") >= k, F.transform(F.sequence(F.lit(1), F.size("_w") - k + 1), lambda i: F.array_join(F.slice("_w", i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))
    each = words.select(key, F.explode(F.concat(*[run(k) for k in range(low, high + 1)])).alias("token"))
    out = each.groupBy(key, "token").agg(F.count("*").alias("n"))
    if max_features:
        most = out.groupBy("token").agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), "token").limit(max_features)
        out = out.join(most.select("token"), "token", "left_semi").select(key, "token", "n")
    return out


def outliers(df: DataFrame, columns: Sequence[str], action: str = "flag", factor: float = 1.5, flag: str = "is_outlier") -> DataFrame:
    """Values beyond ``factor`` quartile ranges of the quartiles: ``flag`` adds a 0/1 column for
    rows that have one, ``remove`` drops those rows, ``impute`` puts the column's median in
    place of such values. Nulls are none."""
    from .ordered import quantiles

    if action not in ("flag", "remove", "impute"):
        raise ValueError(f"no action {action}")
    rows, far = df, {}
    for i, c in enumerate(columns):
        rows = rows.crossJoin(F.broadcast(quantiles(df, c, [0.25, 0.5, 0.75], out=f"_q{i}")))  # one row
        low, high = F.get(f"_q{i}", F.lit(0)), F.get(f"_q{i}", F.lit(2))
        far[c] = F.coalesce((F.col(c) < low - factor * (high - low)) | (F.col(c) > high + factor * (high - low)), F.lit(False))
    hit = F.lit(False)
    for one in far.values():
        hit = hit | one
    if action == "flag":
        rows = rows.withColumn(flag, hit.cast("int"))
    elif action == "remove":
        rows = rows.filter(~hit)
    else:
        rows = rows.withColumns({c: F.when(far[c], F.get(f"_q{i}", F.lit(1))).otherwise(F.col(c)) for i, c in enumerate(columns)})
    return rows.drop(*[f"_q{i}" for i in range(len(columns))])


def chunks(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, chunk, content): windows of ``size`` characters that share
    ``overlap``; the last one ends with the text and null text has none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    # The chunks are cut before the explode, which then copies no text.
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col(text), i * step + 1, F.lit(size)))
    return df.filter(F.length(text) > 0).select(key, F.posexplode(cut).alias("chunk", "content"))
