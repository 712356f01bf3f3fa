"""Operator 7: mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document's expected number of
copies is its source's rate (times its relative importance, if a column says
so); the whole part is allotted with certainty, and the fraction is its
inclusion probability in a Pareto order sample: documents are ranked by the
random odds u/(1-u) over the inclusion odds l/(1-l), and the first ones that
fill the rest of the source's target are taken.

A source's documents differ in their inclusion probability only through
``importance``; without it, all of a source have the same, so that the order
within a source is that of u alone and a document's expected words are its size
times the source's rate. Size, in words, takes the place of the fixed number of
documents: the sample ends where the words of the ranked documents fill the
target, and actual inclusion differs from the nominal one by the closing document.

The cut is found without sorting a source in one task. Ranks fall into
``BINS`` times ``BINS`` bins, whose words are summed per source; the coarse bin in
which the target falls, then the fine one, are found over ``BINS`` sums each, and
only that fine bin is ordered row by row. One closing document, the one whose size
is nearest to what is left, ends the sample where that brings the source
nearer to its target.

Cases: null text has size 0; null source is a group of its own, last; null ids
hash as the empty text; rows that repeat an id have one u and are ranked by a hash
of their text, so that reruns agree in whatever order rows arrive (rows alike in id
and text are interchangeable; they are told apart by row number); an empty table
gives an empty result; more columns are ignored. All rows of one id stand in one
fine bin: an id that a third of all rows repeat is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs, scratch, small, store, word_count

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = 7
BINS = 1 << 7


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone: 52 bits of md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def source_targets(sized: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size): the closed form of
    resharing what exceeds ``max_copies`` times a source. Sources sorted by
    cap/weight are capped up to the first whose level stays below its cap."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("w", F.get(ws, (F.row_number().over(by_name) - 1) % F.lit(len(weights))))
    per = per.withColumn("cap", F.col("source_size") * F.lit(max_copies))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    per = (
        per.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")).cast("double") / F.col("w_rest"))
        .withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    )
    level = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("cap") / F.col("w")))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per.withColumn("_level", level.over(whole)).select(
        "source",
        "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("_level") * F.col("w"), F.col("cap").cast("double"))).alias("target"),
    )


def mix(
    table: DataFrame,
    weights=WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = SEED,
    importance: str | None = None,
    row_id: str | None = None,
) -> DataFrame:
    """Copies of every document in the mix.

    ``table`` has doc_id, text, source and, optionally, a non-negative
    ``importance`` column that makes inclusion unequal inside a source (its
    mean, weighted by words, counts as 1). ``row_id`` names a column that tells
    rows of one id apart, in a stored table. Returns one row per input row:
    doc_id, row, size, source_size, target, copies, taken."""
    spark = table.sparkSession
    weight = F.coalesce(F.col(importance).cast("double"), F.lit(1.0)) if importance else F.lit(1.0)
    sized = store(
        table.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), uniform(F.col("doc_id"), seed).alias("u"), weight.alias("imp"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
            (F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("row"),
        ),
        "sized",
    )
    per = source_targets(sized, weights, max_copies)
    if importance:
        mean = sized.groupBy("source").agg((F.sum(F.col("imp") * F.col("size")) / F.nullif(F.sum("size"), F.lit(0))).alias("imp_mean"))
    else:
        mean = per.select("source", F.lit(1.0).alias("imp_mean"))
    per = store(per.join(mean.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "sources")
    n_sources = per.count()

    def with_source(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "_s")
        return left.join(small(right, n_sources), left["source"].eqNullSafe(right["_s"]), "left").drop("_s")

    def planned(left: DataFrame, right: DataFrame) -> DataFrame:
        expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        expected = F.least(F.lit(float(max_copies)), expected * F.coalesce(F.try_divide("imp", "imp_mean"), F.lit(1.0)))
        odds = (F.col("u") / (1 - F.col("u"))) / (F.col("lam") / (1 - F.col("lam")))
        return (
            with_source(left, right)
            .withColumn("want", expected)
            .withColumn("whole", F.floor("want").cast("long"))
            .withColumn("lam", F.col("want") - F.col("whole"))
            .withColumn("q", F.when(F.col("lam") > 0, odds))
            .withColumn("bin", F.floor((1 - 1 / (1 + F.col("q"))) * (BINS * BINS)).cast("long"))
        )

    bins = planned(sized, per).groupBy("source", "bin").agg(
        F.sum(F.col("whole") * F.col("size")).alias("certain"), F.sum("size").alias("words")
    )
    bins = store(bins, "bins")
    rest = bins.groupBy("source").agg(F.sum("certain").alias("certain"))
    rest = per.join(rest.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).select(
        "source", "source_size", "target", "imp_mean", (F.col("target") - F.col("certain")).alias("rest")
    )

    def first_over(sums: DataFrame, limits: DataFrame, at: str, left: str) -> DataFrame:
        """(source, at, before) of each source's first bin whose words exceed ``left``; BINS rows a source."""
        run = Window.partitionBy("source").orderBy(at)
        over = with_source(sums.withColumn("upto", F.sum("words").over(run)), limits).filter(F.col("upto") > F.col(left))
        return over.groupBy("source").agg(F.min(at).alias(at), F.min_by(F.col("upto") - F.col("words"), at).alias("before"))

    drawn_bins = bins.filter("bin is not null").withColumn("coarse", F.expr(f"bin div {BINS}"))
    coarse = first_over(drawn_bins.groupBy("source", "coarse").agg(F.sum("words").alias("words")), rest.select("source", "rest"), "coarse", "rest")
    coarse = coarse.withColumnsRenamed({"coarse": "cut_coarse", "before": "before_coarse", "source": "s2"})
    inner = store(rest.select("source", "rest").join(coarse, F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "coarse")
    inner = inner.withColumn("left", F.col("rest") - F.col("before_coarse"))
    fine = with_source(drawn_bins, inner.select("source", "cut_coarse")).filter("coarse = cut_coarse").select("source", "bin", "words")
    cut = first_over(fine, inner.select("source", "left"), "bin", "left").withColumnsRenamed({"bin": "cut", "source": "s3"})
    cut = inner.select("source", "before_coarse").join(cut, F.col("source").eqNullSafe(F.col("s3"))).select("source", "cut", (F.col("before") + F.col("before_coarse")).alias("before_cut"))
    plan = rest.join(cut.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    plan = store(plan, "plan")

    rows = planned(sized, plan)
    inside = rows.filter(F.col("bin") == F.col("cut"))
    ordered = Window.partitionBy("source").orderBy("q", "doc_id", "th", "row").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("sampled", F.sum("size").over(ordered) + F.col("before_cut") <= F.col("rest"))
    outside = rows.filter(~F.coalesce(F.col("bin") == F.col("cut"), F.lit(False))).withColumn(
        "sampled", F.col("bin").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut")))
    )
    keep = ["doc_id", "row", "th", "source", "size", "source_size", "target", "rest", "whole", "bin", "q", "sampled"]
    drawn = store(inside.select(keep).unionByName(outside.select(keep)), "drawn")

    gaps = drawn.groupBy("source").agg(
        (F.max("rest") - F.coalesce(F.sum(F.when(F.col("sampled"), F.col("size"))), F.lit(0))).alias("gap")
    )
    gaps = store(gaps, "gaps")
    spare = with_source(drawn.filter(~F.col("sampled") & F.col("bin").isNotNull() & (F.col("size") > 0)), gaps)
    spare = spare.withColumn("off", F.abs(F.col("size") - F.col("gap"))).filter(F.col("off") < F.abs(F.col("gap")))
    closing = store(
        spare.groupBy("source").agg(F.min_by("row", F.struct("off", "q", "doc_id", "th", "row")).alias("closing")), "closing"
    )
    out = with_source(drawn, closing)
    copies = F.col("whole") + (F.col("sampled") | F.coalesce(F.col("row") == F.col("closing"), F.lit(False))).cast("long")
    return out.select("doc_id", "row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat(table: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: every row of ``table`` as often as ``mix``
    takes it. The rows are numbered once, in a stored table, so that equal ids
    stay apart."""
    numbered = store(table.withColumn("_lw_row", F.monotonically_increasing_id()), "numbered")
    counts = mix(numbered.select("doc_id", "text", "source", "_lw_row"), row_id="_lw_row", **options)
    counts = counts.select(F.col("row").alias("_lw_row"), F.col("copies").cast("int").alias("_lw_copies"))
    out = numbered.join(counts.filter("_lw_copies > 0"), "_lw_row")
    out = out.withColumn("_lw_copy", F.explode(F.sequence(F.lit(1), F.col("_lw_copies"))))
    return out.select(*[F.col(f"`{c}`") for c in table.columns])


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        mixed = mix(docs(spark, sf_dir).select("doc_id", "text", "source"))
        return store(mixed.select("doc_id", "size", "source_size", "target", "taken"), "mixed", lasting=True)


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source
), caps AS (SELECT *, source_size * 3 AS cap, CAST(source_size * 3 AS DOUBLE) / w AS ratio FROM named
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM caps
), per AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), coalesce(w * (SELECT arg_min(level, ratio) FROM levels WHERE level * w <= cap), CAST(cap AS DOUBLE))) AS target
  FROM levels
), wanted AS (
  SELECT s.*, p.source_size, p.target,
         least(3.0::DOUBLE, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END) AS want
  FROM sized s JOIN per p ON s.source IS NOT DISTINCT FROM p.source
), odds AS (
  SELECT *, CAST(floor(want) AS BIGINT) AS whole, want - floor(want) AS lam FROM wanted
), ranked AS (
  SELECT *, CASE WHEN lam > 0 THEN (u / (1 - u)) / (lam / (1 - lam)) END AS q,
         target - sum(whole * size) OVER (PARTITION BY source) AS rest
  FROM odds
), drawn AS (
  SELECT *, q IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest AS sampled
  FROM ranked
), gaps AS (
  SELECT *, rest - coalesce(sum(CASE WHEN sampled THEN size END) OVER (PARTITION BY source), 0) AS gap FROM drawn
), spare AS (
  SELECT source, doc_id FROM gaps WHERE NOT sampled AND q IS NOT NULL AND size > 0 AND abs(size - gap) < abs(gap)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), q, doc_id) = 1
)
SELECT g.doc_id, g.size, g.source_size, g.target,
       CAST((g.whole + CASE WHEN g.sampled OR s.doc_id IS NOT NULL THEN 1 ELSE 0 END) * g.size AS BIGINT) AS taken
FROM gaps g LEFT JOIN spare s ON g.doc_id = s.doc_id
"""
