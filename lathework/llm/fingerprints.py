"""Operator 5: document fingerprints by Order MinHash, in DataFrame functions only.

A text is a sequence of units: up to four letters or digits with the other
characters before them; what follows the last letter is a unit too. Its k-mers (``KMER`` units in a row) are numbered by
occurrence, so that a repeated k-mer counts as often as it occurs. For each of
``SLOTS`` orders of their hashes, the ``PICK`` least numbered k-mers are put
back into text order, and the tuple is hashed: one slot of the signature.
Two texts agree in a slot only if they share those k-mers in the same order,
which makes the share of equal slots sensitive to edits (Marcais et al. 2019).
The orders are rotations of one 40-bit hash circle: slot j starts at the j-th
of ``SLOTS`` equal marks and takes the next hashes clockwise. One sort of the
hashes with the marks therefore serves all slots.

Cases: null text counts as empty, and all empty texts share one fingerprint;
fewer than ``KMER`` units make one k-mer; repeated ids stand side by side,
ordered by text; null ids come first; a single document is its own next one; an
empty table gives an empty result; more columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs, small, store

KMER, PICK, SLOTS = 3, 2, 64
UNITS = r"[^\p{L}\p{M}\p{N}]*+[\p{L}\p{M}\p{N}]{1,4}|[^\p{L}\p{M}\p{N}]+"
#: Low bits hold a place in the text, high bits the hash. A text of Spark's
#: greatest length (2 GB) has fewer units than that.
BITS = 31
PLACE = (1 << BITS) - 1
#: Documents that a run of neighbours holds; cells of equal documents before equal widths.
RUN, CELLS = 4000, 256


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, an array of SLOTS ints, for the text column ``text``.

    Every step is a column of its own that the next step uses more than once,
    so that it is computed once."""
    span = 64 - SLOTS.bit_length() + 1
    marks = ", ".join(f"{j}L" for j in range(-SLOTS // 2, SLOTS // 2))
    steps = [
        ("_u", F.transform(F.regexp_extract_all(F.col(text), F.lit(UNITS), F.lit(0)), lambda x: F.xxhash64(x))),
        (
            "_p",
            F.expr(
                f"sort_array(transform(sequence(0, greatest(size(_u) - {KMER}, 0)), i -> "
                f"(xxhash64({', '.join(f'get(_u, i + {k})' for k in range(KMER))}) & ~{PLACE}L) | ((i + 1) & {PLACE}L)))"  # from 1, so that no k-mer looks like a mark
            ),
        ),
        ("_s", F.expr(f"filter(sequence(0, size(_p) - 1), i -> i = 0 or shiftright(get(_p, i), {BITS}) != shiftright(get(_p, i - 1), {BITS}))")),
        (
            "_z",
            F.expr(
                "sort_array(flatten(transform(_s, (s, r) -> transform(slice(_p, s + 1, coalesce(get(_s, r + 1), size(_p)) - s), (x, j) -> "
                f"(xxhash64(shiftright(x, {BITS}), j) & ~{PLACE}L) | (x & {PLACE}L)))))"
            ),
        ),
        ("_m", F.expr(f"sort_array(concat(_z, transform(array({marks}), j -> shiftleft(j, {span}))))")),
        ("_b", F.expr(f"filter(sequence(0, size(_m) - 1), i -> get(_m, i) & {(1 << span) - 1}L = 0)")),
        (
            out,  # the tuple in text order: sorted by place, then hashed
            F.expr(
                f"transform(_b, (b, j) -> cast(shiftright(xxhash64(transform(array_sort(transform(sequence(0, {PICK - 1}), "
                f"t -> named_struct('at', get(_z, (b - j + t) % size(_z)) & {PLACE}L, 'h', shiftright(get(_z, (b - j + t) % size(_z)), {BITS})))), "
                "x -> x.h)), 32) as int))"
            ),
        ),
    ]
    for name, column in steps:
        df = df.withColumn(name, column)
    return df.drop("_u", "_p", "_s", "_z", "_m", "_b")


def likeness(a: str, b: str):
    """Share of equal slots."""
    return F.size(F.filter(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda x: x["a"] == x["b"])) / F.lit(float(SLOTS))


def as_text(slots: str):
    return F.array_join(F.transform(slots, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def runs(table: DataFrame):
    """A column that numbers runs of about RUN documents by ascending id: cells
    of equally many ids, cut into equal widths where one cell holds more."""
    n = table.count()
    cells = max(1, min(CELLS, -(-n // RUN)))
    widths = max(1, -(-n // (cells * RUN)))
    shares = [i / cells for i in range(cells + 1)]
    edges = table.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or [0] * (cells + 1)
    lows = F.array(*[F.lit(int(x)) for x in edges])
    cell = F.size(F.filter(lows, lambda x: x <= F.col("doc_id"))) - 1
    cell = F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.coalesce(cell, F.lit(0))))
    low, high = F.get(lows, cell), F.get(lows, cell + 1)
    at, low, high = (c.cast("double") for c in (F.col("doc_id"), low, high))  # ids may be as far apart as longs are
    part = (at - low) * widths / F.greatest(F.lit(1.0), high - low)
    part = F.greatest(F.lit(0), F.least(F.lit(widths - 1), F.coalesce(F.floor(part), F.lit(0)))).cast("long")
    return cell.cast("long") * widths + part


def with_next(table: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<c> of the next row by (doc_id, text), the first after the last.

    Every run of ids is one window partition; the first document of a run also
    goes, as a guest, to the end of the run before it."""
    run = runs(table.select("doc_id"))
    firsts = table.select("doc_id", run.alias("run")).groupBy("run").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("first"))
    order = Window.orderBy("run")  # one row a run
    firsts = firsts.select("first", F.col("run").alias("own"), F.lag("run").over(order).alias("before"))
    last = firsts.agg(F.max("own").alias("last"))
    firsts = store(firsts.crossJoin(F.broadcast(last)).select("first", F.coalesce("before", "last").alias("before")), "firsts")
    guests = small(firsts, firsts.count())
    rows = table.withColumn("run", run).join(guests, F.col("doc_id").eqNullSafe(F.col("first")), "left")
    own = F.struct(F.col("run").alias("run"), F.lit(0).alias("guest"))
    also = F.struct(F.col("before").alias("run"), F.lit(1).alias("guest"))
    rows = rows.withColumn("place", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, also))))
    rows = rows.select(*table.columns, "place.run", "place.guest")
    beside = Window.partitionBy("run").orderBy("guest", "doc_id", "text")
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(beside))
    return rows.filter("guest = 0").drop("run", "guest")


def fingerprints(table: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    texts = table.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = fingerprint(texts, "text", "slots")
    rows = with_next(own, ["text", "slots"])
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    edit = F.expr("concat(left(text, cast(n_chars - n_chars div 4 as int)), left(next_text, cast(n_chars div 4 as int)))")
    rows = fingerprint(rows.withColumn("edited", edit), "edited", "edited_slots")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("slots").alias("fingerprint"),
        as_text("edited_slots").alias("edited_fingerprint"),
        likeness("slots", "edited_slots").alias("near_edited"),
        likeness("slots", "next_slots").alias("near_next"),
    )


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(docs(spark, sf_dir))
