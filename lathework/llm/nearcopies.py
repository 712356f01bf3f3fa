"""Operator 8: near-duplicate documents by bottom-k sketches of one hash.

1. A document's set is its distinct hashed 5-word shingles. Documents with the
   same set are one class, represented by its smallest id.
2. Every class keeps its ``SKETCH`` least hashes. Inverted lists of these
   values generate candidates: of a sketch of m values only the rarest
   m - ceil(SHARED * m) + 1 are listed, since linked documents share more than
   SHARED of a sketch (the chance that they don't is under 1e-8), so that one
   of those must be common. Values that many documents share thus list nobody
   who has rarer ones.
3. Every list member is compared with the list's smallest id, its hub: first the
   set sizes and the estimate from the union of both sketches, then, for what
   passes, the exact Jaccard of the full sets. Linked ones merge. A list whose
   members are all in one component by then needs no more; this keeps large
   groups of near copies linear.
4. Members of the other lists go through the same list filter on their full
   sets, where it is exact: a link shares at least 85 % of a set, so one of the
   rarest 15 % + 1 shingles is common. Their hubs are compared as in step 3.
5. In lists that still mix components, documents are compared in blocks of a
   task, exactly, and only with those whose set size allows a link (sizes fall
   into bands a factor of 0.85 wide; a link spans two bands at most). Only links
   leave the task, never pairs. That is quadratic in a band of documents that
   share rare shingles without being linked.

A value, hub or class that many rows share is split by salted joins.

Components are found by alternating large-star and small-star steps; those of
later links start from those of earlier ones. No table is broadcast without
need: each broadcast is held by the driver on its way.

Cases: null, empty or blank text has an empty set and is linked with nothing;
fewer than five words are one shingle; a null id is linked with nothing, has
no component and is kept; rows that repeat an id share a component if their
texts do, and ``keep_first`` tells them apart; an empty table gives an empty
result; more columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, docs, free, portable, salted, scratch, store

SHINGLE = 5
SKETCH, SHARED, ESTIMATE = 48, 0.45, 0.5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Documents of a block of step 5, and shingles of a slice of its matrix.
BLOCK, SLICE = 1024, 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sets(table: DataFrame) -> DataFrame:
    """(doc_id, shingles): the sorted distinct 64-bit hashes of a text's shingles."""
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    words = table.select("doc_id", F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("w"))
    hashed = words.select("doc_id", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    run = ", ".join(f"get(w, i + {j})" for j in range(SHINGLE))
    every = f"transform(sequence(0, greatest(size(w) - {SHINGLE}, 0)), i -> xxhash64({run}))"
    none = "cast(array() as array<bigint>)"
    return hashed.select("doc_id", F.expr(f"if(size(w) = 0, {none}, sort_array(array_distinct({every})))").alias("shingles"))


def sketches(table: DataFrame) -> DataFrame:
    """A row a document: set size, 128 bits that stand for the set, and the sketch."""
    return sets(table).select(
        "doc_id",
        F.size("shingles").cast("long").alias("n"),
        F.xxhash64(F.lit(1), "shingles").alias("d1"),
        F.xxhash64(F.lit(2), "shingles").alias("d2"),
        F.slice("shingles", 1, SKETCH).alias("sketch"),
    )


def rare_lists(held: DataFrame, must_share: Column) -> DataFrame:
    """(value, id) lists of two or more, of each id's rarest values only.

    ``held`` has id and values; of m values, ``must_share`` (of column m) are
    in common with any partner, so that m - must_share + 1 need listing."""
    each = held.select("id", F.size("values").alias("m"), F.explode("values").alias("value"))
    common = store(each.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "common")
    rows = salted(each, by_shuffle(common), "value", common.select("value", F.col("df").alias("_n")), "id")
    by_id = Window.partitionBy("id")
    # Values of one document only are the rarest of all and come first.
    rows = rows.withColumn("at", F.row_number().over(by_id.orderBy("df", "value"))).withColumn("found", F.count("*").over(by_id))
    rows = store(rows.filter(F.col("at") + F.col("m") - F.col("found") <= F.col("m") - must_share + 1).select("value", "id"), "rare")
    many = store(rows.groupBy("value").agg(F.min("id").alias("hub"), F.count("*").alias("_n")).filter("_n > 1"), "hubs")
    return salted(rows, by_shuffle(many.select("value", "hub")), "value", many.select("value", "_n"), "id")


def is_link(n_a: Column, n_b: Column, both: Column) -> Column:
    return F.lit(100) * both >= F.lit(PERCENT) * (n_a + n_b - both)


def estimate(a: Column, b: Column) -> Column:
    """Jaccard estimate from the least SKETCH values of the union of two sketches."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(least, F.array_intersect(a, b))) / F.size(least)


def by_shuffle(table: DataFrame) -> DataFrame:
    """``table`` as a side of a join that is not to be broadcast: every broadcast
    passes the driver, and an operator of many small joins fills its memory."""
    return table.hint("merge")


def tangled(edges: DataFrame) -> tuple[int, int]:
    """How many ids of ``edges`` (hi, lo) have several lower ones, and how many have
    a lower and a higher one. Without either, the edges are stars around least ids."""
    ends = edges.select(F.posexplode(F.array("hi", "lo")).alias("end", "id"))
    ends = ends.groupBy("id").agg(F.count_if(F.col("end") == 0).alias("up"), F.count_if(F.col("end") == 1).alias("down"))
    return tuple(ends.agg(F.count_if(F.col("up") > 1), F.count_if((F.col("up") > 0) & (F.col("down") > 0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the smallest id reachable.

    A large-star step without chains and a small-star step without an id of several
    lower ones would change nothing and are left out."""
    now = store(edges.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    while any(found := tangled(now)):
        several, chained = found
        if chained:
            least = now.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("m"))
            now = now.join(by_shuffle(least), "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        if several:
            least = now.groupBy("hi").agg(F.min("lo").alias("m"))
            now = now.join(by_shuffle(least), "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo"))
            now = now.filter("hi != lo").distinct()
        now = store(now, "edges")
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))


def grown(joined: DataFrame, links: DataFrame) -> DataFrame:
    """``joined`` (id, component) after more ``links`` (a, b), a stored table."""
    if links.isEmpty():
        return joined
    return components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links))


def sizes_allow(n_a: Column, n_b: Column) -> Column:
    """A link's intersection is at most the smaller set, its union at least the larger."""
    return F.lit(100) * F.least(n_a, n_b) >= F.lit(PERCENT) * F.greatest(n_a, n_b)


def star_links(lists: DataFrame, held: DataFrame, joined: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between the hubs and the members of lists, but for those that
    ``joined`` (id, component) has in one component. ``held``: id, n, sketch, shingles."""
    pairs = lists.filter("id != hub").select("hub", "id").distinct()
    if joined is not None:
        pairs = pairs.join(by_shuffle(joined.withColumnRenamed("component", "c")), "id", "left")
        pairs = pairs.join(by_shuffle(joined.select(F.col("id").alias("hub"), F.col("component").alias("h"))), "hub", "left")
        pairs = pairs.filter(F.coalesce("c", "id") != F.coalesce("h", "hub")).select("hub", "id")
    pairs = store(pairs, "pairs")
    counts = store(pairs.groupBy("hub").agg(F.count("*").alias("_n")), "pair-counts")
    theirs = held.select("id", F.col("n").alias("n_id"), F.col("sketch").alias("sk_id"))
    hubs = held.select(F.col("id").alias("hub"), F.col("n").alias("n_hub"), F.col("sketch").alias("sk_hub"))
    near = salted(pairs.join(by_shuffle(theirs), "id"), by_shuffle(hubs), "hub", counts, "id").filter(sizes_allow(F.col("n_id"), F.col("n_hub")))
    near = near.filter(estimate(F.col("sk_id"), F.col("sk_hub")) >= ESTIMATE).select("hub", "id", "n_hub", "n_id")
    both = near.join(by_shuffle(held.select("id", F.col("shingles").alias("sh_id"))), "id")
    both = salted(both, by_shuffle(held.select(F.col("id").alias("hub"), F.col("shingles").alias("sh_hub"))), "hub", counts, "id")
    linked = is_link(F.col("n_id"), F.col("n_hub"), F.size(F.array_intersect("sh_id", "sh_hub")))
    return both.filter(linked).select(F.col("hub").alias("a"), F.col("id").alias("b"))


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between documents of different components of one pair of blocks:
    intersections are products of the 0/1 matrix of documents and shingles."""
    first, second = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    sets, n = rows["shingles"].to_numpy(), rows["n"].to_numpy()
    codes, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kept = df[at] > 1
    at, row = (np.cumsum(df > 1) - 1)[at[kept]], row[kept]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, SLICE):
        lo, hi = np.searchsorted(at, [low, low + SLICE])
        part = np.zeros((len(sets), SLICE), np.float32)
        part[row[lo:hi], at[lo:hi] - low] = 1
        both += part @ part.T
    linked = 100 * both >= PERCENT * (n[:, None] + n[None, :] - both)
    block, comp, ids = rows["block"].to_numpy(), rows["component"].to_numpy(), rows["id"].to_numpy()
    linked &= comp[:, None] != comp[None, :]
    own = rows["band"].to_numpy() == rows["low"].to_numpy()
    linked &= own[:, None] | own[None, :]  # two of the upper band meet in a group of their own
    if first != second:
        linked &= (block == first)[:, None] & (block == second)[None, :]
    a, b = np.nonzero(linked)
    parent = {c: c for c in comp}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in zip(a, b, strict=True):
        p, q = root(comp[x]), root(comp[y])
        if p != q:  # one link is enough to join two components
            parent[p] = q
            out.append((ids[x], ids[y]))
    return pd.DataFrame(out, columns=["a", "b"])


def mixed(lists: DataFrame, joined: DataFrame) -> DataFrame:
    """(value, hub, id, component) of the lists whose members are in several components."""
    own = lists.join(by_shuffle(joined.withColumnRenamed("component", "c")), "id", "left")
    own = store(own.select("value", "hub", "id", F.coalesce("c", "id").alias("component")), "members")
    open_ = own.groupBy("value").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("_n")).filter("least != most")
    open_ = store(open_.select("value", "_n"), "open-lists")
    return salted(own, by_shuffle(open_.select("value")), "value", open_, "id")


def rest_links(lists: DataFrame, joined: DataFrame, held: DataFrame) -> DataFrame:
    """Links between different components among the members of a list."""
    opened = store(mixed(lists, joined), "open")
    family = components(opened.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()).withColumnRenamed("component", "family")
    members = opened.select("id", "component").distinct().join(by_shuffle(family), "id", "left").join(by_shuffle(held.select("id", "n")), "id")
    band = F.floor(F.ln("n") / F.lit(-math.log(PERCENT / 100)) + 1e-9).cast("int")
    members = members.select("id", "component", F.coalesce("family", "id").alias("family"), band.alias("band"))
    members = members.withColumn("low", F.explode(F.array(F.col("band") - 1, F.col("band"))))
    # A group without a document of its own, lower band has no pair to look at.
    sizes = members.groupBy("family", "low").agg(F.count_if(F.col("low") == F.col("band")).alias("own"), F.count("*").alias("k")).filter("own > 0 and k > 1")
    sizes = sizes.select("family", "low", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    members = members.join(by_shuffle(sizes), ["family", "low"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = members.withColumn("other", other).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    keys = ["family", "low", "i", "j"]
    dealt = members.join(by_shuffle(held.select("id", "n", "shingles")), "id").select(*keys, "id", "component", "block", "band", "n", "shingles")
    return dealt.groupBy(*keys).applyInPandas(_block_links, "a long, b long")


def near_copies(table: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text)."""
    known = store(sketches(table), "sketches")
    classes = known.filter("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(
        F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.min("sketch").alias("sketch")
    )
    classes = store(classes, "classes")
    shared = F.ceil(F.col("m") * SHARED)
    close = store(rare_lists(classes.select("id", F.col("sketch").alias("values")), shared), "close")
    chosen = store(close.select("id").distinct(), "chosen")

    texts = table.join(by_shuffle(chosen.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    held = sets(texts).select(
        F.col("doc_id").alias("id"), F.size("shingles").alias("n"), F.slice("shingles", 1, SKETCH).alias("sketch"), "shingles"
    )
    held = store(held, "sets")
    links = store(star_links(close, held), "links")
    joined = components(links)

    unsure = store(mixed(close, joined).select("id").distinct(), "unsure")
    if not unsure.isEmpty():
        exact = F.ceil(F.col("m") * PERCENT / 100)
        again = held.join(by_shuffle(unsure), "id", "left_semi").select("id", F.col("shingles").alias("values"))
        lists = store(rare_lists(again, exact), "lists")
        joined = grown(joined, store(star_links(lists, held, joined), "more-links"))
        joined = grown(joined, store(rest_links(lists, joined, held), "rest-links"))

    roots = classes.join(by_shuffle(joined), "id", "left").filter("copies > 1 or component is not null")
    roots = roots.select("n", "d1", "d2", F.coalesce("component", "id").alias("root"))
    copies = classes.select("n", "d1", "d2", F.col("copies").alias("_n"))
    out = salted(known.select("doc_id", "n", "d1", "d2"), by_shuffle(roots), ["n", "d1", "d2"], copies, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(table: DataFrame) -> DataFrame:
    """The rows of ``table`` that are kept: of each group the one with the least
    id (rows without id all stay). Rows are numbered once, in a stored table, so
    that equal ids stay apart."""
    row = free(table, "_lw_row")
    numbered = store(table.withColumn(row, F.monotonically_increasing_id()), "numbered")
    own = F.when(F.col("doc_id").isNotNull(), F.col(row)).alias("doc_id")
    found = near_copies(numbered.select(own, "text"))
    rest = store(found.filter("not kept").select(F.col("doc_id").alias("_lw_row"), F.col("component_id").alias("_lw_group")), "rest")
    members = rest.unionByName(rest.select(F.col("_lw_group").alias("_lw_row"), "_lw_group").distinct())
    members = store(members.join(by_shuffle(numbered.select(F.col(row).alias("_lw_row"), "doc_id")), "_lw_row"), "group-members")
    first = members.groupBy("_lw_group").agg(F.min(F.struct("doc_id", "_lw_row"))["_lw_row"].alias("_lw_first"))
    sizes = store(members.groupBy("_lw_group").agg(F.count("*").alias("_n")), "groups")
    gone = salted(members, by_shuffle(first), "_lw_group", sizes, "_lw_row").filter("_lw_row != _lw_first").select(F.col("_lw_row").alias(row))
    return numbered.join(by_shuffle(gone), row, "left_anti").select(*[F.col(f"`{c}`") for c in table.columns])


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return store(near_copies(docs(spark, sf_dir)), "near-copies", lasting=True)



OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) END AS s FROM w
), u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, max(a.n) AS na, max(b.n) AS nb FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a
), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.x = s.doc_id
"""


portable(__name__)
