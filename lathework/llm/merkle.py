"""Operator 13: a Merkle manifest of a dataset by slot pivots.

Every row has a leaf, the digest of its columns. The leaves of a language are
numbered by id; conditional aggregates spread the children of a parent into
``FANOUT`` slot columns, whose concatenation is hashed, level by level, until one
node a language is left. The languages' subroots are numbered and hashed in the same
way to the root. From the root down, every slot column but a node's own gives its
siblings: what stands before it and what stands after it. A row's path is the list of
these pairs from leaf to root; folding a leaf along it gives a root again, which
equals the true one only if the row is what it was.

Leaves carry their row through the first pivot and leave it again at the end, so
that leaves are shuffled twice (by range for their number, by parent for the pivot)
and never joined. Texts stay where they are read. A level has an eighth of the rows
of the one below. A hot language's leaves, and repeated rows, fill many tasks.

Cases: null columns are written ``-``; an empty text is ``0:``; a null id comes first
and, as its crc32 is that of the empty text, is tampered with; rows that repeat an id
are ordered by their leaf, and rows alike in all are leaves of their own; a null
language is one of its own; a lone leaf is its language's subroot and a lone subroot
the root; a row without siblings has the digest of the empty text as proof; an empty
table gives an empty result; more columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs, numbered, scratch, store

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts in a row; a missing part is empty."""
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256)


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: a null is ``-``, all else its length in bytes, a colon and itself."""
    texts = [c.cast("string") for c in columns]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(path: Column, node: Column) -> Column:
    """The root that a node's digest and its path lead to."""
    return F.aggregate(path, node, lambda acc, x: digest(x["before"], acc, x["after"]))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, from leaf to root."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""))


def pivot(nodes: DataFrame) -> DataFrame:
    """(grp, pos, n, digest, c0, c1, ...): the parents of (grp, pos, n, node), where node is
    a struct that begins with its digest."""
    slot = F.pmod("pos", F.lit(FANOUT))
    spread = [F.max(F.when(slot == i, F.col("node"))).alias(f"c{i}") for i in range(FANOUT)]
    parents = nodes.groupBy("grp", F.floor(F.col("pos") / FANOUT).alias("pos"), F.ceil(F.col("n") / FANOUT).alias("n")).agg(*spread)
    return parents.withColumn("digest", digest(*[F.col(f"c{i}.digest") for i in range(FANOUT)]))


def children(parents: DataFrame, more: list[str]) -> DataFrame:
    """The nodes below ``parents``, which have path, with their own paths and the
    parent's columns ``more``."""
    kids = [F.coalesce(F.col(f"c{i}.digest"), F.lit("")) for i in range(FANOUT)]

    def below(i: int) -> Column:
        step = F.struct(F.concat(F.lit(""), *kids[:i]).alias("before"), F.concat(F.lit(""), *kids[i + 1 :]).alias("after"))
        path = F.concat(F.array(step), F.col("path"))
        return F.when(F.col(f"c{i}").isNotNull(), F.struct((F.col("pos") * FANOUT + i).alias("pos"), F.col(f"c{i}").alias("node"), path.alias("path")))

    each = parents.select("grp", *more, F.explode(F.array_compact(F.array(*map(below, range(FANOUT))))).alias("x"))
    return each.select("grp", *more, "x.pos", "x.node", "x.path")


class Tree:
    """A forest with a tree a group, from (grp, pos, n, node) with numbered nodes."""

    def __init__(self, nodes: DataFrame) -> None:
        self.leaves = nodes
        self.levels: list[DataFrame] = []
        most = nodes.agg(F.max("n")).first()[0] or 0
        while most > 1:
            nodes = nodes.filter("n > 1")
            level = store(pivot(nodes), "level")
            self.levels.append(level)
            nodes, most = level.select("grp", "pos", "n", F.struct("digest").alias("node")), -(-most // FANOUT)

    def roots(self) -> DataFrame:
        """(grp, digest), a row a group."""
        out = self.leaves.filter("n = 1").select("grp", F.col("node.digest").alias("digest"))
        for level in self.levels:
            out = out.unionByName(level.filter("n = 1").select("grp", "digest"))
        return out

    def paths(self, tops: DataFrame, more: list[str]) -> DataFrame:
        """(grp, *more, pos, node, path) of every leaf. ``tops`` has a row a group: the
        path from its root upwards and the columns ``more``."""
        below = None
        for level in reversed(self.levels):
            here = beside(level.filter("n = 1"), tops, ["grp"])
            if below is not None:
                kids = below.select("grp", *more, "pos", "path")
                here = here.unionByName(beside(level.filter("n > 1"), kids, ["grp", "pos"]).select(here.columns))
            below = children(here, more)
        lone = beside(self.leaves.filter("n = 1"), tops, ["grp"]).select("grp", *more, "pos", "node", "path")
        return lone if below is None else below.unionByName(lone)


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on ``keys``, where null equals null."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]).drop(*[f"_r_{k}" for k in keys])


def manifest(leaves: DataFrame) -> DataFrame:
    """(grp, node, path, subroot, root) of every row of ``leaves``: (grp, ordinal, node),
    where node is a struct that begins with the leaf's digest and may carry more."""
    order = leaves.select("grp", "ordinal", "node").withColumn("_leaf", F.col("node.digest"))
    trees = Tree(numbered(order, ["grp"], ["ordinal", "_leaf"], "leaves"))
    subroots = store(trees.roots(), "subroots")
    named = subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("name"), F.struct("digest", F.col("grp").alias("name")).alias("node"))
    crown = Tree(numbered(named, ["grp"], ["name"], "crown"))
    root = crown.roots().select("grp", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    tops = crown.paths(root, ["root"]).select(F.col("node.name").alias("grp"), F.col("node.digest").alias("subroot"), "root", "path")
    return trees.paths(store(tops, "tops"), ["subroot", "root"])


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof, and whether its tampered text is noticed."""
    table = docs(spark, sf_dir)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    own = [F.col(c) for c in COLUMNS]
    node = F.struct(leaf(own).alias("digest"), "doc_id", F.when(hit, leaf([*own[:-1], lower])).alias("tampered"))
    with scratch(spark):
        leaves = table.select(F.col("lang").alias("grp"), F.col("doc_id").alias("ordinal"), node.alias("node"))
        rows = manifest(store(leaves, "digests"))  # dealing by range reads its input twice
        out = rows.select(
            "node.doc_id", F.col("node.digest").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
            fold(F.col("path"), F.coalesce("node.tampered", "node.digest")).alias("folded_root"),
        )
        return store(out.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest", lasting=True)


#: crc32 of a text of ASCII characters, bit by bit.
CRC = """list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)), lambda crc, b:
 list_reduce(list_prepend(xor(crc, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))"""

FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"

OP13_SQL = f"""
WITH RECURSIVE leaves AS (
 SELECT doc_id, lang,
  sha256({" || ".join(FIELD.format(c) for c in COLUMNS)}) AS leaf,
  CASE WHEN xor(({CRC.format("doc_id::VARCHAR")})::BIGINT, 4294967295) % 3 = 0
   THEN sha256({" || ".join(FIELD.format(c) for c in COLUMNS[:-1])} || {FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS bad
 FROM documents),
placed AS (
 SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
low AS (
 SELECT lang, 0 AS lvl, pos, leaf AS h, n FROM placed
 UNION ALL
 SELECT lang, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM low WHERE n > 1 GROUP BY lang, lvl, pos // 8),
sub AS (
 SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
 SELECT 0 AS lvl, pos, h, n FROM sub
 UNION ALL
 SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM high WHERE n > 1 GROUP BY lvl, pos // 8),
kids AS (
 SELECT false AS top, lang, lvl, pos // 8 AS up, list(h ORDER BY pos) AS hs FROM low WHERE n > 1 GROUP BY ALL
 UNION ALL SELECT true, NULL, lvl, pos // 8, list(h ORDER BY pos) FROM high WHERE n > 1 GROUP BY ALL),
walk AS (
 SELECT doc_id, leaf, lang, false AS top, 0 AS lvl, pos, n, coalesce(bad, leaf) AS h, '' AS seen FROM placed
 UNION ALL
 SELECT w.doc_id, w.leaf, w.lang, w.top OR w.n = 1, CASE WHEN w.n = 1 THEN 0 ELSE w.lvl + 1 END, CASE WHEN w.n = 1 THEN s.pos ELSE w.pos // 8 END, CASE WHEN w.n = 1 THEN s.n ELSE (w.n + 7) // 8 END,
  CASE WHEN w.n = 1 THEN w.h ELSE sha256(array_to_string(list_concat(k.hs[:w.pos % 8], [w.h], k.hs[w.pos % 8 + 2:]), '')) END,
  CASE WHEN w.n = 1 THEN w.seen ELSE w.seen || array_to_string(list_concat(k.hs[:w.pos % 8], k.hs[w.pos % 8 + 2:]), '') END
 FROM walk w LEFT JOIN kids k ON w.n > 1 AND k.top = w.top AND (w.top OR k.lang IS NOT DISTINCT FROM w.lang) AND k.lvl = w.lvl AND k.up = w.pos // 8
 LEFT JOIN sub s ON w.n = 1 AND s.lang IS NOT DISTINCT FROM w.lang
 WHERE NOT (w.top AND w.n = 1))
SELECT w.doc_id, w.leaf, s.h AS subroot, r.h AS root, sha256(w.seen) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM walk w JOIN sub s ON s.lang IS NOT DISTINCT FROM w.lang CROSS JOIN (SELECT h FROM high WHERE n = 1) r WHERE w.top AND w.n = 1
"""
