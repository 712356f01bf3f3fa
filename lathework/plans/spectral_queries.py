"""Spectral clustering, on the embeddings' components."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from ..operators import spectral as S
from ..sources.readers import table
from .catalogue import Catalogue

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql


def _at(i: int):
    return F.col("embedding")[i].cast("double")


@C.add(
    "spectral_graph",
    """WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings WHERE embedding[1] IS NOT NULL AND embedding[2] IS NOT NULL),
c AS (SELECT floor(x / 0.05::DOUBLE)::BIGINT AS i, floor(y / 0.05::DOUBLE)::BIGINT AS j, count(*) AS n, avg(x) AS x, avg(y) AS y FROM p GROUP BY 1, 2)
SELECT a.i, a.j, any_value(a.n) AS n, count(*) AS edges, round(sum(a.n * b.n * exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) * 400)), 6) AS degree FROM c a, c b WHERE abs(a.i - b.i) <= 2 AND abs(a.j - b.j) <= 2 GROUP BY 1, 2""",
)
def _(spark, d):
    """Each cell's edges and degree in the affinity graph."""
    p = table(spark, d, "embeddings").select(_at(0).alias("x"), _at(1).alias("y"))
    nodes, edges = S.affinity(p, ["x", "y"], 0.05, 400.0)
    per = edges.groupBy(F.col("a").alias("cell")).agg(F.count("*").alias("edges"))
    return nodes.join(per, "cell").select(F.col("cell")[0].alias("i"), F.col("cell")[1].alias("j"), "n", "edges", F.round("degree", 6).alias("degree"))


@C.add(
    "spectral_rings",
    """WITH p AS (SELECT vec_id, embedding[2] > 0 AS outer_ring FROM embeddings WHERE embedding[1] IS NOT NULL AND embedding[2] IS NOT NULL AND embedding[3] IS NOT NULL),
r AS (SELECT outer_ring, row_number() OVER (ORDER BY count(*) DESC) - 1 AS cluster FROM p GROUP BY 1)
SELECT vec_id, cluster FROM embeddings LEFT JOIN p USING (vec_id) LEFT JOIN r USING (outer_ring)""",
)
def _(spark, d):
    """Rows laid on two rings, one inside the other, by their components: the clusters are the rings, which
    no clustering by centres can tell apart."""
    turn = F.lit(2 * pi) * (_at(0) * 97 - F.floor(_at(0) * 97))
    r = F.when(_at(1) > 0, 3.0).when(_at(1) <= 0, 1.0) + 0.2 * _at(2)
    p = table(spark, d, "embeddings").select("vec_id", (r * F.cos(turn)).alias("x"), (r * F.sin(turn)).alias("y"))
    return S.spectral(p, "vec_id", ["x", "y"], 2, 0.5)
