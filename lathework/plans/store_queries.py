"""Models of the given tables, registered, promoted and loaded again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import learners as L
from ..operators import measures as M
from ..operators.model_store import ModelStore
from ..session import cut, shared_dir
from ..sources.readers import table
from ..task import Task
from .catalogue import Catalogue

C = Catalogue()
QUERIES, ORACLE_SQL = C.queries, C.sql


@C.add(
    "model_store",
    """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE + 0.5::DOUBLE * embedding[1] + 0.2::DOUBLE * embedding[2] AS y FROM embeddings),
l AS (SELECT 1 AS version, 'archived' AS stage, vec_id, b AS v, y FROM p UNION ALL SELECT 2, 'production', vec_id, x, y FROM p),
f AS (SELECT version, regr_slope(y, v) AS s, regr_intercept(y, v) AS i FROM l GROUP BY 1),
r AS (SELECT version, stage, vec_id, i + s * v AS response, y FROM l JOIN f USING (version)), m AS (SELECT version, sqrt(avg(pow(response - y, 2))) AS rmse FROM r GROUP BY 1)
SELECT version::INT AS version, stage, round(rmse, 6) AS rmse, vec_id, round(response, 6) AS response FROM r JOIN m USING (version)""",
)
def _(spark, d):
    """Two lines are versions of a model and go into production one after the other; both are found by
    their stage, loaded and predict every row."""
    at = lambda i: F.col("embedding")[i].cast("double")
    p = table(spark, d, "embeddings").select("vec_id", at(0).alias("x"), at(1).alias("b"), (at(2) + 0.5 * at(0) + 0.2 * at(1)).alias("y"))
    task = Task(p, "vec_id", {"y": "target"})
    store = ModelStore(spark, f"{shared_dir(spark)}/models-{uuid.uuid4().hex}")
    for f in ("b", "x"):
        model = L.train("regr.lm", task.select([f]))
        rmse = M.regression(model.predict(p), "truth", "response").first()["rmse"]
        store.set_stage("line", store.register("line", model, {"rmse": rmse}, {"feature": f}), "production")
    out = None
    for stage in ("archived", "production"):
        row = store.search(stage, at_least={"rmse": 0.0}).first()
        pred = store.load("line", stage=stage).predict(p)
        one = pred.select(F.lit(row["version"]).alias("version"), F.lit(stage).alias("stage"), F.round(F.lit(row["metrics"]["rmse"]), 6).alias("rmse"), "vec_id", F.round("response", 6).alias("response"))
        out = one if out is None else out.unionByName(one)
    out = cut(out)
    store._files().delete(store._at(), True)
    return out
