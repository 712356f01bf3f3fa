"""`pyspark.ml` estimators under short ids, on tasks: train and predict tables
of (row_id, truth, response, score)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..task import Task

LEARNERS: dict[str, tuple[type, dict[str, Any]]] = {
    "classif.logreg": (C.LogisticRegression, {"maxIter": 100}),
    "classif.tree": (C.DecisionTreeClassifier, {"seed": 1}),
    "classif.forest": (C.RandomForestClassifier, {"numTrees": 100, "seed": 1}),
    "classif.gbt": (C.GBTClassifier, {"maxIter": 100, "stepSize": 0.1, "seed": 1}),
    "classif.svm": (C.LinearSVC, {}),
    "classif.nb": (C.NaiveBayes, {"modelType": "gaussian"}),
    "regr.lm": (R.LinearRegression, {"solver": "normal"}),
    "regr.ridge": (R.LinearRegression, {"elasticNetParam": 0.0, "regParam": 1.0}),
    "regr.lasso": (R.LinearRegression, {"elasticNetParam": 1.0, "regParam": 1.0}),
    "regr.elastic": (R.LinearRegression, {"elasticNetParam": 0.5, "regParam": 1.0}),
    "regr.tree": (R.DecisionTreeRegressor, {"seed": 1}),
    "regr.forest": (R.RandomForestRegressor, {"numTrees": 100, "seed": 1}),
    "regr.gbt": (R.GBTRegressor, {"maxIter": 100, "stepSize": 0.1, "seed": 1}),
    "cluster.kmeans": (K.KMeans, {"k": 3, "seed": 1}),
    "cluster.gmm": (K.GaussianMixture, {"k": 3, "seed": 1}),
    "cluster.bisecting": (K.BisectingKMeans, {"k": 3, "seed": 1}),
}


def _number(column: str):
    """The column as a double, NaN as null."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


@dataclass(frozen=True)
class Fitted:
    model: PipelineModel
    kind: str
    row_id: str
    target: str | None
    features: tuple[str, ...] = ()

    def add(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the response in ``name`` and, for classifiers that give one, the likeliest
        class's share in ``name``_score; both are null where a feature is null or NaN."""
        known, filled = F.lit(True), {}
        for f in self.features:
            v = _number(f)
            known, filled[f] = known & v.isNotNull(), F.coalesce(v, F.lit(0.0))
        rows = df.select(F.struct(*df.columns).alias("_row"), known.alias("_known"), *[v.alias(f) for f, v in filled.items()])
        out = self.model.transform(rows)
        made = [F.when(F.col("_known"), F.col("_response")).alias(name)]
        if "_probability" in out.columns:
            made.append(F.when(F.col("_known"), F.array_max(vector_to_array("_probability"))).alias(f"{name}_score"))
        return out.select(*[F.col("_row")[c].alias(c) for c in df.columns], *made)

    def predict(self, df: DataFrame) -> DataFrame:
        """(row_id, truth, response, score) of every row of ``df``, as ``add`` gives them."""
        out = self.add(df, "_m")
        truth = F.col(self.target) if self.target and self.target in df.columns else F.lit(None).cast("string")
        columns = [F.col(self.row_id), truth.alias("truth"), F.col("_m").alias("response")]
        if "_m_score" in out.columns:
            columns.append(F.col("_m_score").alias("score"))
        return out.select(*columns)


def train(learner: str, task: Task, **params) -> Fitted:
    """Fits ``learner`` on the task's features; ``params`` override its settings. Rows with a
    null or NaN feature, or without target, teach nothing; neither do rows whose weight, if the task has a
    weight column, is null or not above zero."""
    cls, settings = LEARNERS[learner]
    kind = learner.partition(".")[0]
    estimator = cls(featuresCol="_features", **(settings | params))
    weight = next(iter(task.columns("weight")), None)
    if text := [f for f in task.features if dict(task.df.dtypes)[f] in ("string", "binary", "date") or "<" in dict(task.df.dtypes)[f]]:
        raise ValueError(f"features that aren't numbers: {text}")
    df = task.df.withColumns({f: _number(f) for f in task.features}).dropna(subset=[*task.features, *task.columns("target")])
    if weight:
        if not estimator.hasParam("weightCol"):
            raise ValueError(f"{learner} takes no weights")
        df = df.filter(F.col(weight) > 0)
        estimator = estimator.setWeightCol(weight)
    stages = [VectorAssembler(inputCols=task.features, outputCol="_features")]
    known = (kind, task.row_id, task.target, tuple(task.features))
    if kind == "classif":
        index = StringIndexer(inputCol=task.target, outputCol="_label", stringOrderType="alphabetAsc").fit(df)
        estimator = estimator.setLabelCol("_label").setPredictionCol("_prediction")
        if estimator.hasParam("probabilityCol"):
            estimator = estimator.setProbabilityCol("_probability")
        fitted = Pipeline(stages=[*stages, estimator]).fit(index.transform(df))
        back = IndexToString(inputCol="_prediction", outputCol="_response", labels=index.labels)
        return Fitted(PipelineModel([*fitted.stages, back]), *known)
    estimator = estimator.setPredictionCol("_response")
    if kind == "regr":
        estimator = estimator.setLabelCol(task.target)
    return Fitted(Pipeline(stages=[*stages, estimator]).fit(df), *known)


def folded(task: Task, folds: int = 5, seed: int = 0) -> DataFrame:
    """The task's rows with ``_fold``, computed once for all the models fitted on them."""
    from .resample import cv

    return cut(cv(task.df, task.row_id, folds, seed).withColumnRenamed("fold", "_fold"))


def resample(learner: str, task: Task, folds: int = 5, seed: int = 0, rows: DataFrame | None = None, **params) -> DataFrame:
    """(row_id, truth, response, ..., fold) of every row, predicted by the model
    that wasn't trained on its fold; ``rows`` are those of ``folded``, where several learners share them."""
    rows = folded(task, folds, seed) if rows is None else rows
    out = None
    for k in range(folds):
        model = train(learner, task.with_df(rows.filter(F.col("_fold") != k).drop("_fold")), **params)
        one = model.predict(rows.filter(F.col("_fold") == k)).withColumn("fold", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def benchmark(tasks: dict[str, Task], learners: dict[str, dict[str, Any]], folds: int = 5, seed: int = 0) -> DataFrame:
    """(task, learner, fold, measure, score, error) of every pair: accuracy for
    classes, rmse for numbers. A pair that fails is a row with its error and no
    score; the others still run."""
    from .measures import accuracy, regression

    spark = next(iter(tasks.values())).df.sparkSession
    rows: list[tuple] = []
    for name, task in tasks.items():
        parts = folded(task, folds, seed)
        for learner, params in learners.items():
            try:
                pred = resample(learner, task, folds, seed, parts, **params)
                kind = learner.partition(".")[0]
                found = accuracy(pred, "truth", "response", ["fold"]) if kind == "classif" else regression(pred, "truth", "response", ["fold"])
                measure = "acc" if kind == "classif" else "rmse"
                rows += [(name, learner, r["fold"], measure, float(r[measure]), None) for r in found.collect()]  # a row a fold
            except Exception as e:  # noqa: BLE001  reported as a row
                rows.append((name, learner, None, None, None, str(e).splitlines()[0][:200]))
    return spark.createDataFrame(rows, "task string, learner string, fold int, measure string, score double, error string")


def pca(df: DataFrame, columns: list[str], k: int, whiten: bool = False) -> DataFrame:
    """PC1 to PCk in place of ``columns``: centred first, unit variance if ``whiten``.
    Signs are as the solver gives them."""
    from pyspark.ml.feature import PCA

    mean = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centred = df.withColumns({c: F.col(c) - F.lit(mean[c]) for c in columns})
    rows = VectorAssembler(inputCols=columns, outputCol="_v").transform(centred)
    out = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).transform(rows).withColumn("_p", vector_to_array("_p"))
    out = out.select(*[c for c in df.columns if c not in columns], *[F.get("_p", F.lit(i)).alias(f"PC{i + 1}") for i in range(k)])
    if whiten:
        std = out.agg(*[F.stddev_samp(f"PC{i + 1}").alias(f"PC{i + 1}") for i in range(k)]).first()
        out = out.withColumns({c: F.col(c) / F.lit(std[c] or 1.0) for c in (f"PC{i + 1}" for i in range(k))})
    return out


def stack(base: dict[str, tuple[str, dict[str, Any]]], meta: str, task: Task, folds: int = 5, seed: int = 0) -> DataFrame:
    """Predictions of ``meta``, fitted on the base learners' out-of-fold predictions.
    ``base`` maps names to (learner, settings); numbers only."""
    rows, parts = task.df.select(task.row_id, task.target), folded(task, folds, seed)
    for name, (learner, params) in base.items():
        one = resample(learner, task, folds, seed, parts, **params).select(task.row_id, F.col("response").alias(f"_p_{name}"))
        rows = rows.join(one, task.row_id)
    over = Task(rows, task.row_id, {task.target: "target"})
    return train(meta, over).predict(rows)


def _rmse():
    return F.sqrt(F.avg(F.pow(F.col("truth") - F.col("response"), F.lit(2))))


def permutation_importance(fitted: Fitted, task: Task, seed: int = 0) -> DataFrame:
    """(feature, importance): how much the root mean squared error of a regression grows
    when a feature's values are dealt anew. Values move to the next position of the random
    order, found by cells, so that no task holds a column."""
    from .resample import shuffled

    def error(df: DataFrame, name: str) -> DataFrame:
        return fitted.predict(df).agg(_rmse().alias("importance")).select(F.lit(name).alias("feature"), "importance")

    placed = shuffled(task.df, task.row_id, seed, "_at")
    n = placed.count()
    out = None
    for f in task.features:
        moved = placed.select(F.pmod(F.col("_at") + 1, F.lit(max(1, n))).alias("_at"), F.col(f).alias("_new"))
        one = error(placed.join(moved, "_at").withColumn(f, F.col("_new")).drop("_new", "_at"), f)
        out = one if out is None else out.unionByName(one)
    plain = error(task.df, "_").select(F.col("importance").alias("_e"))
    return out.crossJoin(F.broadcast(plain)).select("feature", (F.col("importance") - F.col("_e")).alias("importance"))  # one row


def tried(learner: str, task: Task, every: list[dict[str, Any]], folds: int = 5, seed: int = 0) -> DataFrame:
    """(params, score): each setting by the mean of its folds' error: misclassified share
    for classes, root mean squared error for numbers."""
    out, parts = None, folded(task, folds, seed)
    for params in every:
        pred = resample(learner, task, folds, seed, parts, **params)
        wrong = F.avg((F.col("truth") != F.col("response")).cast("double")) if learner.startswith("classif") else _rmse()
        one = pred.groupBy("fold").agg(wrong.alias("_e")).agg(F.avg("_e").alias("score")).select(F.lit(repr(params)).alias("params"), "score")
        out = one if out is None else out.unionByName(one)
    return out


def grid(learner: str, task: Task, settings: dict[str, list[Any]], folds: int = 5, seed: int = 0) -> DataFrame:
    """``tried`` on every combination of ``settings``."""
    from itertools import product

    return tried(learner, task, [dict(zip(settings, v, strict=True)) for v in product(*settings.values())], folds, seed)


def random_search(learner: str, task: Task, settings: dict[str, list[Any]], n: int = 10, folds: int = 5, seed: int = 0) -> DataFrame:
    """``tried`` on ``n`` different combinations of ``settings`` drawn by ``seed``; on all, if there are no more."""
    from itertools import product
    from random import Random

    every = [dict(zip(settings, v, strict=True)) for v in product(*settings.values())]
    return tried(learner, task, Random(seed).sample(every, min(n, len(every))), folds, seed)


def blend(base: dict[str, tuple[str, dict[str, Any]]], meta: str, task: Task, share: float = 0.3, seed: int = 0) -> DataFrame:
    """Predictions of ``meta`` for every row; base learners learn from the rows that a holdout
    keeps and ``meta`` from their predictions for the ``share`` left out. Numbers only."""
    from .resample import holdout

    parts = holdout(task.df, task.row_id, 1 - share, seed)
    known = task.with_df(parts.filter("is_train").drop("is_train"))
    rows = parts.select(task.row_id, task.target, "is_train")
    for name, (learner, params) in base.items():
        one = train(learner, known, **params).predict(task.df).select(task.row_id, F.col("response").alias(f"_p_{name}"))
        rows = rows.join(one, task.row_id)
    over = Task(rows.filter("not is_train").drop("is_train"), task.row_id, {task.target: "target"})
    return train(meta, over).predict(rows)


def importance(fitted: Fitted, task: Task) -> dict[str, float]:
    """What the model itself gives a feature: its share in a tree's splits, or the size of
    its coefficient times its deviation."""
    model = next(m for m in reversed(fitted.model.stages) if hasattr(m, "featureImportances") or hasattr(m, "coefficientMatrix") or hasattr(m, "coefficients"))
    if hasattr(model, "featureImportances"):
        return dict(zip(task.features, map(float, model.featureImportances.toArray()), strict=True))
    rows = model.coefficientMatrix.toArray() if hasattr(model, "coefficientMatrix") else [model.coefficients.toArray()]
    std = task.df.agg(*[F.stddev_pop(f).alias(f) for f in task.features]).first()
    return {f: sum(abs(float(r[i])) for r in rows) * (std[f] or 0.0) for i, f in enumerate(task.features)}


def eliminate(learner: str, task: Task, k: int, step: int = 1, **params) -> DataFrame:
    """(feature, rank): the ``k`` features left have rank 1; each round fits the model again
    and takes the ``step`` least important ones away (ties: the later name), the first of
    them with the highest rank."""
    left, gone = sorted(task.features), []
    while len(left) > k:
        one = Task(task.df.select(task.row_id, *left, task.target), task.row_id, {task.target: "target"})
        worth = importance(train(learner, one, **params), one)
        out = sorted(sorted(left, reverse=True), key=lambda f: worth[f])[: min(step, len(left) - k)]
        gone.append(out)
        left = [f for f in left if f not in out]
    rows = [(f, 1) for f in left] + [(f, i + 2) for i, out in enumerate(reversed(gone)) for f in out]
    return task.df.sparkSession.createDataFrame(rows, "feature string, rank int")
