"""Classifiers (B1-B5) behind one Estimator interface over plain feature columns.

Each fitted model adds ``pred`` (0/1 int) and ``score`` (probability or
margin of class 1).  Built-in Spark ML estimators do the distributed fitting;
the k-nearest-neighbour classifier is the exact blocked kNN join.
"""

from __future__ import annotations

from typing import Sequence

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.knn import knn_classify

KINDS = ("logistic", "forest", "svc", "knn", "mlp")
#: Rows of a partition that a fit iterates over: each of its many short jobs has one task, and one answer, a partition.
FIT_ROWS = 25_000
#: A forest's task answers with the counts of every open node, and there are more nodes the more rows: so no more tasks
#: than cores, as long as none has more rows than this.
FOREST_ROWS = 1_000_000


def fit_partitions(kind: str, n_rows: int, cores: int) -> int:
    """Partitions that a fit iterates over."""
    parts = max(1, -(-n_rows // FIT_ROWS))
    return max(min(parts, cores), -(-n_rows // FOREST_ROWS)) if kind == "forest" else parts


def _spark_estimator(kind: str, n_rows: int, n_features: int, seed: int, params: dict):
    """Spark ML estimator with the study's settings (tolerances as in the usual
    single-machine defaults: 1e-4)."""
    common = dict(featuresCol="__fv", labelCol="__y")
    if kind == "logistic":
        c = params.get("C", 1.0)
        # sklearn's C penalises 1/(2C)|w|^2 against the summed loss; Spark averages the loss.
        return LogisticRegression(regParam=1.0 / (c * max(n_rows, 1)), elasticNetParam=0.0, standardization=False,
                                  maxIter=params.get("max_iter", 100), tol=params.get("tol", 1e-4), **common)
    if kind == "forest":
        return RandomForestClassifier(numTrees=params.get("n_trees", 100), maxDepth=params.get("max_depth", 30),
                                      featureSubsetStrategy=params.get("features", "sqrt"), seed=seed,
                                      maxBins=params.get("max_bins", 32),
                                      cacheNodeIds=True,  # else every pass walks every row down every tree
                                      **common)
    if kind == "svc":
        c = params.get("C", 1.0)
        return LinearSVC(regParam=1.0 / (c * max(n_rows, 1)), maxIter=params.get("max_iter", 1000),
                         tol=params.get("tol", 1e-4), standardization=False, **common)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, params.get("hidden", 100), 2],
                                              maxIter=params.get("max_iter", 200), tol=params.get("tol", 1e-4),
                                              seed=seed, **common)
    raise ValueError(kind)


class ClassifierModel(Model):
    def __init__(self, kind, features, fitted=None, train=None, key=None, k=5):
        super().__init__()
        self.kind, self.features, self.fitted, self.train, self.key, self.k = kind, list(features), fitted, train, key, k

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.kind == "constant":
            return df.withColumn("pred", F.lit(int(self.fitted))).withColumn("score", F.lit(float(self.fitted)))
        if self.kind == "knn":
            test = df.withColumn("__vec", F.array(*[F.col(f).cast("double") for f in self.features]))
            out = knn_classify(self.train, test, self.key, self.k, "__vec", "__y", "pred")
            return out.withColumn("pred", F.col("pred").cast("int")) \
                .withColumn("score", F.col("pred").cast("double")).drop("__vec")
        va = VectorAssembler(inputCols=self.features, outputCol="__fv", handleInvalid="error")
        out = self.fitted.transform(va.transform(df))
        if "probability" in out.columns:
            score = vector_to_array("probability")[1]
        else:
            score = vector_to_array("rawPrediction")[1]
        out = out.withColumn("pred", F.col("prediction").cast("int")).withColumn("score", score)
        return out.drop("__fv", "rawPrediction", "probability", "prediction")


class Classifier(Estimator):
    """``kind`` in logistic, forest, svc, knn, mlp."""

    def __init__(self, kind: str, features: Sequence[str], label: str = "label", key: Sequence[str] = (),
                 seed: int = 42, **params):
        super().__init__()
        if kind not in KINDS:
            raise ValueError(f"unknown classifier {kind!r}")
        self.kind, self.features, self.label, self.key = kind, list(features), label, list(key)
        self.seed, self.opts = seed, params

    def _fit(self, df: DataFrame) -> ClassifierModel:
        """A NULL or NaN feature is an error here and in ``transform``: impute first."""
        data = df.withColumn("__y", F.col(self.label).cast("double"))
        if not self.features:
            # every feature was dropped or deselected: predict the training majority class
            top = data.groupBy("__y").count().orderBy(F.col("count").desc(), "__y").first()
            return ClassifierModel("constant", [], fitted=int(top["__y"]) if top else 0)
        if self.kind == "knn":
            train = data.select(*self.key, "__y",
                                F.array(*[F.col(f).cast("double") for f in self.features]).alias("__vec"))
            return ClassifierModel("knn", self.features, train=train, key=self.key, k=self.opts.get("k", 5))
        va = VectorAssembler(inputCols=self.features, outputCol="__fv", handleInvalid="error")
        # only (vector, label) is kept for the iterations; released after the fit
        train = va.transform(data).select("__fv", "__y").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = train.count()
            est = _spark_estimator(self.kind, n, len(self.features), self.seed, self.opts)
            fitted = est.fit(train.coalesce(fit_partitions(self.kind, n, df.sparkSession.sparkContext.defaultParallelism)))
        finally:
            train.unpersist()
        return ClassifierModel(self.kind, self.features, fitted=fitted)
