"""Feature selection."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.profile import correlation


class SelectedModel(Model):
    def __init__(self, features: Sequence[str], selected: Sequence[str]):
        super().__init__()
        self.features, self.selected = list(features), list(selected)

    def _transform(self, df: DataFrame) -> DataFrame:
        drop = [f for f in self.features if f not in self.selected]
        return df.drop(*drop)


def percentile_mask(scores: dict[str, float | None], features: Sequence[str], percentile: float) -> list[str]:
    """Keep score > cut, cut = the (100 - percentile) % quantile (linear) of the defined
    scores; scores equal to the cut fill up to floor(n * percentile / 100) in feature order.
    Undefined (NULL) scores are never kept."""
    vals = sorted(v for v in scores.values() if v is not None and not math.isnan(v))
    if not vals:
        return []
    q = 1.0 - percentile / 100.0
    pos = (len(vals) - 1) * q
    lo, hi = math.floor(pos), math.ceil(pos)
    cut = vals[lo] + (vals[hi] - vals[lo]) * (pos - lo)
    keep = [f for f in features if scores.get(f) is not None and scores[f] > cut]
    room = int(len(features) * percentile / 100) - len(keep)
    for f in features:
        if room <= 0:
            break
        if scores.get(f) is not None and scores[f] == cut and f not in keep:
            keep.append(f)
            room -= 1
    return [f for f in features if f in keep]


class SelectPercentile(Estimator):
    """Top ``percentile`` % of features by |corr(feature, label)|.

    The score table has one row per feature, so the cut is computed on the
    driver from a bounded collect.
    """

    def __init__(self, features: Sequence[str], label: str = "label", percentile: float = 10.0):
        super().__init__()
        self.features, self.label, self.percentile = list(features), label, percentile

    def scores(self, df: DataFrame) -> DataFrame:
        return correlation(df, self.features, self.label)

    def _fit(self, df: DataFrame) -> SelectedModel:
        scores = {r.feature: r.value for r in self.scores(df).collect()}
        return SelectedModel(self.features, percentile_mask(scores, self.features, self.percentile))


class SelectFromL1(Estimator):
    """Keep features with a non-zero coefficient in an L1-penalised linear model.

    Spark's LinearSVC has no L1 penalty, so the L1 model is logistic regression
    with ``elasticNetParam=1``.  ``c`` weighs the summed loss against the
    penalty; Spark averages the loss, so its penalty is 1 / (c n).  A NULL or
    NaN feature is an error.
    """

    def __init__(self, features: Sequence[str], label: str = "label", c: float = 0.01, max_iter: int = 100):
        super().__init__()
        self.features, self.label, self.c, self.max_iter = list(features), label, c, max_iter

    def penalty(self, n: int) -> float:
        return 1.0 / (self.c * max(n, 1))

    def coefficients(self, df: DataFrame) -> dict[str, float]:
        from pyspark import StorageLevel
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler
        va = VectorAssembler(inputCols=self.features, outputCol="__x", handleInvalid="error")
        data = va.transform(df.select(*self.features, F.col(self.label).cast("double").alias("__y")))
        data = data.select("__x", "__y").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            lr = LogisticRegression(featuresCol="__x", labelCol="__y", elasticNetParam=1.0,
                                    regParam=self.penalty(data.count()), maxIter=self.max_iter, tol=1e-8, standardization=False)
            m = lr.fit(data)
            self.intercept = float(m.intercept)
        finally:
            data.unpersist()
        return dict(zip(self.features, m.coefficients.toArray().tolist()))

    def _fit(self, df: DataFrame) -> SelectedModel:
        coef = self.coefficients(df)
        return SelectedModel(self.features, [f for f in self.features if abs(coef[f]) > 0.0])
