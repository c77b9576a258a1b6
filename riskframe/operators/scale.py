"""Scalers (C1-C5) as Estimator/Model pairs over plain double columns.

Fitted parameters are one small row per feature, folded into the projection as
literals: transform is a single narrow ``select`` (no join, no shuffle).
NULL cells stay NULL.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.profile import feature_stats, quantiles


class AffineModel(Model):
    """x -> (x - shift) / scale per feature."""

    def __init__(self, params: dict[str, tuple[float, float]]):
        super().__init__()
        self.affine = params

    def _transform(self, df: DataFrame) -> DataFrame:
        exprs = []
        for c in df.columns:
            if c in self.affine:
                shift, scale = self.affine[c]
                exprs.append(((F.col(c).cast("double") - F.lit(shift)) / F.lit(scale)).alias(c))
            else:
                exprs.append(F.col(c))
        return df.select(*exprs)


class _Scaler(Estimator):
    def __init__(self, features: Sequence[str]):
        super().__init__()
        self.features = list(features)


class MinMaxScaler(_Scaler):
    """(x - min) / (max - min); a constant feature maps to 0."""

    def _fit(self, df: DataFrame) -> AffineModel:
        rows = feature_stats(df, self.features, stats=("min", "max")).select("feature", "min", "max").collect()
        params = {}
        for r in rows:
            lo, hi = r["min"], r["max"]
            if lo is None:
                params[r.feature] = (0.0, 1.0)
            else:
                rng = hi - lo
                params[r.feature] = (lo, rng if rng != 0 else 1.0)
        return AffineModel(params)


class StandardScaler(_Scaler):
    """(x - mean) / population std; a zero std scales by 1."""

    def _fit(self, df: DataFrame) -> AffineModel:
        rows = feature_stats(df, self.features, stats=("mean", "std_pop")).select("feature", "mean", "std_pop").collect()
        params = {}
        for r in rows:
            mean, sd = r["mean"], r["std_pop"]
            params[r.feature] = (mean if mean is not None else 0.0, sd if sd not in (None, 0.0) else 1.0)
        return AffineModel(params)


class RobustScaler(_Scaler):
    """C4: (x - median) / (q3 - q1) with exact quantiles; a zero range scales by 1."""

    def __init__(self, features: Sequence[str], exact: bool = True):
        super().__init__(features)
        self.exact = exact

    def _fit(self, df: DataFrame) -> AffineModel:
        rows = quantiles(df, self.features, [0.25, 0.5, 0.75], names=["q1", "q2", "q3"],
                         exact=self.exact).collect()
        params = {f: (0.0, 1.0) for f in self.features}
        for r in rows:
            rng = r["q3"] - r["q1"]
            params[r.feature] = (r["q2"], rng if rng != 0 else 1.0)
        return AffineModel(params)


def normalize_rows(df: DataFrame, features: Sequence[str], p: float = 2.0) -> DataFrame:
    """Each row divided by its L-p norm over the features (NULL counts as 0);
    an all-zero row is left unchanged.  Stateless, so no fit step."""
    xs = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    if p == 2.0:
        norm = F.sqrt(reduce(lambda a, b: a + b, [x * x for x in xs]))
    elif p == 1.0:
        norm = reduce(lambda a, b: a + b, [F.abs(x) for x in xs])
    else:
        norm = F.pow(reduce(lambda a, b: a + b, [F.pow(F.abs(x), p) for x in xs]), 1.0 / p)
    div = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    feats = set(features)
    return df.select(*[(F.col(c).cast("double") / div).alias(c) if c in feats else F.col(c) for c in df.columns])


class Identity(Model):
    """The no-scaling step."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df
