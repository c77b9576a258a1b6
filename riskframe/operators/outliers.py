"""IQR fences and outlier removal (A5, O1, O2)."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.profile import quantiles


def iqr_bounds(df: DataFrame, features: Sequence[str], group_cols: Sequence[str] = (),
               factor: float = 1.5, exact: bool = True) -> DataFrame:
    """A5: (group..., feature, q1, q3, lower, upper), fences ``q1 - f*IQR``, ``q3 + f*IQR``."""
    q = quantiles(df, features, [0.25, 0.75], group_cols, names=["q1", "q3"], exact=exact)
    iqr = F.col("q3") - F.col("q1")
    return q.select(*group_cols, "feature", "q1", "q3",
                    (F.col("q1") - F.lit(factor) * iqr).alias("lower"),
                    (F.col("q3") + F.lit(factor) * iqr).alias("upper"))


def _fence_values(bounds: DataFrame, group_col: str | None) -> dict:
    """{(group, feature): (lower, upper)}: one row per group and feature, bounded."""
    out = {}
    for r in bounds.collect():
        out[(r[group_col] if group_col else None, r["feature"])] = (r["lower"], r["upper"])
    return out


def _outlier(features: Sequence[str], fences: dict, group_col: str | None):
    """OR over features of 'outside the fences'; a missing cell or fence is never an outlier."""
    groups = sorted({g for g, _ in fences}, key=lambda g: (g is None, g))
    tests = []
    for f in features:
        def fence(i):
            if group_col is None:
                v = fences.get((None, f), (None, None))[i]
                return F.lit(v).cast("double")
            e = None
            for g in groups:
                v = fences.get((g, f), (None, None))[i]
                cond = F.col(group_col) == F.lit(g)
                e = F.when(cond, F.lit(v).cast("double")) if e is None else e.when(cond, F.lit(v).cast("double"))
            return e
        x = F.col(f)
        tests.append(F.coalesce((x > fence(1)) | (x < fence(0)), F.lit(False)))
    return reduce(lambda a, b: a | b, tests)


def iqr_removal(df: DataFrame, features: Sequence[str], factor: float = 1.5,
                exact: bool = True) -> DataFrame:
    """O1: drop rows with any feature outside its fences (fences folded in as literals)."""
    fences = _fence_values(iqr_bounds(df, features, (), factor, exact), None)
    return df.where(~_outlier(features, fences, None))


def iqr_removal_by_class(df: DataFrame, features: Sequence[str], label: str = "label",
                         factor: float = 1.5, exact: bool = True) -> DataFrame:
    """O2: fences computed within each class, applied in one pass (no split, no union, no join)."""
    fences = _fence_values(iqr_bounds(df, features, [label], factor, exact), label)
    return df.where(~_outlier(features, fences, label))
