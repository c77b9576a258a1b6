"""Projections, filters and cleaning.

Filters and projections stay declarative so Catalyst pushes them into the
scan; fitted cleaners compute one small per-feature table (bounded by the
column count) and apply it as literals, never by joining rows.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.rules import Rule, all_of, row_mean, yes_no
from riskframe.operators.profile import feature_stats


def filter_rules(df: DataFrame, rules: Sequence[Rule | Column]) -> DataFrame:
    """keep rows satisfying every rule (missing-value safe)."""
    return df.where(all_of(rules))


def cycle_in(df: DataFrame, cycles: Sequence[int], cycle_col: str = "SDDSRVYR") -> DataFrame:
    """release-cycle membership; prunes partitions when stored by cycle."""
    return df.where(F.col(cycle_col).isin(list(cycles)))


def dropna_subset(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """drop rows with a missing value in any of ``subset``."""
    return df.dropna(how="any", subset=list(subset))


def _check(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")


def drop_columns(df: DataFrame, cols: Sequence[str], strict: bool = True) -> DataFrame:
    """leakage drop. ``strict`` fails on unknown names (Spark would ignore them)."""
    if strict:
        _check(df, cols)
    return df.drop(*cols)


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fixed projection; a missing column is an error."""
    _check(df, cols)
    return df.select(*cols)


def select_available(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """intersection of ``wanted`` with the frame's columns, frame order."""
    keep = set(wanted)
    return df.select(*[c for c in df.columns if c in keep])


class _Fitted(Model):
    def __init__(self, **state):
        super().__init__()
        self.__dict__.update(state)


class ColumnDropModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped)


class DropSparse(Estimator):
    """drop features whose non-null count is below ``rows * threshold``.

    The comparison is ``count >= rows * threshold`` (a column exactly at the
    threshold is kept).  ``threshold=1.0`` drops every column with a NULL.
    """

    def __init__(self, features: Sequence[str], threshold: float = 0.5):
        super().__init__()
        self.features, self.threshold = list(features), threshold

    def report(self, df: DataFrame) -> DataFrame:
        st = feature_stats(df, self.features, stats=("count",))
        return st.select("feature", F.col("count").alias("non_null"), "rows",
                         (F.col("count") >= F.col("rows") * F.lit(self.threshold)).cast("int").alias("keep"))

    def _fit(self, df: DataFrame) -> ColumnDropModel:
        rows = self.report(df).collect()  # one row per feature
        kept = [r.feature for r in rows if r.keep]
        order = {f: i for i, f in enumerate(self.features)}
        kept.sort(key=order.get)
        return ColumnDropModel(kept=kept, dropped=[f for f in self.features if f not in kept])


def DropAnyNull(features: Sequence[str]) -> DropSparse:
    """drop every feature that has at least one NULL."""
    return DropSparse(features, threshold=1.0)


class ImputerModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        fills = self.fills
        exprs = []
        for c in df.columns:
            if c in self.dropped:
                continue
            if c in fills:
                exprs.append(F.coalesce(F.col(c).cast("double"), F.lit(fills[c])).alias(c))
            else:
                exprs.append(F.col(c))
        return df.select(*exprs)


class MeanImputer(Estimator):
    """fill NULL with the training mean.

    A feature that is NULL in every training row is dropped (default), or kept
    and filled with 0 when ``keep_empty``.  Spark's ``Imputer`` fails on such a
    column, so the empty ones are found first from the same statistics pass.
    """

    def __init__(self, features: Sequence[str], keep_empty: bool = False):
        super().__init__()
        self.features, self.keep_empty = list(features), keep_empty

    def _fit(self, df: DataFrame) -> ImputerModel:
        rows = feature_stats(df, self.features, stats=("count", "mean")).select("feature", "count", "mean").collect()
        fills, dropped = {}, []
        for r in rows:
            if r["count"] == 0:
                if self.keep_empty:
                    fills[r.feature] = 0.0
                else:
                    dropped.append(r.feature)
            else:
                fills[r.feature] = float(r["mean"])
        return ImputerModel(fills=fills, dropped=dropped)


def fill_value(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    """constant fill."""
    targets = set(cols)
    return df.select(*[F.coalesce(F.col(c), F.lit(value)).alias(c) if c in targets else F.col(c)
                       for c in df.columns])


def quality_report(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, rows, nulls) in one pass; ``assert_clean`` fails on any NULL."""
    st = feature_stats(df, features, stats=("count",))
    return st.select("feature", "rows", (F.col("rows") - F.col("count")).alias("nulls"))


def assert_clean(report: DataFrame) -> None:
    bad = report.where(F.col("nulls") > 0).limit(1).collect()
    if bad:
        raise AssertionError(f"missing values in {bad[0].feature}")


def harmonize(df: DataFrame, target: str, sources: Mapping[str, Sequence[int]],
              cycle_col: str = "SDDSRVYR") -> DataFrame:
    """F16: one variable stored under a different name per cycle.

    ``sources`` maps a source column to the cycles where it holds the value.
    """
    expr = None
    for src, cycles in sources.items():
        cond = F.col(cycle_col).isin(list(cycles))
        expr = F.when(cond, F.col(src)) if expr is None else expr.when(cond, F.col(src))
    return df.withColumn(target, expr)


def combine_measures(df: DataFrame, sources: Sequence[str], target: str,
                     fill_mean: bool = False) -> DataFrame:
    """Mean of repeated measures (NULLs skipped); optional mean post-fill."""
    out = df.withColumn(target, row_mean(sources))
    if fill_mean:
        out = MeanImputer([target]).fit(out).transform(out)
    return out


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """rename columns."""
    return df.withColumnsRenamed(dict(mapping))


def yes_no_recode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """questionnaire 1/2 codes to 1/0, other codes to NULL."""
    targets = set(cols)
    return df.select(*[yes_no(c).alias(c) if c in targets else F.col(c) for c in df.columns])
