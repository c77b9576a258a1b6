"""Label and risk derivations.

A labeller returns one DataFrame ``(key..., features..., label)``: the label
lives in the same row as its features, so nothing is ever aligned by
position.  Rules are data (column, operator, constant); the survey codes are
bound in :mod:`riskframe.plans.presets`.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.rules import Rule, all_of, any_of, decoded_code, flag_count, row_mean
from riskframe.operators.clean import drop_columns
from riskframe.operators.outliers import iqr_removal_by_class


def label_any(df: DataFrame, rules: Sequence[Rule | Column], drop: Sequence[str] = (),
              label_col: str = "label") -> DataFrame:
    """L1/L2: label = any rule holds (missing answers are negatives)."""
    out = df.withColumn(label_col, any_of(rules).cast("int"))
    return drop_columns(out, list(drop)) if drop else out


def label_flag_threshold(df: DataFrame, flags: Sequence[Rule | Column], threshold: int,
                         drop: Sequence[str] = (), label_col: str = "label") -> DataFrame:
    """L3: label = (number of raised flags) > threshold."""
    out = df.withColumn(label_col, (flag_count(flags) > threshold).cast("int"))
    return drop_columns(out, list(drop)) if drop else out


def risk_any(df: DataFrame, rules: Sequence[Rule | Column], key: Sequence[str],
             risk_col: str = "risk") -> DataFrame:
    """K1: outcome only, ``(key..., risk)``."""
    return df.select(*key, any_of(rules).cast("int").alias(risk_col))


def cause_in(code_col: str, causes: Sequence[int], codes: Mapping[int, str], missing_code: int) -> Column:
    """True when the decoded cause is one of ``causes`` (unknown codes fail)."""
    return decoded_code(code_col, codes, missing_code).isin(list(causes))


def risk_cause(df: DataFrame, key: Sequence[str], code_col: str, causes: Sequence[int],
               codes: Mapping[int, str], missing_code: int, risk_col: str = "risk") -> DataFrame:
    """K2: outcome = decoded cause in ``causes`` (no cohort filter)."""
    return df.select(*key, cause_in(code_col, causes, codes, missing_code).cast("int").alias(risk_col))


def label_cause(df: DataFrame, cohort: Sequence[Rule | Column], code_col: str, causes: Sequence[int],
                codes: Mapping[int, str], missing_code: int, drop: Sequence[str] = (),
                label_col: str = "label") -> DataFrame:
    """L4: within the cohort (e.g. linked and dead), label = cause in ``causes``."""
    out = df.where(all_of(cohort)).withColumn(
        label_col, cause_in(code_col, causes, codes, missing_code).cast("int"))
    return drop_columns(out, list(drop)) if drop else out


def risk_flag(df: DataFrame, key: Sequence[str], flag_col: str, risk_col: str = "risk") -> DataFrame:
    """K3: outcome = flag (missing counts as 0) equals 1."""
    return df.select(*key, (F.coalesce(F.col(flag_col), F.lit(0)) == 1).cast("int").alias(risk_col))


def label_contributing(df: DataFrame, cohort: Sequence[Rule | Column], flag_col: str,
                       key: Sequence[str], features: Sequence[str], label_col: str = "label") -> DataFrame:
    """Within the cohort, label = flag with missing -> 0."""
    return df.where(all_of(cohort)).select(
        *key, *features, F.coalesce(F.col(flag_col).cast("double"), F.lit(0.0)).cast("int").alias(label_col))


def label_mean_threshold(df: DataFrame, key: Sequence[str], cycles: Sequence[int], cycle_col: str,
                         measures: Sequence[str], required: Sequence[str], threshold: float,
                         features: Sequence[str], label_col: str = "label",
                         remove_outliers: bool = True) -> DataFrame:
    """Cycles filter, rows with missing measures dropped, label = mean >= threshold,
    fixed feature projection, then IQR outlier removal within each class."""
    cohort = df.where(F.col(cycle_col).isin(list(cycles))).dropna(
        how="any", subset=list(dict.fromkeys([*measures, *required])))
    labelled = cohort.select(*key, *features, (row_mean(measures) >= threshold).cast("int").alias(label_col))
    if not remove_outliers:
        return labelled
    return iqr_removal_by_class(labelled, features, label_col)


def with_all(df: DataFrame, rules: Sequence[Rule | Column]) -> DataFrame:
    return df.where(all_of(rules))
