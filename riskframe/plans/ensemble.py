"""Risk ensemble (X8) and study profile runs.

Risk ensemble: hold out a fraction of the people, fit one model per labeller
on the rest, let every model vote on the hold-out, sum the votes per person
and cross-tabulate the vote count against each true outcome.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators import evaluate, profile, splits
from riskframe.session import cut_lineage


@dataclass
class ThresholdRule:
    """A one-feature model: predict positive when ``score > threshold``.

    The threshold is the candidate with the best f1 on the labelled training
    rows (first candidate on ties).
    """

    score: Column
    candidates: Sequence[float]
    threshold: float | None = None

    def predict(self) -> Column:
        return F.coalesce(self.score > F.lit(self.threshold), F.lit(False)).cast("int")


@dataclass
class Labeller:
    """A label set as expressions: rows where ``cohort`` holds get ``label``."""

    name: str
    label: Column
    model: ThresholdRule
    cohort: Column | None = None


def fit_labellers(core: DataFrame, labellers: Sequence[Labeller]) -> None:
    """Fit every labeller's threshold in one pass over ``core``.

    Each row emits one (labeller, label, score) entry per labeller whose cohort
    it belongs to; scores are bucketed against the sorted candidates and counted,
    and ``max_by`` picks each labeller's best.
    Only the chosen thresholds (one number per labeller) reach the driver.
    """
    entries = F.array(*[F.struct(F.lit(i).alias("lab"),
                                 (lab.cohort if lab.cohort is not None else F.lit(True)).alias("inc"),
                                 lab.label.cast("int").alias("label"),
                                 lab.model.score.cast("double").alias("s"))
                        for i, lab in enumerate(labellers)])
    per = core.select(F.explode(entries).alias("e")).where(F.coalesce(F.col("e.inc"), F.lit(False))) \
        .select("e.lab", "e.label", "e.s")
    cand = None
    for i, lab in enumerate(labellers):
        arr = F.array(*[F.lit(float(t)) for t in lab.model.candidates])
        cand = F.when(F.col("lab") == i, arr) if cand is None else cand.when(F.col("lab") == i, arr)
    cm = evaluate.threshold_counts(per, "lab", "s", "label", cand)
    scores = cm.select("lab", F.col("place").alias("ordinal"), "threshold", *evaluate.metric_columns())
    best = evaluate.best_per_group(scores, ["lab"], "f1", "ordinal").select("lab", "threshold").collect()
    chosen = {r.lab: float(r.threshold) for r in best}
    for i, lab in enumerate(labellers):
        lab.model.threshold = chosen[i]


def risk_ensemble(df: DataFrame, key: Sequence[str], labellers: Sequence[Labeller],
                  risks: dict[str, Column], holdout: float = 0.1, seed: int = 42) -> DataFrame:
    """(risk_name, score, risk, total) over the hold-out rows.

    Two passes over the data after the split: one fits every labeller, one
    scores, sums and cross-tabulates the hold-out (the fitted models are a
    handful of numbers, folded in as literals).
    """
    flagged = splits.split_holdout(df, key, holdout, seed)
    core = flagged.where(F.col("is_holdout") == 0).drop("is_holdout")
    hold = flagged.where(F.col("is_holdout") == 1).drop("is_holdout")
    fit_labellers(core, labellers)
    votes = reduce(lambda a, b: a + b, [lab.model.predict() for lab in labellers])
    outcomes = F.array(*[F.struct(F.lit(n).alias("risk_name"), c.cast("int").alias("risk"))
                         for n, c in risks.items()])
    scored = hold.select(votes.alias("score"), F.explode(outcomes).alias("o")) \
        .select("o.risk_name", "score", "o.risk")
    return evaluate.risk_table(scored, "score", "risk", ["risk_name"])


def model_ensemble(df: DataFrame, key: Sequence[str], fits: dict[str, Callable[[DataFrame], object]],
                   risks: dict[str, Column], holdout: float = 0.1, seed: int = 42) -> DataFrame:
    """X8 with fitted models: (risk_name, score, risk, total) over the hold-out rows.

    ``fits`` maps a labeller to a function that labels and fits the core rows
    and returns anything with ``transform`` that adds ``pred`` (a fitted chain,
    the model of a train/test process).  Every model sees the hold-out rows as
    they are; votes are summed per key (a NULL vote counts as none).
    """
    key = list(key)
    flagged = cut_lineage(splits.split_holdout(df, key, holdout, seed))
    core, hold = splits.train_test(flagged, "is_holdout")
    votes = None
    for fit in fits.values():
        one = fit(core).transform(hold).select(*key, F.coalesce(F.col("pred").cast("int"), F.lit(0)).alias("vote"))
        votes = one if votes is None else votes.unionByName(one)
    score = votes.groupBy(*key).agg(F.sum("vote").cast("int").alias("score"))
    outcomes = F.array(*[F.struct(F.lit(n).alias("risk_name"), c.cast("int").alias("risk"))
                         for n, c in risks.items()])
    scored = hold.withColumn("__o", outcomes).select(*key, "__o").join(score, key)
    scored = scored.select("score", F.explode("__o").alias("o")).select("o.risk_name", "score", "o.risk")
    return evaluate.risk_table(scored, "score", "risk", ["risk_name"])


@dataclass
class Study:
    """One study run: label, the rows that take part, and the columns that would leak its label.

    ``cohort`` may be any row condition, e.g. "inside the class's IQR fences".
    """

    label: Column
    cohort: Column | None = None
    leaks: Sequence[str] = ()


def study_correlation(df: DataFrame, labellers: dict[str, Column | tuple[Column, Column] | Study],
                      features: Sequence[str], q: float = 0.9) -> DataFrame:
    """Per labeller: label -> mean impute (empty kept as 0) -> |corr| -> top-decile flag.

    ``labellers`` maps a name to a label expression, to (label, cohort), or to
    a :class:`Study` with its own leak columns, which get no row and no part in
    its decile.  All labellers are scored in one pass: each row is emitted once
    per labeller whose cohort it belongs to, and the correlation after mean
    imputation is derived from one grouped aggregation (no imputation pass).
    The top-decile window runs per labeller over its per-feature table
    (bounded).  Output (labeller, feature, value, top).
    """
    entries, leaks = [], F.lit(False)
    for name, spec in labellers.items():
        if not isinstance(spec, Study):
            spec = Study(*spec) if isinstance(spec, tuple) else Study(spec)
        entries.append(F.struct(F.lit(name).alias("labeller"),
                                (spec.cohort if spec.cohort is not None else F.lit(True)).alias("inc"),
                                spec.label.cast("int").alias("y")))
        if spec.leaks:
            leaks = leaks | ((F.col("labeller") == name) & F.col("feature").isin(list(spec.leaks)))
    rows = df.select(*features, F.explode(F.array(*entries)).alias("__e")) \
        .where(F.coalesce(F.col("__e.inc"), F.lit(False))) \
        .select(F.col("__e.labeller").alias("labeller"), F.col("__e.y").alias("label"), *features)
    corr = profile.correlation_mean_imputed(rows, list(features), "label", ["labeller"]).where(~leaks)
    return profile.flag_top_fraction(corr, q, group_cols=["labeller"]).select("labeller", "feature", "value", "top")
