"""Train/test process (X6) and the run of one labeller."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators import clean, evaluate, profile, splits
from riskframe.plans.grid import Chain, FittedChain, config_table, fit_chains, grid_search, top_configs
from riskframe.session import cut_lineage, shared_path
from riskframe.sources.io import Timer


@dataclass
class Trained:
    """What a train/test process leaves: the best chain, its ordinal, all score rows, and the two splits."""

    config: int
    model: FittedChain
    scores: DataFrame  # config, split, metrics, counts, pipeline, steps, params
    cv: DataFrame  # config, fold, metrics, counts
    train: DataFrame
    test: DataFrame


def train_test_process(df: DataFrame, configs: Sequence[Chain], features: Sequence[str], key: Sequence[str],
                       label: str = "label", test_size: float = 0.2, folds: int = 10, top: int = 5,
                       select_on: str = "test_f1", seed: int = 42) -> Trained:
    """Stratified split, grid search on the train part, refit of the ``top`` configs of each pipeline by mean f1.

    ``select_on`` is "<split>_<metric>": the refit whose score is highest is
    returned as the model (first config on ties).
    """
    split, metric = select_on.split("_", 1)
    flagged = cut_lineage(splits.split_stratified(df, key, label, test_size, seed))
    train, test = splits.train_test(flagged)
    cv = grid_search(train, configs, features, key, label, folds, seed)
    chosen = top_configs(cv, configs, "f1", top)
    fitted = fit_chains(configs, chosen, train, features, key, label, seed)
    parts = None
    for c, chain in fitted.items():
        for name, rows in (("train", train), ("test", test)):
            one = chain.transform(rows).select(F.lit(c).alias("config"), F.lit(name).alias("split"),
                                               F.col(label).alias("label"), "pred")
            parts = one if parts is None else parts.unionByName(one)
    scores = cut_lineage(evaluate.evaluate_models(parts, ["config", "split"]).join(
        config_table(df.sparkSession, configs), "config"))
    best = scores.where(F.col("split") == split).orderBy(F.col(metric).desc(), "config").first().config
    return Trained(best, fitted[best], scores, cv, train, test)


def run_labeller(df: DataFrame, name: str, label: Column, features: Sequence[str], key: Sequence[str],
                 configs: Sequence[Chain], cohort: Column | None = None, leaks: Sequence[str] = (),
                 folds: int = 10, top: int = 5, select_on: str = "test_f1", seed: int = 42) -> dict[str, str]:
    """Label, describe, counts, types, correlation, split, train, write, elapsed time.

    Rows outside ``cohort`` and the ``leaks`` columns take no part.  Every table
    is written as Parquet under the shared folder; returns table name -> path.
    """
    features = [f for f in features if f not in set(leaks)]
    with Timer(df.sparkSession, name) as timer:
        rows = df if cohort is None else df.where(F.coalesce(cohort, F.lit(False)))
        rows = rows.select(*key, *features, F.coalesce(label, F.lit(False)).cast("int").alias("label"))
        rows = cut_lineage(rows)
        filled = clean.MeanImputer(features).fit(rows).transform(rows)
        kept = [f for f in features if f in filled.columns]
        done = train_test_process(rows, configs, features, key, "label", folds=folds, top=top, select_on=select_on,
                                  seed=seed)
        types = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in rows.schema],
                                                "column string, type string")
        tables = {"describe": profile.describe(rows, features), "label_counts": profile.value_counts(rows, "label"),
                  "types": types, "correlation": profile.sort_by_value(profile.correlation(filled, kept, "label")),
                  "cv": done.cv, "scores": done.scores}
        base = shared_path(df.sparkSession, f"labeller-{name}")
        paths = {k: f"{base}/{k}" for k in [*tables, "elapsed"]}
        for k, t in tables.items():
            t.write.parquet(paths[k])
    timer.table().write.parquet(paths["elapsed"])
    return paths
