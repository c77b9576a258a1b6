"""Model chains and grid search.

A chain is drop -> impute -> scale -> select -> [cluster under-sampling] ->
[sampler] -> model, so that its four shapes are those with and without either
resampling step.  Every step is fitted on the training rows only; resamplers
run in ``fit`` and never at prediction time.  The grid is fitted as a tree: every distinct
prefix (per fold) is fitted once, its output kept and shared by all
configs below it, and persisted rows are released when the fold is done.  Folds run side by
side; a fold's predictions are scored by one aggregation.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from functools import reduce
from typing import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from riskframe.operators import clean, cluster, evaluate, resample, scale, select, splits
from riskframe.operators.models import Classifier
from riskframe.operators.profile import feature_stats
from riskframe.session import cut_lineage

# ---- step factories: (features) -> Estimator; resamplers: (df, key, label, features) -> df

STEP_KINDS = ("drop", "impute", "scale", "select", "cluster", "sampler", "model")
#: Steps before the model; the first three can be fitted from one statistics pass.
DEPTH, FUSED = len(STEP_KINDS) - 1, 3


def _features_after(model, feats: list[str]) -> list[str]:
    if isinstance(model, clean.ColumnDropModel):
        return [f for f in feats if f in model.kept]
    if isinstance(model, clean.ImputerModel):
        return [f for f in feats if f not in model.dropped]
    if isinstance(model, select.SelectedModel):
        return [f for f in feats if f in model.selected]
    return feats


def _vec_sampler(fn):
    """Adapt a vector resampler to feature columns."""
    def run(df: DataFrame, key, label, feats):
        v = df.select(*key, label, F.array(*[F.col(f).cast("double") for f in feats]).alias("__vec"))
        out = fn(v, key, label, "__vec")
        keys = [c for c in out.columns if c not in (label, "__vec") and c in [*key, "copy"]]
        return out.select(*keys, label, *[F.col("__vec")[i].alias(f) for i, f in enumerate(feats)])
    return run


def _centroid_sampler(df: DataFrame, key, label, feats) -> DataFrame:
    """R3 with keys: centres get new ones, below all row numbers (or of their own kind, for text keys)."""
    maj, n_maj, mino, n_min = resample.roles(df, label)
    if n_min >= n_maj or n_min == 0:
        return df.select(*key, label, *feats)
    doubles = [F.col(f).cast("double").alias(f) for f in feats]
    cent = cluster.centroids(df.where(F.col(label) == maj).select(*doubles), feats, n_min)
    own = [(F.concat(F.lit("centre "), F.col("cid").cast("string")) if isinstance(df.schema[c].dataType, StringType)
            else (-F.col("cid") - 1).cast(df.schema[c].dataType)).alias(c) for c in key]
    return df.where(F.col(label) == mino).select(*key, label, *doubles).unionByName(
        cent.select(*own, F.lit(maj).cast(df.schema[label].dataType).alias(label), *feats))


def _cluster_step(step: tuple, df: DataFrame, key, label, feats) -> DataFrame:
    """R7 as a step: (k, pick, method)."""
    k, pick, method = step
    return cluster.under_cluster_guided(df, key, feats, label, k, pick, method=method)[0].select(*df.columns)


SAMPLERS: dict[str, Callable] = {
    "none": lambda df, key, label, feats: df,
    "under_random": lambda df, key, label, feats: resample.under_random(df, key, label),
    "under_centroids": _centroid_sampler,
    "over_random": lambda df, key, label, feats: resample.over_random(df, key, label).drop("copy"),
    "smote": _vec_sampler(lambda v, key, label, vec: resample.smote_union(v, key, label, vec)),
    "smote_enn": _vec_sampler(lambda v, key, label, vec: resample.smote_enn(v, key, label, vec)),
    "smote_tomek": _vec_sampler(lambda v, key, label, vec: resample.smote_tomek(v, key, label, vec)),
}

SCALERS = {"minmax": scale.MinMaxScaler, "standard": scale.StandardScaler, "robust": scale.RobustScaler}
SELECTORS = {"percentile": lambda f, label: select.SelectPercentile(f, label, 10.0),
             "l1": lambda f, label: select.SelectFromL1(f, label, 0.01),
             "all": None}


@dataclass
class Chain:
    """One configuration of the chain."""

    drop: float | None = 0.5
    impute: bool = True
    scaler: str | None = "minmax"
    selector: str = "all"
    sampler: str = "none"
    model: str = "logistic"
    model_params: dict = field(default_factory=dict)
    cluster: tuple | None = None  # (k, pick, method) of the cluster under-sampling step
    pipeline: str = "chain"

    def prefix(self, depth: int) -> tuple:
        return (self.drop, self.impute, self.scaler, self.selector, self.cluster, self.sampler, self.model)[:depth]

    def steps(self) -> list[tuple[str, str]]:
        """Names and values of the steps that do something, in order."""
        shown = [("drop", self.drop), ("impute", "mean" if self.impute else None), ("scale", self.scaler),
                 ("select", self.selector if SELECTORS.get(self.selector) else None),
                 ("cluster", self.cluster and "k={} pick={} method={}".format(*self.cluster)),
                 ("sampler", self.sampler if self.sampler != "none" else None), ("model", self.model)]
        return [(n, str(v)) for n, v in shown if v is not None]


@dataclass
class FittedChain:
    steps: list
    features: list[str]
    model: object

    def transform(self, df: DataFrame) -> DataFrame:
        for m in self.steps:
            df = m.transform(df)
        return self.model.transform(df)


def _fit_prefix_step(depth: int, cfg: Chain, df: DataFrame, feats: list[str], key, label):
    """Fit step ``depth`` (0-based) of ``cfg``; return (fitted model or None, new df, new feats)."""
    if depth == 0 and cfg.drop is not None:
        m = clean.DropSparse(feats, cfg.drop).fit(df)
    elif depth == 1 and cfg.impute:
        m = clean.MeanImputer(feats).fit(df)
    elif depth == 2 and cfg.scaler:
        m = SCALERS[cfg.scaler](feats).fit(df)
    elif depth == 3 and SELECTORS.get(cfg.selector):
        m = SELECTORS[cfg.selector](feats, label).fit(df)
    elif depth == 4 and cfg.cluster:
        return None, _cluster_step(cfg.cluster, df, key, label, feats), feats
    elif depth == 5 and cfg.sampler != "none":
        return None, SAMPLERS[cfg.sampler](df, key, label, feats), feats
    else:
        return None, df, feats
    return m, m.transform(df), _features_after(m, feats)


def fused_front(cfg: Chain, stats: dict, feats: list[str]):
    """Drop -> mean impute -> min-max/standard scale fitted from one statistics pass
    on the raw rows (imputing with the mean keeps min, max and mean, and scales the
    population std by sqrt(count / rows)).  Returns fitted models and features, or
    None when the chain's front cannot be fused."""
    if not cfg.impute or cfg.scaler not in (None, "minmax", "standard"):
        return None
    models_, cur = [], list(feats)
    if cfg.drop is not None:
        kept = [f for f in cur if stats[f]["count"] >= stats[f]["rows"] * cfg.drop]
        models_.append(clean.ColumnDropModel(kept=kept, dropped=[f for f in cur if f not in kept]))
        cur = kept
    fills = {f: float(stats[f]["mean"]) for f in cur if stats[f]["count"] > 0}
    dropped = [f for f in cur if stats[f]["count"] == 0]
    models_.append(clean.ImputerModel(fills=fills, dropped=dropped))
    cur = [f for f in cur if f not in dropped]
    if cfg.scaler == "minmax":
        aff = {}
        for f in cur:
            lo, hi = stats[f]["min"], stats[f]["max"]
            aff[f] = (lo, (hi - lo) if hi != lo else 1.0)
        models_.append(scale.AffineModel(aff))
    elif cfg.scaler == "standard":
        aff = {}
        for f in cur:
            sd = (stats[f]["std_pop"] or 0.0) * (stats[f]["count"] / stats[f]["rows"]) ** 0.5
            aff[f] = (stats[f]["mean"], sd if sd != 0 else 1.0)
        models_.append(scale.AffineModel(aff))
    return models_, cur


def fit_chain(cfg: Chain, train: DataFrame, features: Sequence[str], key: Sequence[str],
              label: str = "label", seed: int = 42) -> FittedChain:
    """Fit every step on ``train`` (resampling only here)."""
    df, feats, fitted = train, list(features), []
    for depth in range(DEPTH):
        m, after, feats = _fit_prefix_step(depth, cfg, df, feats, list(key), label)
        if m is not None:
            fitted.append(m)
        elif after is not df:
            after = cut_lineage(after)  # resampled rows: the steps below read them several times
        df = after
    model = Classifier(cfg.model, feats, label, key, seed, **cfg.model_params).fit(df)
    return FittedChain(fitted, feats, model)


def fit_chains(configs: Sequence[Chain], ordinals: Sequence[int], train: DataFrame, features: Sequence[str],
               key: Sequence[str], label: str = "label", seed: int = 42, parallelism: int = 8) -> dict[int, FittedChain]:
    """Config ordinal -> chain fitted on ``train``; the fits are independent jobs, submitted side by side."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return dict(zip(ordinals, pool.map(lambda c: fit_chain(configs[c], train, features, key, label, seed), ordinals)))


def grid_configs(options: dict[str, Sequence], pipeline: str = "chain") -> list[Chain]:
    """Cartesian expansion of step options (driver-side: bounded by the grid)."""
    names = list(options)
    return [Chain(**dict(zip(names, combo)), pipeline=pipeline)
            for combo in itertools.product(*[options[n] for n in names])]


#: Options of the study's grids.
SCALER_OPTIONS, MODEL_OPTIONS = ("minmax", "standard"), ("logistic", "forest", "svc", "knn", "mlp")
SAMPLER_OPTIONS = ("under_random", "under_centroids", "over_random", "smote", "smote_enn", "smote_tomek")
CLUSTER_OPTIONS = tuple((k, pick, method) for k in (2, 3, 4) for method in ("kmeans", "medoids")
                        for pick in ("highest", "lowest", "mean", "median"))


def study_grid(selectors: Sequence[str] = ("percentile", "l1")) -> list[Chain]:
    """The sampling pipeline with two selectors: 120 configs."""
    return grid_configs({"scaler": SCALER_OPTIONS, "selector": selectors, "sampler": SAMPLER_OPTIONS,
                         "model": MODEL_OPTIONS}, "normal")


def shape_grid() -> list[Chain]:
    """The four chain shapes: 10 + 60 + 240 + 1,440 = 1,750 configs."""
    base = {"scaler": SCALER_OPTIONS, "model": MODEL_OPTIONS, "drop": (None,)}
    sampled, guided = {"sampler": SAMPLER_OPTIONS}, {"cluster": CLUSTER_OPTIONS}
    return (grid_configs(base, "noSampling") + grid_configs(base | sampled, "withSampling")
            + grid_configs(base | guided, "kus") + grid_configs(base | guided | sampled, "kusWithSampling"))


def config_table(spark: SparkSession, configs: Sequence[Chain]) -> DataFrame:
    """(config, pipeline, steps, params) of every config; ``params`` maps a step or model parameter to its value."""
    rows = [(i, c.pipeline, [n for n, _ in c.steps()],
             {**dict(c.steps()), **{f"model.{k}": str(v) for k, v in c.model_params.items()}})
            for i, c in enumerate(configs)]
    return spark.createDataFrame(rows, "config int, pipeline string, steps array<string>, params map<string,string>")


def grid_search(df: DataFrame, configs: Sequence[Chain], features: Sequence[str], key: Sequence[str],
                label: str = "label", folds: int = 3, seed: int = 42, parallelism: int = 8) -> DataFrame:
    """K-fold scores of every config: (config, fold, metrics..., tn, fp, fn, tp, train_<metric>...).

    A fold's chains are scored on its validation rows and on its training rows
    (as they came, not resampled), all by one aggregation.

    Prefixes are shared: a fold fits each distinct prefix once; scaled rows are
    persisted, resampled ones written.  Folds, and the model fits below the prefixes, are independent
    jobs submitted from driver threads, ``parallelism`` fits at a time (each fit
    is itself distributed).  A fold's scores go to the shared checkpoint folder
    before its prefixes are released.
    """
    from concurrent.futures import ThreadPoolExecutor

    key, features = list(key), list(features)
    # written once: the plans below it start at these rows, however long the history of ``df``
    f = cut_lineage(splits.folds_stratified(df, key, label, folds, seed))
    cfgs = list(enumerate(configs))
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as fits, ThreadPoolExecutor(max_workers=folds) as pool:
        results = list(pool.map(lambda fold: _score_fold(f, fold, cfgs, features, key, label, seed, fits),
                                range(folds)))
    return reduce(lambda a, b: a.unionByName(b), results)


def _score_fold(f: DataFrame, fold: int, cfgs, features: list[str], key: list[str], label: str, seed: int, pool):
    """Scores of all configs on one fold; its persisted prefixes are released at the end."""
    train = f.where(F.col("fold") != fold).drop("fold")
    val = f.where(F.col("fold") == fold).drop("fold")
    cache: dict[tuple, tuple] = {(): ([], train, features)}
    held = []
    # one statistics pass fits drop -> impute -> scale for every fusable chain
    stats = None
    for _, cfg in cfgs:
        if cfg.prefix(FUSED) in cache:
            continue
        if stats is None:
            stats = {r.feature: r.asDict() for r in feature_stats(train, features).collect()}
        fused = fused_front(cfg, stats, features)
        if fused is None:
            continue
        models_, feats3 = fused
        d3 = train
        for m in models_:
            d3 = m.transform(d3)
        d3 = d3.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(d3)
        cache[cfg.prefix(FUSED)] = (models_, d3, feats3)
    for _, cfg in cfgs:
        for depth in range(1, DEPTH + 1):
            pre = cfg.prefix(depth)
            if pre in cache or (depth < FUSED and cfg.prefix(FUSED) in cache):
                continue
            steps, d, feats = cache[cfg.prefix(depth - 1)]
            m, d2, feats2 = _fit_prefix_step(depth - 1, cfg, d, feats, key, label)
            if d2 is not d and depth > FUSED + 1:  # resampled rows are written; what is selected is read off the rest
                d2 = cut_lineage(d2)
            cache[pre] = (steps + ([m] if m is not None else []), d2, feats2)

    def fit_one(item):
        ordinal, cfg = item
        steps, d, feats = cache[cfg.prefix(DEPTH)]
        model = Classifier(cfg.model, feats, label, key, seed, **cfg.model_params).fit(d)
        chain = FittedChain(steps, feats, model)
        return [chain.transform(rows).select(F.lit(ordinal).alias("config"), F.lit(fold).alias("fold"),
                                             F.lit(part).alias("part"), F.col(label).alias("label"), "pred")
                for part, rows in (("val", val), ("train", train))]

    preds = [p for pair in pool.map(fit_one, cfgs) for p in pair]
    scored = evaluate.evaluate_models(reduce(lambda a, b: a.unionByName(b), preds), ["config", "fold", "part"])
    of = lambda part, c, name: F.max(F.when(F.col("part") == part, F.col(c))).alias(name)
    scores = cut_lineage(scored.groupBy("config", "fold").agg(
        *[of("val", c, c) for c in (*evaluate.METRICS, "tn", "fp", "fn", "tp")],
        *[of("train", c, f"train_{c}") for c in evaluate.METRICS]))
    for d in held:
        d.unpersist()
    return scores


def top_configs(cv: DataFrame, configs: Sequence[Chain], metric: str = "f1", top: int = 5) -> list[int]:
    """The ``top`` configs of each pipeline by mean score (first config on ties)."""
    summary = evaluate.cv_summary(cv, ["config"], [metric], metric).join(
        config_table(cv.sparkSession, configs).select("config", "pipeline"), "config")
    order = Window.partitionBy("pipeline").orderBy(F.col(f"mean_{metric}").desc(), "config")  # rows: configs
    best = summary.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= top)
    return [r.config for r in best.orderBy("pipeline", "__r").select("config").collect()]


def refit_top(df_train: DataFrame, df_test: DataFrame, configs: Sequence[Chain], cv: DataFrame, features,
              key, label: str = "label", top: int = 5, seed: int = 42) -> DataFrame:
    """Refit the ``top`` configs of each pipeline by mean f1 on the whole train set.

    Returns a score row per config and split: config, split, metrics, counts, pipeline, steps, params.
    """
    df_train, df_test = cut_lineage(df_train), cut_lineage(df_test)  # every refit and score reads them
    fitted = fit_chains(configs, top_configs(cv, configs, "f1", top), df_train, features, key, label, seed)
    parts = [chain.transform(d).select(F.lit(ordinal).alias("config"), F.lit(name).alias("split"),
                                       F.col(label).alias("label"), "pred")
             for ordinal, chain in fitted.items() for name, d in (("train", df_train), ("test", df_test))]
    scores = evaluate.evaluate_models(reduce(lambda a, b: a.unionByName(b), parts), ["config", "split"])
    return scores.join(config_table(df_train.sparkSession, configs), "config")
