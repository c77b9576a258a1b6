"""Evaluation (A6, A9-A19, X5): confusion counts, metrics, curves, pickers.

All models are scored from one long table ``(model..., key, label, pred)``
with one grouped aggregation (partial aggregation makes hot models cheap).
Pickers use ``max_by`` over a struct instead of windows, so a group holding a
third of all rows never has to be sorted in one task.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["precision", "recall", "f1", "accuracy", "auc_roc"]


def confusion(df: DataFrame, label: str = "label", pred: str = "pred",
              group_cols: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(group..., tn, fp, fn, tp) by conditional sums (``weight``: rows per input row).

    Every row is counted once: a NULL prediction is a negative one.  A NULL
    label has no cell to go to, and is an error.
    """
    y = F.when(F.col(label).isNull(), F.raise_error(F.lit("confusion: NULL label")).cast("boolean")) \
        .otherwise(F.col(label) == 1)
    p = F.coalesce(F.col(pred) == 1, F.lit(False))
    if weight is None:
        cnt = lambda c: F.count(F.when(c, F.lit(1)))
    else:
        cnt = lambda c: F.coalesce(F.sum(F.when(c, F.col(weight))), F.lit(0)).cast("bigint")
    return df.groupBy(*group_cols).agg(cnt(~y & ~p).alias("tn"), cnt(~y & p).alias("fp"),
                                       cnt(y & ~p).alias("fn"), cnt(y & p).alias("tp"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def metric_columns() -> list[Column]:
    """A10: precision, recall, f1 (zero division -> 0), accuracy and auc_roc.

    ``auc_roc`` is computed from hard predictions, i.e. (TPR + TNR) / 2.
    """
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    precision = _safe_div(tp, tp + fp)
    recall = _safe_div(tp, tp + fn)
    f1 = _safe_div(2 * tp, 2 * tp + fp + fn)
    accuracy = _safe_div(tp + tn, tp + tn + fp + fn)
    tnr = _safe_div(tn, tn + fp)
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
            accuracy.alias("accuracy"), ((recall + tnr) / 2).alias("auc_roc")]


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                           group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., precision, recall, f1, accuracy, auc_roc, tn, fp, fn, tp)."""
    cm = confusion(df, label, pred, group_cols)
    return cm.select(*group_cols, *metric_columns(), "tn", "fp", "fn", "tp")


def evaluate_models(long_preds: DataFrame, model_cols: Sequence[str], label: str = "label",
                    pred: str = "pred", weight: str | None = None) -> DataFrame:
    """Every model's score row from one long prediction table."""
    cm = confusion(long_preds, label, pred, model_cols, weight)
    return cm.select(*model_cols, *metric_columns(), "tn", "fp", "fn", "tp")


def threshold_counts(df: DataFrame, model: str, score: str, label: str, thresholds: Column | Sequence[float],
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., model, place, tn, fp, fn, tp) of the rules ``score > threshold``.

    ``thresholds`` are numbers, or an array column, the same for all rows of a
    model.  Each row is bucketed once, by how many of the sorted thresholds lie below its
    score, and counted: at most 2 (thresholds + 1) counts per model, whatever
    the scores.  The cells of a threshold are sums over the buckets beyond it,
    so neither rows nor scores are multiplied by thresholds.  A NULL score is
    below every threshold; a NULL label is an error.
    """
    keys = [*group_cols, model]
    y = F.when(F.col(label).isNull(), F.raise_error(F.lit("threshold_counts: NULL label")).cast("int")) \
        .otherwise((F.col(label) == 1).cast("int"))
    if isinstance(thresholds, Column):
        below = F.coalesce(F.size(F.filter(F.array_sort(thresholds), lambda t: F.col(score) > t)), F.lit(0))
        hist = df.select(*keys, y.alias("__y"), F.when(F.col(score).isNull(), 0).otherwise(below).alias("__b"),
                         thresholds.alias("__ts")).groupBy(*keys, "__y", "__b", "__ts").agg(
            F.count(F.lit(1)).alias("__n"))
    else:  # literals: the bucket is compiled, and the thresholds join the few counts afterwards
        cuts = [float(t) for t in thresholds]
        above = reduce(lambda a, b: a + b, [(F.col(score) > F.lit(t)).cast("int") for t in cuts], F.lit(0))
        hist = df.select(*keys, y.alias("__y"), F.coalesce(above, F.lit(0)).alias("__b")).groupBy(
            *keys, "__y", "__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__ts", F.array(*map(F.lit, cuts)))
    per = hist.groupBy(*keys, "__ts").agg(F.collect_list(F.struct("__y", "__b", "__n")).alias("__h"))
    cells = per.select(*keys, "__h", F.array_sort("__ts").alias("__cuts"), F.posexplode("__ts").alias("place", "threshold"))
    rank = F.size(F.filter("__cuts", lambda t: t < F.col("threshold")))  # buckets 0..rank are not above it

    def total(label_value: int, above: bool) -> Column:
        return F.aggregate("__h", F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(
            (x["__y"] == label_value) & ((x["__b"] > rank) if above else (x["__b"] <= rank)), x["__n"]).otherwise(0))
    return cells.select(*keys, "place", "threshold", total(0, False).alias("tn"), total(0, True).alias("fp"),
                        total(1, False).alias("fn"), total(1, True).alias("tp"))


def threshold_grid(df: DataFrame, scorers: Sequence[tuple[str, Column]], thresholds: Sequence[float],
                   label: str = "label", group_cols: Sequence[str] = ()) -> DataFrame:
    """X5 for rule models ``score > threshold``: scores of every (scorer, threshold).

    See :func:`threshold_counts`.  Ordinal of a config = scorer index x stride +
    threshold index, where the stride is 100 or, if larger, the number of thresholds.
    """
    gc, stride = list(group_cols), max(100, len(thresholds))
    arr = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(i).alias("__m"), c.cast("double").alias("score"))
                    for i, (n, c) in enumerate(scorers)])
    long = df.select(*gc, F.col(label).alias("__label"), F.explode(arr).alias("__s")).select(*gc, "__label", "__s.*")
    cm = threshold_counts(long, "model", "score", "__label", thresholds, [*gc, "__m"])
    return cm.select(*gc, "model", (F.col("__m") * stride + F.col("place")).alias("ordinal"), "threshold",
                     *metric_columns(), "tn", "fp", "fn", "tp")


# ---------------------------------------------------------------- curves

def _score_counts(df: DataFrame, label: str, score: str, group_cols: Sequence[str]) -> DataFrame:
    y = F.col(label) == 1
    return df.where(F.col(score).isNotNull()).groupBy(*group_cols, F.col(score).alias("threshold")).agg(
        F.count(F.when(y, F.lit(1))).alias("pos"), F.count(F.when(~y, F.lit(1))).alias("neg"))


def cumulative_by_threshold(df: DataFrame, label: str = "label", score: str = "score",
                            group_cols: Sequence[str] = (), buckets: int = 0) -> DataFrame:
    """Per distinct score (descending): tp / fp = positives / negatives scoring >= it.

    Distinct scores are range-bucketed (approximate quantile edges of the raw
    scores, one sketch pass, + Bucketizer);
    per-bucket totals form a table of at most groups x buckets rows whose
    suffix sums give each bucket's offset; rows are ordered only inside a bucket.
    Adds ``P`` / ``N`` (class totals of the group).
    """
    gc = list(group_cols)
    counts = _score_counts(df, label, score, gc)
    # one sketch pass over the raw scores: row count and fine quantile edges
    # (edges only balance the buckets; correctness does not depend on them)
    fine = max(buckets, 4096)
    probs = [i / fine for i in range(1, fine)]
    row = df.agg(F.count(score).alias("n"), F.percentile_approx(score, probs, 4 * fine).alias("e")).collect()[0]
    edges = list(row["e"] or [])
    if buckets <= 0:
        # about 200k rows per bucket, 16 to 4096 buckets
        buckets = int(min(fine, max(16, (row["n"] or 0) // 200_000)))
    step = max(1, len(edges) // buckets)
    edges = sorted(set(float(x) for x in edges[step - 1::step]))
    splits = [float("-inf"), *edges, float("inf")]
    bz = Bucketizer(splits=splits, inputCol="threshold", outputCol="__b", handleInvalid="keep")
    b = bz.transform(counts).withColumn("__b", F.col("__b").cast("int"))
    tot = b.groupBy(*gc, "__b").agg(F.sum("pos").alias("__bp"), F.sum("neg").alias("__bn"))
    w_after = (Window.partitionBy(*gc) if gc else Window).orderBy(F.col("__b").desc())
    offs = tot.select(
        *gc, "__b",
        F.coalesce(F.sum("__bp").over(w_after.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__op"),
        F.coalesce(F.sum("__bn").over(w_after.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__on"),
        F.sum("__bp").over(w_after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("P"),
        F.sum("__bn").over(w_after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("N"))
    j = b.join(offs, on=[*gc, "__b"], how="inner")
    w_in = Window.partitionBy(*gc, "__b").orderBy(F.col("threshold").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    return j.select(*gc, "threshold", "pos", "neg", "P", "N",
                    (F.col("__op") + F.sum("pos").over(w_in)).alias("tp"),
                    (F.col("__on") + F.sum("neg").over(w_in)).alias("fp"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score",
             group_cols: Sequence[str] = ()) -> DataFrame:
    """(threshold, tp, fp, precision, recall), predicting positive when score >= threshold."""
    c = cumulative_by_threshold(df, label, score, group_cols)
    return c.select(*group_cols, "threshold", "tp", "fp",
                    _safe_div(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"),
                    _safe_div(F.col("tp").cast("double"), F.col("P")).alias("recall"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score",
              group_cols: Sequence[str] = ()) -> DataFrame:
    """ROC points (threshold, tpr, fpr) plus one area row per group.

    Point rows have ``auc`` NULL; the area row (trapezoid rule from (0, 0))
    has ``threshold``/``tpr``/``fpr`` NULL.  The area is a plain aggregate
    unioned to the points: no join, no global window.
    """
    gc = list(group_cols)
    c = cumulative_by_threshold(df, label, score, gc)
    tpr = _safe_div(F.col("tp").cast("double"), F.col("P"))
    fpr = _safe_div(F.col("fp").cast("double"), F.col("N"))
    prev_tpr = _safe_div((F.col("tp") - F.col("pos")).cast("double"), F.col("P"))
    prev_fpr = _safe_div((F.col("fp") - F.col("neg")).cast("double"), F.col("N"))
    pts = c.select(*gc, "threshold", tpr.alias("tpr"), fpr.alias("fpr"),
                   ((fpr - prev_fpr) * (tpr + prev_tpr) / 2).alias("__area"))
    area = pts.groupBy(*gc).agg(F.sum("__area").alias("auc")).select(
        *gc, F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("double").alias("tpr"),
        F.lit(None).cast("double").alias("fpr"), "auc")
    points = pts.select(*gc, "threshold", "tpr", "fpr", F.lit(None).cast("double").alias("auc"))
    return points.unionByName(area)


# ---------------------------------------------------------------- pickers

def best_per_group(df: DataFrame, group_cols: Sequence[str], metric: str, ordinal: str,
                   highest: bool = True) -> DataFrame:
    """The row with the best metric per group, first ordinal on ties (``max_by``)."""
    m = F.col(metric) if highest else -F.col(metric)
    rank_key = F.struct(F.coalesce(m, F.lit(float("-inf"))).alias("m"), (-F.col(ordinal)).alias("o"))
    others = [c for c in df.columns if c not in group_cols]
    best = df.groupBy(*group_cols).agg(F.max_by(F.struct(*others), rank_key).alias("__best"))
    return best.select(*group_cols, *[F.col(f"__best.{c}").alias(c) for c in others])


def argmax_first(df: DataFrame, metric: str, ordinal: str, highest: bool = True) -> DataFrame:
    """Global best row, first ordinal on ties (one partial aggregation)."""
    return best_per_group(df, [], metric, ordinal, highest)


def closest_to_center(df: DataFrame, metric: str, ordinal: str, center: str = "median") -> DataFrame:
    """Row whose metric is closest to the median (or mean), first on ties."""
    c = F.percentile(metric, F.lit(0.5)) if center == "median" else F.avg(metric)
    ref = df.agg(c.alias("c")).collect()[0]["c"]
    d = df.withColumn("__d", F.abs(F.col(metric) - F.lit(ref).cast("double")))
    return argmax_first(d, "__d", ordinal, highest=False).drop("__d")


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], metric: str, ordinal: str, k: int,
                    salts: int = 16) -> DataFrame:
    """Top-k rows per group (metric desc, ordinal asc), skew-safe.

    A first window keeps the top k inside (group, salt) slices, so a hot group
    is cut into ``salts`` parallel sorts; the final window sees k x salts rows
    per group at most.
    """
    gc = list(group_cols)
    order = [F.col(metric).desc_nulls_last(), F.col(ordinal).asc()]
    salted = df.withColumn("__s", F.pmod(F.xxhash64(F.col(ordinal)), F.lit(salts)))
    w1 = Window.partitionBy(*gc, "__s").orderBy(*order)
    local = salted.withColumn("__r", F.row_number().over(w1)).where(F.col("__r") <= k)
    w2 = (Window.partitionBy(*gc) if gc else Window).orderBy(*order)
    return local.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k) \
        .drop("__s", "__r")


def cv_summary(fold_scores: DataFrame, config_cols: Sequence[str], metrics: Sequence[str],
               rank_metric: str) -> DataFrame:
    """Mean / population std of fold scores per config, rank by mean (1 = best).

    The ranking window runs over the config table, bounded by the grid size.
    Means equal to 10 decimals tie: a distributed sum's last bits depend on
    the order partitions arrive in, and a rank must not.
    """
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}")]
    s = fold_scores.groupBy(*config_cols).agg(*aggs)
    w = Window.orderBy(F.round(F.col(f"mean_{rank_metric}"), 10).desc())
    return s.withColumn(f"rank_{rank_metric}", F.rank().over(w))


def risk_score(df: DataFrame, key: Sequence[str], pred_cols: Sequence[str], score_col: str = "score") -> DataFrame:
    """A19 (wide form): number of models voting positive per row."""
    from functools import reduce
    s = reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in pred_cols])
    return df.select(*key, s.alias(score_col))


def risk_score_long(long_preds: DataFrame, key: Sequence[str], pred: str = "pred",
                    score_col: str = "score") -> DataFrame:
    """A19 (long form): ``groupBy(key).sum(pred)`` over (model, key, pred) rows."""
    return long_preds.groupBy(*key).agg(F.sum(F.col(pred).cast("int")).cast("int").alias(score_col))


def risk_table(scored: DataFrame, score: str = "score", risk: str = "risk",
               group_cols: Sequence[str] = ()) -> DataFrame:
    """(score, risk = positives, total = rows) per summed score."""
    return scored.groupBy(*group_cols, score).agg(
        F.sum(F.col(risk).cast("bigint")).alias("risk"), F.count(F.lit(1)).alias("total"))
