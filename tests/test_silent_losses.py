"""Rows that must be counted, kept or refused, never lost."""

import pytest
from pyspark.sql import functions as F

from riskframe.operators import evaluate, knn, resample, splits
from riskframe.sources import io


def test_null_labels_stay_in_splits_and_folds(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 5 > 0, (F.col("id") % 2).cast("int")).alias("label"))
    out = splits.split_stratified(df, ["id"], bits=4)
    assert out.count() == 100 and out.where("label is null and is_test = 1").count() == 4
    folds = splits.folds_stratified(df, ["id"], k=4, bits=4)
    assert folds.count() == 100
    assert {r["count"] for r in folds.where("label is null").groupBy("fold").count().collect()} == {5}


def test_null_predictions_count_and_null_labels_fail(spark):
    rows = spark.createDataFrame([(1, None), (0, None), (0, 1)], "label int, pred int")
    c = evaluate.confusion(rows).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (1, 1, 1, 0)
    with pytest.raises(Exception, match="NULL label"):
        evaluate.confusion(spark.createDataFrame([(None, 1)], "label int, pred int")).collect()


def test_vectors_with_holes_are_refused(spark):
    good = spark.createDataFrame([(1, [0.0, 1.0], 0), (2, [1.0, 1.0], 1)], "id long, vec array<double>, label int")
    for bad in ([None, 1.0], [float("nan"), 1.0], None):
        df = good.union(spark.createDataFrame([(3, bad, 0)], good.schema))
        with pytest.raises(Exception, match="neighbour search"):
            knn.knn_join(df, df, 1, ["id"], exclude_self=True).collect()


def test_each_resampled_row_votes_once(spark):
    train = spark.createDataFrame([(1, [0.0], 0), (2, [0.1], 0), (3, [0.2], 0), (4, [0.05], 1), (4, [0.06], 1)],
                                  "id long, vec array<double>, label int")
    test = spark.createDataFrame([(9, [0.0])], "id long, vec array<double>")
    assert knn.knn_classify(train, test, ["id"], 5).first().pred == 0


def test_smote_needs_enough_minority_rows(spark):
    df = spark.range(30).select("id", F.array(F.col("id") * 1.0).alias("vec"), (F.col("id") < 4).cast("int").alias("label"))
    with pytest.raises(ValueError, match="minority"):
        resample.smote(df, ["id"])


def test_long_values_do_not_fit_fixed_fields(spark):
    layout = [io.Field("k", 1, 3, "int")]
    ok = spark.createDataFrame([(123,)], "k int")
    assert io.to_fixed_width(ok, layout).first().value == "123"
    with pytest.raises(Exception, match="too long"):
        io.to_fixed_width(spark.createDataFrame([(12345,)], "k int"), layout).collect()


def test_many_thresholds_have_distinct_ordinals(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("label"),
                                 F.when(F.col("id") % 7 > 0, F.col("id") % 150 * 1.0).alias("s"))
    ts = [float(t) for t in range(149, -2, -1)]
    out = evaluate.threshold_grid(df, [("a", F.col("s")), ("b", -F.col("s"))], ts).toPandas()
    assert out.ordinal.is_unique and len(out) == 2 * len(ts)
    rows = df.toPandas()
    for r in out[out.model == "a"].sample(20, random_state=0).itertuples():
        above = rows.s > r.threshold
        assert (r.tp, r.fp) == ((above & (rows.label == 1)).sum(), (above & (rows.label == 0)).sum())
        assert r.tn + r.fp + r.fn + r.tp == 400
