"""The reference's own unit-test fixtures, with exact expectations."""

from pyspark.sql import functions as F

from riskframe.operators import clean, outliers, splits


def test_sparse_drop_half_present_is_kept(spark):
    rows = [(1.0 if i < 4 else None, i + 1, 5.0 if i < 5 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "c0 double, c1 bigint, c2 double")
    model = clean.DropSparse(["c0", "c1", "c2"], 0.5).fit(df)
    assert model.kept == ["c1", "c2"]
    assert model.transform(df).columns == ["c1", "c2"]


def test_drop_any_null(spark):
    rows = [(1.0 if i < 4 else None, i + 1, 5.0) for i in range(10)]
    df = spark.createDataFrame(rows, "c0 double, c1 bigint, c2 double")
    assert clean.DropAnyNull(["c0", "c1", "c2"]).fit(df).kept == ["c1", "c2"]


def test_iqr_removal_exact_fences(spark):
    df = spark.createDataFrame([(i, 2, i) for i in range(1, 11)], "a bigint, b bigint, y bigint")
    b = {r.feature: (r.lower, r.upper) for r in outliers.iqr_bounds(df, ["a", "b"]).collect()}
    assert b["a"] == (-3.5, 14.5) and b["b"] == (2.0, 2.0)
    assert outliers.iqr_removal(df, ["a", "b"]).count() == 10


def test_majority_split(spark):
    df = spark.createDataFrame([(i, y) for i, y in zip(range(1, 6), [0, 0, 1, 1, 1])], "x bigint, label int")
    tagged = splits.split_majority(df)
    maj = sorted(r.x for r in tagged.where("is_majority = 1").collect())
    mino = sorted(r.x for r in tagged.where("is_majority = 0").collect())
    assert maj == [3, 4, 5] and mino == [1, 2]


def test_equal_classes_class0_is_majority(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "x bigint, label int")
    tagged = {r.x: r.is_majority for r in splits.split_majority(df).collect()}
    assert tagged == {1: 1, 2: 0}


def test_iqr_by_class_missing_cell_not_outlier(spark):
    df = spark.createDataFrame([(float(i), 0) for i in range(1, 11)] + [(None, 0), (1000.0, 0), (5.0, 1)],
                               "a double, label int")
    kept = outliers.iqr_removal_by_class(df, ["a"], "label")
    vals = [r.a for r in kept.collect()]
    assert None in vals and 1000.0 not in vals and 5.0 in vals
