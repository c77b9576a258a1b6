"""Edge rows of the label rules (FIXTURES.md 2.1)."""

import pytest

from riskframe.operators import labels
from riskframe.plans import presets


def _lab(df):
    return [r.label for r in df.collect()]


def test_conditions(spark):
    df = spark.createDataFrame([(1, 2.0, None, None, 1.0), (2, None, None, None, None), (3, 2.0, 2.0, 2.0, 2.0)],
                               "id int, MCQ160B double, MCQ160C double, MCQ160E double, MCQ160F double")
    out = presets.conditions(df, []).orderBy("id")
    assert _lab(out) == [1, 0, 0]
    assert "MCQ160B" not in out.columns


def test_symptoms(spark):
    cols = presets.SYMPTOM_COLS
    schema = "id int, " + ", ".join(f"{c} double" for c in cols)
    r1 = [1] + [2.0 if c == "CDQ005" else None for c in cols]
    r2 = [2] + [8.0 if c == "CDQ009H" else None for c in cols]
    out = presets.symptoms(spark.createDataFrame([r1, r2], schema), []).orderBy("id")
    assert _lab(out) == [1, 0]


def test_biomarkers_threshold(spark):
    schema = "id int, LBXTC double, LBDLDL double, LBDHDD double, LBXTR double, LBXGLU double"
    nan = float("nan")
    from riskframe.functions.rules import nan_to_null
    df = nan_to_null(spark.createDataFrame([(1, 240.0, 131.0, 39.0, None, None), (2, 239.0, 131.0, 39.0, None, None),
                                            (3, nan, nan, nan, nan, nan)], schema))
    assert _lab(presets.biomarkers(df, []).orderBy("id")) == [1, 0, 0]


def test_cause_of_death(spark):
    schema = "id int, ELIGSTAT double, MORTSTAT double, UCOD_LEADING double"
    df = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 5.0), (3, 1.0, 1.0, 2.0), (4, 1.0, 1.0, None),
                                (5, 1.0, 0.0, 1.0)], schema)
    assert _lab(presets.cvr_death(df, ["ELIGSTAT", "MORTSTAT", "UCOD_LEADING"]).orderBy("id")) == [1, 1, 0, 0]
    bad = spark.createDataFrame([(9, 1.0, 1.0, 99.0)], schema)
    with pytest.raises(Exception):
        presets.cvr_death(bad, []).collect()


def test_mean_threshold_and_contributing(spark):
    schema = ("id int, SDDSRVYR int, BPXSY1 double, BPXSY2 double, BPXSY3 double, BMXBMI double, RIAGENDR double, "
              "RIDAGEYR double, RIDRETH1 double, DIQ010 double, SMQ020 double, KIQ022 double")
    rows = [(1, 9, 130.0, 130.0, 130.0, 25.0, 1.0, 50.0, 1.0, 2.0, 2.0, 2.0),
            (2, 9, 129.99, 129.99, 129.99, 25.0, 1.0, 50.0, 1.0, 2.0, 2.0, 2.0),
            (3, 10, None, 150.0, 150.0, 25.0, 1.0, 50.0, 1.0, 2.0, 2.0, 2.0),
            (4, 8, 150.0, 150.0, 150.0, 25.0, 1.0, 50.0, 1.0, 2.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, schema)
    out = labels.label_mean_threshold(df, ["id"], [9, 10], "SDDSRVYR", presets.SYSTOLIC_COLS, ["BMXBMI"], 130.0,
                                      presets.HYPERTENSION_FEATURES, remove_outliers=False).orderBy("id")
    assert [(r.id, r.label) for r in out.collect()] == [(1, 1), (2, 0)]
    h = spark.createDataFrame([(1, 1.0, 1.0, None), (2, 1.0, 1.0, 1.0), (3, 1.0, 1.0, 0.0)],
                              "id int, ELIGSTAT double, MORTSTAT double, HYPERTEN double")
    got = labels.label_contributing(h, presets.LINKED_DEAD, "HYPERTEN", ["id"], []).orderBy("id")
    assert _lab(got) == [0, 1, 0]
