import math

import pytest
from pyspark.sql import functions as F

from riskframe.functions.rules import (Rule, any_of, decode, decoded_code, flag_count, nan_to_null,
                                       row_mean, yes_no)
from riskframe.plans.presets import CAUSE_OF_DEATH, NOT_DEAD


def test_missing_never_satisfies_comparisons(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (240.0,)], "x double")
    df = nan_to_null(df)
    got = [r.f for r in df.select(Rule("x", ">", 239).to_column().alias("f")).collect()]
    assert got == [False, False, True]


def test_not_equal_is_null_safe(spark):
    df = spark.createDataFrame([(20.0, None), (20.0, 1.0), (19.0, 2.0), (None, 2.0)], "age double, p double")
    kept = df.where(Rule("age", ">=", 20).to_column() & Rule("p", "!=", 1).to_column()).collect()
    assert [(r.age, r.p) for r in kept] == [(20.0, None)]


def test_flag_count_and_any(spark):
    df = spark.createDataFrame([(240.0, 131.0, 39.0, None, None), (239.0, 131.0, 39.0, None, None),
                                (None, None, None, None, None)], "tc double, ldl double, hdl double, tr double, glu double")
    flags = [Rule("tc", ">", 239), Rule("ldl", ">", 130), Rule("hdl", "<", 40), Rule("glu", ">", 200),
             Rule("tr", ">", 200)]
    got = [r.n for r in df.select(flag_count(flags).alias("n")).collect()]
    assert got == [3, 2, 0]
    assert [int(r.l) for r in df.select((flag_count(flags) > 2).cast("int").alias("l")).collect()] == [1, 0, 0]
    assert [r.a for r in df.select(any_of(flags[:1]).alias("a")).collect()] == [True, False, False]


def test_row_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    got = [r.m for r in df.select(row_mean(["a", "b", "c"]).alias("m")).collect()]
    assert got[0] == 2.0 and got[1] is None


def test_yes_no(spark):
    df = spark.createDataFrame([(1,), (2,), (7,), (None,)], "c int")
    assert [r.y for r in df.select(yes_no("c").alias("y")).collect()] == [1, 0, None, None]


def test_decode_missing_and_unknown(spark):
    df = spark.createDataFrame([(1.0,), (None,), (5.0,)], "u double")
    got = [r.n for r in df.select(decode("u", CAUSE_OF_DEATH, NOT_DEAD).alias("n")).collect()]
    assert got == ["HEART_DISEASE", "NOT_DEAD", "CEREBROVASCULAR_DISEASE"]
    bad = spark.createDataFrame([(99.0,)], "u double")
    with pytest.raises(Exception):
        bad.select(decoded_code("u", CAUSE_OF_DEATH, NOT_DEAD)).collect()
