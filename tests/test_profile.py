import numpy as np
import pytest

from riskframe.operators import profile


def test_correlation_guarded(spark):
    df = spark.createDataFrame([(1.0, 5.0, None, 0), (2.0, 5.0, None, 1), (3.0, 5.0, None, 1)],
                               "x double, const double, empty double, label int")
    got = {r.feature: r.value for r in profile.correlation(df, ["x", "const", "empty"], "label").collect()}
    assert got["const"] is None and got["empty"] is None and got["x"] == pytest.approx(0.8660254, 1e-6)
    one = spark.createDataFrame([(1.0, 1)], "x double, label int")
    assert profile.correlation(one, ["x"], "label").collect()[0].value is None


def test_wide_route_equals_narrow(spark):
    rng = np.random.default_rng(0)
    n, d = 400, 8
    X = rng.normal(size=(n, d)) * 10 + 100
    X[rng.random((n, d)) < 0.1] = np.nan
    y = (rng.random(n) < 0.3).astype(int)
    rows = [tuple(None if np.isnan(v) else float(v) for v in X[i]) + (int(y[i]),) for i in range(n)]
    feats = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in feats) + ", label int").repartition(5)
    a = {r.feature: r for r in profile.feature_stats(df, feats, "label", "narrow").collect()}
    b = {r.feature: r for r in profile.feature_stats(df, feats, "label", "wide").collect()}
    for f in feats:
        for c in ("count", "mean", "std", "std_pop", "min", "max", "corr"):
            assert a[f][c] == pytest.approx(b[f][c], rel=1e-9, abs=1e-12), (f, c)


def test_quantiles_linear(spark):
    vals = [1.0, 2.0, 4.0, 10.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = profile.quantiles(df, ["x"], [0.25, 0.5, 0.9]).collect()[0]
    ref = np.percentile([1.0, 2.0, 4.0, 10.0], [25, 50, 90])
    assert [q.q25, q.q50, q.q90] == pytest.approx(list(ref))


def test_describe_one_row_std_is_null(spark):
    df = spark.createDataFrame([(3.0,)], "x double")
    r = profile.describe(df, ["x"]).collect()[0]
    assert r["count"] == 1 and r["std"] is None and r["p50"] == 3.0


def test_top_fraction(spark):
    df = spark.createDataFrame([(f"f{i}", float(i)) for i in range(10)] + [("n", None)], "feature string, value double")
    got = sorted(r.feature for r in profile.top_fraction(df, 0.9).collect())
    assert got == ["f9"]


def test_bounded_quantiles_large_groups_exact(spark):
    # groups larger than the accuracy exercise the sketch bracket
    rng = np.random.default_rng(11)
    vals = rng.exponential(3.0, 5000)
    lab = (rng.random(5000) < 0.3).astype(int)
    df = spark.createDataFrame([(float(v), int(l)) for v, l in zip(vals, lab)], "x double, label int").repartition(6)
    got = {r.label: r for r in profile.quantiles(df, ["x"], [0.0, 0.1, 0.5, 0.77, 1.0], ["label"], accuracy=200).collect()}
    for l in (0, 1):
        ref = np.percentile(vals[lab == l], [0, 10, 50, 77, 100])
        r = got[l]
        assert [r.q00, r.q10, r.q50, r.q77, r.q100] == pytest.approx(list(ref), rel=1e-12)
    m = {r.label: r for r in profile.quantiles(df, ["x"], [0.1, 0.5], ["label"], method="map").collect()}
    assert m[0].q50 == pytest.approx(got[0].q50, rel=1e-12)


def test_correlation_mean_imputed_equals_impute_then_corr(spark):
    from riskframe.operators import clean
    rng = np.random.default_rng(21)
    n = 300
    rows = []
    for i in range(n):
        a = None if rng.random() < 0.3 else float(rng.normal(1000, 50))
        b = None if rng.random() < 0.5 else float(rng.normal(0, 1))
        rows.append((a, b, 5.0 if i % 2 else None, None, int(rng.random() < 0.4)))
    df = spark.createDataFrame(rows, "a double, b double, c double, e double, label int")
    feats = ["a", "b", "c", "e"]
    fast = {r.feature: r.value for r in profile.correlation_mean_imputed(df, feats, "label").collect()}
    imp = clean.MeanImputer(feats, keep_empty=True).fit(df).transform(df)
    slow = {r.feature: r.value for r in profile.correlation(imp, feats, "label", route="narrow").collect()}
    for f in ("a", "b"):
        assert fast[f] == pytest.approx(slow[f], rel=1e-10)
    assert fast["c"] is None and slow["c"] is None and fast["e"] is None and slow["e"] is None


def test_moments_agree_for_a_large_offset_and_constants(spark):
    from pyspark.sql import functions as F
    df = spark.range(5000).select((F.lit(1e9) + F.col("id") % 7).alias("x"), F.lit(0.1).alias("c"),
                                  F.when(F.col("id") % 3 > 0, F.col("id") * 0.5).alias("h"),
                                  (F.col("id") % 7 > 3).cast("int").alias("label")).repartition(5)
    got = {r: {x.feature: x for x in profile.feature_stats(df, ["x", "c", "h"], "label", route=r).collect()}
           for r in ("narrow", "wide")}
    for f in ("x", "h"):
        for st in ("count", "mean", "std", "std_pop", "min", "max", "corr"):
            assert got["narrow"][f][st] == pytest.approx(got["wide"][f][st], rel=1e-8)
    assert got["wide"]["x"].std == pytest.approx(np.std(np.arange(5000) % 7, ddof=1), rel=1e-9)
    for r in got.values():
        assert r["c"].corr is None and r["c"].std == 0.0 and r["c"].std_pop == 0.0


def test_quantiles_with_heavy_ties_keep_short_arrays(spark):
    from pyspark.sql import functions as F
    df = spark.range(40000).select(F.when(F.col("id") % 2 == 0, 3.0).otherwise((F.col("id") % 9).cast("double")).alias("x"))
    values = np.array([3.0 if i % 2 == 0 else float(i % 9) for i in range(40000)])
    got = profile.quantiles(df, ["x"], [0.25, 0.5, 0.75, 0.9], accuracy=100).first()
    assert [got.q25, got.q50, got.q75, got.q90] == np.quantile(values, [0.25, 0.5, 0.75, 0.9]).tolist()
    spread = spark.range(30000).select((F.col("id") * 37 % 30011).cast("double").alias("x"))
    want = np.quantile(np.arange(30000) * 37 % 30011, [0.25, 0.5])
    got = profile.quantiles(spread, ["x"], [0.25, 0.5], accuracy=200).first()
    assert [got.q25, got.q50] == pytest.approx(want.tolist())


def test_wide_study_correlation_with_leaks_and_cohorts(spark):
    from pyspark.sql import functions as F
    from riskframe.plans.ensemble import Study, study_correlation
    n = 2000
    cols = [(F.when(F.pmod(F.hash("id", F.lit(i)), F.lit(10)) > 0, F.pmod(F.hash(F.lit(i), "id"), F.lit(1000)) * 1.0))
            .alias(f"f{i}") for i in range(n)]
    df = spark.range(300).select("id", *cols)
    label, part = F.pmod(F.hash("id"), F.lit(2)) == 0, F.col("id") < 200
    feats = [f"f{i}" for i in range(n)]
    out = study_correlation(df, {"a": Study(label, leaks=["f0", "f7"]), "b": (label, part)}, feats).toPandas()
    assert len(out) == 2 * n - 2 and not ((out.labeller == "a") & out.feature.isin(["f0", "f7"])).any()
    few = ["f1", "f2", "f3"]
    near = profile.correlation_mean_imputed(df.where(part).withColumn("y", label.cast("int")), few, "y").toPandas()
    wide = out[out.labeller == "b"].set_index("feature").value
    for r in near.itertuples():
        assert wide[r.feature] == pytest.approx(r.value, rel=1e-9)
    assert profile.sort_by_value(profile.correlation_mean_imputed(df.withColumn("y", label.cast("int")), few, "y")
                                 ).toPandas().value.is_monotonic_decreasing


def test_moments_leave_a_task_once_and_stay_exact(spark):
    import numpy as np
    from riskframe.operators import profile
    n = 5000
    df = spark.range(n).selectExpr("id % 3 AS g", "1e9 + id % 7 AS x", "IF(id % 5 = 0, NULL, id * 0.5) AS z",
                                   "CAST(id % 2 AS double) AS y").repartition(3)
    fn = profile._task_moments(["x", "z"], "y", ["g"])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # some 17 batches a task
    try:
        parts = df.select("g", "x", "z", "y").mapInPandas(fn, profile._MOMENTS + ", g bigint")
        assert parts.count() == 3 * 3 * 2  # tasks x groups x features
        got = {r.feature: r for r in profile.feature_stats(df, ["x", "z"], "y", route="wide").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    i = np.arange(n)
    x, z, y = 1e9 + i % 7, i * 0.5, (i % 2).astype(float)
    ok = i % 5 != 0
    assert abs(got["x"].std - np.std(i % 7, ddof=1)) < 1e-9 and got["x"]["count"] == n
    assert abs(got["z"].std - np.std(z[ok], ddof=1)) < 1e-9 * np.std(z[ok]) and got["z"]["count"] == ok.sum()
    assert abs(got["x"].corr - np.corrcoef(i % 7, y)[0, 1]) < 1e-9
    assert abs(got["z"].corr - np.corrcoef(z[ok], y[ok])[0, 1]) < 1e-9
