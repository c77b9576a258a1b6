from pyspark.sql import functions as F

import __spark_entry__ as E
from riskframe.operators import splits
from riskframe.plans import cohorts as C
from riskframe.plans import grid

from .conftest import SF001


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["feature", "value"] and df.count() >= 1


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 90


def test_chain_resamples_only_at_fit(spark):
    t = C.t3(spark, SF001)
    flagged = splits.split_stratified(t, C.T3_KEY, "label", 0.2)
    train, test = splits.train_test(flagged)
    cfg = grid.Chain(0.5, True, "standard", "all", "under_random", "logistic")
    fitted = grid.fit_chain(cfg, train, C.T3_FEATURES, C.T3_KEY)
    pred = fitted.transform(test)
    assert pred.count() == test.count()
    assert pred.where(~F.col("pred").isin(0, 1)).count() == 0


def test_grid_configs():
    cfgs = grid.grid_configs({"scaler": ["minmax", "standard"], "model": ["logistic", "forest", "svc"]})
    assert len(cfgs) == 6 and cfgs[0].prefix(3) == (0.5, True, "minmax")


def test_fused_front_equals_stepwise(spark):
    import pytest
    from riskframe.operators import profile
    t = C.t1(spark, SF001)
    feats = C.T1_FEATURES
    stats = {r.feature: r.asDict() for r in profile.feature_stats(t, feats).collect()}
    for scaler in ("minmax", "standard"):
        cfg = grid.Chain(0.5, True, scaler, "all", "none", "logistic")
        models_, fe = grid.fused_front(cfg, stats, list(feats))
        a = t
        for m in models_:
            a = m.transform(a)
        d, fs = t, list(feats)
        for depth in range(3):
            m, d, fs = grid._fit_prefix_step(depth, cfg, d, fs, C.T1_KEY, "label")
        assert fe == fs
        ra = {tuple(r[k] for k in C.T1_KEY): r for r in a.select(*C.T1_KEY, *fe).collect()}
        rb = {tuple(r[k] for k in C.T1_KEY): r for r in d.select(*C.T1_KEY, *fs).collect()}
        for k, r in ra.items():
            for f in fe:
                assert r[f] == pytest.approx(rb[k][f], rel=1e-9, abs=1e-12)


def test_study_grids_expand():
    small, shapes = grid.study_grid(), grid.shape_grid()
    assert len(small) == 120 and len({c.prefix(7) for c in small}) == 120
    sizes = {}
    for c in shapes:
        sizes[c.pipeline] = sizes.get(c.pipeline, 0) + 1
    assert sizes == {"noSampling": 10, "withSampling": 60, "kus": 240, "kusWithSampling": 1440}
    assert len({(c.pipeline, c.prefix(7)) for c in shapes}) == 1750
    assert [n for n, _ in shapes[-1].steps()] == ["impute", "scale", "cluster", "sampler", "model"]


def test_four_shapes_fit_and_predict(spark):
    t = C.t3(spark, SF001)
    train, test = splits.train_test(splits.split_stratified(t, C.T3_KEY, "label", 0.2))
    n, counts = test.count(), {}
    guided = (2, "lowest", "medoids")
    for name, cfg in {"noSampling": grid.Chain(model="logistic"), "withSampling": grid.Chain(sampler="under_centroids"),
                      "kus": grid.Chain(cluster=guided),
                      "kusWithSampling": grid.Chain(cluster=(2, "highest", "kmeans"), sampler="smote", model="knn")}.items():
        pred = grid.fit_chain(cfg, train, C.T3_FEATURES, C.T3_KEY).transform(test)
        counts[name] = pred.where(F.col("pred").isin(0, 1)).count()
    assert counts == dict.fromkeys(counts, n) and len(counts) == 4


def test_resampled_rows_keep_their_provenance(spark):
    t = C.t3(spark, SF001)
    ids = {r.doc_id for r in t.where("label = 1").select("doc_id").collect()}
    guided = grid._cluster_step((2, "highest", "kmeans"), t, C.T3_KEY, "label", C.T3_FEATURES)
    assert {r.doc_id for r in guided.where("label = 1").collect()} == ids
    out = grid.SAMPLERS["under_centroids"](t, C.T3_KEY, "label", C.T3_FEATURES)
    rows = out.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("keys"),
                                    F.min("doc_id").alias("low")).collect()
    got = {r.label: (r.n, r.keys) for r in rows}
    small = min(len(ids), t.count() - len(ids))
    assert got == {0: (small, small), 1: (small, small)} and min(r.low for r in rows) == -small


def test_config_rows_and_top_per_pipeline(spark):
    cfgs = grid.grid_configs({"model": ["logistic", "svc"]}, "one") + grid.grid_configs(
        {"model": ["knn"], "model_params": [{"k": 3}, {"k": 7}], "sampler": ["smote"]}, "two")
    rows = {r.config: r for r in grid.config_table(spark, cfgs).collect()}
    assert [rows[i].pipeline for i in range(4)] == ["one", "one", "two", "two"]
    assert rows[3].params["model.k"] == "7" and rows[3].steps[-2:] == ["sampler", "model"]
    cv = spark.createDataFrame([(c, f, s) for c, s in ((0, 0.5), (1, 0.5), (2, 0.1), (3, 0.2)) for f in range(2)],
                               "config int, fold int, f1 double")
    assert grid.top_configs(cv, cfgs, "f1", 1) == [0, 3]
