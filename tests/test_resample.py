import numpy as np
from pyspark.sql import functions as F

from riskframe.operators import resample


def _data(spark, n=80, seed=5):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 3))
    y = (np.arange(n) % 5 == 0).astype(int)
    return spark.createDataFrame([(i, [float(v) for v in X[i]], int(y[i])) for i in range(n)],
                                 "id bigint, vec array<double>, label int")


def test_under_and_over_counts(spark):
    df = _data(spark)
    u = resample.under_random(df, ["id"])
    assert {r.label: r["count"] for r in u.groupBy("label").count().collect()} == {0: 16, 1: 16}
    o = resample.over_random(df, ["id"])
    assert {r.label: r["count"] for r in o.groupBy("label").count().collect()} == {0: 64, 1: 64}


def test_smote_on_segment(spark):
    df = _data(spark)
    syn = resample.smote(df, ["id"])
    assert syn.count() == 64 - 16
    vec = {r.id: np.array(r.vec) for r in df.collect()}
    for r in syn.collect():
        x, nn, s = vec[r.id], vec[r.nn_id], np.array(r.vec)
        assert 0 <= r.gap < 1
        assert np.allclose(s, x + r.gap * (nn - x))


def test_enn_and_tomek_bruteforce(spark):
    df = _data(spark)
    rows = df.collect()
    X = np.array([r.vec for r in rows])
    y = np.array([r.label for r in rows])
    ids = np.array([r.id for r in rows])
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    order = np.argsort(D, axis=1, kind="stable")
    bad = {int(ids[i]) for i in range(len(X)) if y[i] == 0 and (y[order[i, :3]] != y[i]).any()}
    kept = {r.id for r in resample.clean_enn(df, ["id"]).collect()}
    assert kept == set(int(i) for i in ids) - bad
    nn1 = order[:, 0]
    links = {int(ids[i]) for i in range(len(X)) if nn1[nn1[i]] == i and y[i] != y[nn1[i]] and y[i] == 0}
    kept_t = {r.id for r in resample.clean_tomek(df, ["id"]).collect()}
    assert kept_t == set(int(i) for i in ids) - links
