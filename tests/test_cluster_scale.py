import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import cluster, knn, scale


def _silhouette(X, lab):
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouette_exact(spark):
    rng = np.random.default_rng(2)
    X = np.vstack([rng.normal(0, 1, (30, 3)), rng.normal(4, 1, (30, 3)), [[9.0, 9.0, 9.0]]])
    lab = np.array([0] * 30 + [1] * 30 + [2])
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], int(lab[i])) for i in range(len(X))],
                               "id bigint, vec array<double>, c int")
    got = cluster.silhouette(df, ["id"], "c").collect()[0].silhouette
    assert got == pytest.approx(_silhouette(X, lab), rel=1e-9)


def test_cluster_guided_fewer_rows(spark):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(0, 1, (60, 2)), rng.normal(5, 1, (20, 2))])
    y = [0] * 60 + [1] * 20
    df = spark.createDataFrame([(i, float(X[i, 0]), float(X[i, 1]), y[i]) for i in range(80)],
                               "id bigint, a double, b double, label int")
    out, scores = cluster.under_cluster_guided(df, ["id"], ["a", "b"], "label", 2)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[1] == 20 and 0 < counts[0] < 60 and scores.count() == 4


def test_medoids_are_rows(spark):
    rng = np.random.default_rng(7)
    X = np.vstack([rng.normal(0, 1, (40, 2)), rng.normal(6, 1, (40, 2))])
    df = spark.createDataFrame([(i, float(X[i, 0]), float(X[i, 1])) for i in range(80)], "id bigint, a double, b double")
    assigned, meds = cluster.medoids(df, ["id"], ["a", "b"], 2)
    assert assigned.select("cluster").distinct().count() == 2
    ids = {r.id for r in meds.collect()}
    assert len(ids) == 2 and ids <= set(range(80))


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (None, 5.0)], "x double, c double")
    mm = {r.x: r.c for r in scale.MinMaxScaler(["x", "c"]).fit(df).transform(df).collect() if r.x is not None}
    assert set(mm.values()) == {0.0} and sorted(mm) == [0.0, 1 / 3, 1.0]
    st = [r.x for r in scale.StandardScaler(["x"]).fit(df).transform(df).collect() if r.x is not None]
    ref = (np.array([1, 2, 4]) - 7 / 3) / np.std([1, 2, 4])
    assert st == pytest.approx(list(ref))
    rb = [r.x for r in scale.RobustScaler(["x"]).fit(df).transform(df).collect() if r.x is not None]
    assert rb == pytest.approx([(1 - 2) / 1.5, 0.0, 2 / 1.5])
    assert scale.Identity().transform(df).collect() == df.collect()
    nz = scale.normalize_rows(spark.createDataFrame([(3.0, 4.0), (0.0, 0.0)], "a double, b double"), ["a", "b"]).collect()
    assert (nz[0].a, nz[0].b, nz[1].a) == (0.6, 0.8, 0.0)


def test_under_centroids_counts(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(120, 3))
    y = [1 if i % 4 == 0 else 0 for i in range(120)]
    df = spark.createDataFrame([(float(a), float(b), float(c), l) for (a, b, c), l in zip(X, y)],
                               "a double, b double, c double, label int")
    out = cluster.under_centroids(df, ["a", "b", "c"], "label")
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {1: 30, 0: 30}
    # fewer distinct majority points than centroids: still exactly n_minority, at those points
    few = spark.createDataFrame([(float(i % 3), int(i >= 40)) for i in range(50)], "a double, label int")
    got = cluster.under_centroids(few, ["a"], "label").where("label = 0").toPandas()
    assert len(got) == 10 and set(got.a) == {0.0, 1.0, 2.0}
    with pytest.raises(Exception):
        cluster.under_centroids(few.withColumn("a", F.when(F.col("a") > 0, F.col("a"))), ["a"], "label")


def test_medoid_samples_grow_and_are_checked(spark):
    df = spark.range(500).select("id", (F.col("id") % 10 * 1.0).alias("a"))
    assigned, med = cluster.medoids(df, ["id"], ["a"], 2)
    assert assigned.count() == 500 and med.count() == 2
    with pytest.raises(ValueError):
        cluster.medoids(df.limit(1), ["id"], ["a"], 2)


def _pam(X, k):
    """Plain PAM: build, then best swaps."""
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    med = [int(D.sum(axis=0).argmin())]
    while len(med) < k:
        gain = np.minimum(D - D[:, med].min(axis=1)[:, None], 0).sum(axis=0)
        gain[med] = np.inf
        med.append(int(gain.argmin()))
    cost = D[:, med].min(axis=1).sum()
    while True:
        trials = [(D[:, [*med[:i], h, *med[i + 1:]]].min(axis=1).sum(), h, i) for i in range(k) for h in range(len(X))]
        c, h, i = min(trials)
        if c >= cost - 1e-9 * cost:
            return med, cost
        med[i], cost = h, c


@pytest.mark.parametrize("k, cells", [(1, 256), (3, 40)])
def test_medoids_are_pam_over_all_rows(spark, k, cells):
    rng = np.random.default_rng(11)
    X = np.vstack([rng.normal(c, 1.0, (n, 2)) for c, n in ((0, 140), (5, 90), ((9, 0), 60), ((-7, 7), 10))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "id bigint, a double, b double")
    assigned, meds = cluster.medoids(df, ["id"], ["a", "b"], k, rows_per_cell=cells)
    want, cost = _pam(X, k)
    got = {r.cluster: r.id for r in meds.collect()}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    assert D[:, list(got.values())].min(axis=1).sum() <= cost * (1 + 1e-9)
    for r in assigned.collect():
        assert D[r.id, got[r.cluster]] == D[r.id, list(got.values())].min()


def test_centroids_follow_the_data(spark):
    rng = np.random.default_rng(2)
    X = np.vstack([rng.normal(20 * c, 0.5, (50, 2)) for c in range(6)])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in X], "a double, b double")
    got = cluster.centroids(df, ["a", "b"], 40, max_iter=6).toPandas()
    assert len(got) == 40 and sorted(got.cid) == list(range(40))
    C = got[["a", "b"]].to_numpy()
    cost = lambda c: (((X[:, None] - c[None]) ** 2).sum(-1).min(axis=1)).sum()
    assert cost(C) < np.mean([cost(X[rng.choice(300, 40, replace=False)]) for _ in range(20)])
    # one more round of plain k-means does not gain much: the rounds are real
    near = ((X[:, None] - C[None]) ** 2).sum(-1).argmin(axis=1)
    moved = np.array([X[near == c].mean(axis=0) if (near == c).any() else C[c] for c in range(40)])
    assert cost(moved) > 0.9 * cost(C)


@pytest.mark.parametrize("method, pick", [("kmeans", "highest"), ("medoids", "lowest"), ("kmeans", "median")])
def test_cluster_guided_picks_from_recomputed_silhouettes(spark, method, pick):
    rng = np.random.default_rng(8)
    # two clusters a class, planted far apart; sizes tell them
    spots = {(0, 0): ((0, 0), 40), (0, 1): ((30, 0), 25), (1, 0): ((3, 0), 12), (1, 1): ((60, 5), 8)}
    rows, group = [], []
    for (y, g), (at, n) in spots.items():
        for _ in range(n):
            rows.append((len(rows), *[float(v) for v in rng.normal(at, 0.6)], y))
            group.append((y, g))
    X = np.array([r[1:3] for r in rows])
    df = spark.createDataFrame(rows, "id bigint, a double, b double, label int")
    out, scores = cluster.under_cluster_guided(df, ["id"], ["a", "b"], "label", 2, pick, method=method)
    sil = {}
    for m in (0, 1):
        for j in (0, 1):
            use = [i for i, g in enumerate(group) if g in ((1, m), (0, j))]
            sil[m, j] = _silhouette(X[use], np.array([group[i][0] for i in use]))
    got = {(r.min_cluster, r.maj_cluster): r.silhouette for r in scores.collect()}
    assert got == pytest.approx(sil)
    values = list(sil.values())
    centre = {"mean": np.mean(values), "median": np.median(values)}.get(pick)
    best = {"highest": max, "lowest": min}.get(pick)
    chosen = best(sil, key=sil.get) if best else min(sorted(sil), key=lambda p: abs(sil[p] - centre))
    keep = {i for i, g in enumerate(group) if g[0] == 1 or g == (0, chosen[1])}
    assert {r.id for r in out.collect()} == keep


def test_unknown_pick_is_an_error(spark):
    df = spark.createDataFrame([(1, 1.0, 0)], "id bigint, a double, label int")
    with pytest.raises(ValueError):
        cluster.under_cluster_guided(df, ["id"], ["a"], "label", 2, "best")


def test_clusters_named_by_text_and_blocks_of_many_rows(spark):
    # more rows a block than a chunk of the kernel; cluster names are text
    rng = np.random.default_rng(6)
    lab = np.array([i % 3 for i in range(900)])
    X = rng.normal(size=(900, 2)) + lab[:, None] * 4.0
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], f"c{lab[i]}") for i in range(900)],
                               "id bigint, vec array<double>, c string")
    assert cluster.silhouette(df, ["id"], "c").first().silhouette == pytest.approx(_silhouette(X, lab), rel=1e-9)


def test_cluster_guided_with_more_rows_than_a_chunk(spark):
    df = spark.range(1400).select("id", (F.col("id") % 7 * 1.0 + F.when(F.col("id") % 5 == 0, 50.0).otherwise(0.0)).alias("a"),
                                  (F.col("id") % 11 * 1.0).alias("b"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    out, scores = cluster.under_cluster_guided(df, ["id"], ["a", "b"], "label", 2)
    assert scores.count() == 4 and out.where("label = 1").count() == 350 and out.count() < 1400


def test_medoids_weigh_few_rows_and_are_exact(spark, monkeypatch):
    # three spots; candidates are bounded by cells, so few are weighed against all rows
    rng = np.random.default_rng(3)
    X = np.vstack([rng.uniform(c, np.add(c, 1.0), (n, 2)) for c, n in (((0, 0), 600), ((30, 0), 450), ((0, 40), 450))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "id bigint, a double, b double")
    weighed, blocks = [], cluster.pairwise_blocks
    monkeypatch.setattr(cluster, "pairwise_blocks", lambda left, right, *a, **kw: (
        weighed.append(right.count()), blocks(left, right, *a, **kw))[1])
    _, meds = cluster.medoids(df, ["id"], ["a", "b"], 3)
    assert max(weighed) < 300
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    want = {int(np.arange(s, e)[D[s:e, s:e].sum(axis=1).argmin()]) for s, e in ((0, 600), (600, 1050), (1050, 1500))}
    assert {r.id for r in meds.collect()} == want


def test_medoids_of_repeated_keys(spark, monkeypatch):
    # every row twice: a candidate counts once, so the swaps come to an end
    rng = np.random.default_rng(12)
    X = np.vstack([rng.normal(c, 1.0, (40, 2)) for c in (0, 9)])
    once = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "id bigint, a double, b double")
    steps, blocks = [], cluster.pairwise_blocks
    monkeypatch.setattr(cluster, "pairwise_blocks", lambda *a, **kw: (steps.append(1), blocks(*a, **kw))[1])
    twice = {r.id for r in cluster.medoids(once.unionByName(once), ["id"], ["a", "b"], 2)[1].collect()}
    assert len(steps) < 20
    assert twice == {r.id for r in cluster.medoids(once, ["id"], ["a", "b"], 2)[1].collect()}


def _distance_sums(ids, X, lab):
    """Sums of distances to each cluster by key and own cluster; rows of one key have no distance."""
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    D[ids[:, None] == ids[None]] = 0.0
    out = {}
    for i in range(len(X)):
        for c in set(lab) - {None}:
            at = (ids[i], lab[i], c)
            out[at] = out.get(at, 0.0) + D[i, [x == c for x in lab]].sum()
    return out


def _sums_of(df):
    return {(r.id, r["__lc"], r["__rc"]): r["__sd"] for r in cluster.cluster_distance_sums(df, ["id"], "c").collect()}


def _refuse(*_, **__):
    raise AssertionError("all pairs of rows measured")


def test_pairs_are_measured_once_and_by_products(monkeypatch):
    rng = np.random.default_rng(21)
    X, block, code = rng.normal(size=(1500, 16)) + 50.0, np.arange(1500) % 2, np.arange(1500) % 3
    one_by_one, pairs = [], []
    measure, products = knn._measure, knn.Products.distances
    monkeypatch.setattr(knn, "distances", _refuse)
    monkeypatch.setattr(knn, "_measure", lambda Q, R, i, j: (one_by_one.append(len(i)), measure(Q, R, i, j))[1])
    monkeypatch.setattr(knn.Products, "distances", lambda *a: (D := products(*a), pairs.append(D.size))[0])
    rows = pd.DataFrame({"id": np.arange(1500), "__lc": code, "__code": code, "vec": list(X), "__b": block})
    kernel, got = cluster._cluster_sum_kernel(["id"], 3, "vec"), np.zeros((1500, 3))
    for lo, hi in ((0, 0), (0, 1), (1, 1)):
        out = kernel(rows[rows["__b"].isin([lo, hi])].assign(__lo=lo, __hi=hi))
        got[out["id"]] += out[["__s0", "__s1", "__s2"]].to_numpy()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    assert got == pytest.approx(np.stack([D[:, code == c].sum(axis=1) for c in range(3)], axis=1), rel=1e-11)
    assert sum(one_by_one) == 1500  # a row and itself
    assert sum(pairs) < 0.75 * 1500 ** 2


@pytest.mark.parametrize("dims", [1, 2, 6])
def test_distance_sums_of_tight_far_equal_and_repeated_rows(spark, monkeypatch, dims):
    # clusters a millionth as wide as they lie apart, one of equal rows, rows without a cluster, repeated and missing keys
    monkeypatch.setattr(cluster, "pairwise_blocks", _refuse)
    monkeypatch.setattr(cluster, "LINE_ROWS", 150, raising=False)
    rng = np.random.default_rng(22)
    lab = ["a"] * 300 + ["b"] * 300 + ["c"] * 40 + [None] * 20 + ["d"]
    far = np.repeat([0.0, 1e6, -3e6, 5.0, 7.0], [300, 300, 40, 20, 1])
    X = rng.normal(size=(661, dims)) * np.repeat([1.0, 1.0, 0.0, 1.0, 1.0], [300, 300, 40, 20, 1])[:, None] + far[:, None]
    ids = np.arange(661)
    ids[[5, 310, 311]], ids[601] = 7, 602
    df = spark.createDataFrame([(int(i), [float(v) for v in x], c) for i, x, c in zip(ids, X, lab)],
                               "id bigint, vec array<double>, c string")
    got = _sums_of(df)
    want = _distance_sums(ids, X, lab)
    assert got.keys() == want.keys()
    for at, v in want.items():
        assert got[at] == pytest.approx(v, rel=1e-9, abs=0.0 if v == 0 else 1e-9 * v), at
    # a row without a key is like no other row
    nameless = df.withColumn("id", F.when(F.col("id") < 20, F.col("id")))
    want = _distance_sums(np.where(ids < 20, ids, -1 - np.arange(661)), X, lab)
    whole = {}
    for (i, own, c), v in want.items():
        at = (i if i >= 0 else None, own, c)
        whole[at] = whole.get(at, 0.0) + v
    assert _sums_of(nameless) == pytest.approx(whole, rel=1e-9)


def test_rows_of_one_dimension_are_sorted_not_paired(spark, monkeypatch):
    for name in ("pairwise_blocks", "own_pair_blocks"):
        monkeypatch.setattr(cluster, name, _refuse, raising=False)
    monkeypatch.setattr(cluster, "LINE_ROWS", 300, raising=False)
    rng = np.random.default_rng(23)
    X, lab = rng.uniform(size=(1000, 1)).round(2), np.array([i % 4 for i in range(1000)])
    df = spark.createDataFrame([(i, [float(X[i, 0])], int(lab[i])) for i in range(1000)], "id bigint, vec array<double>, c int")
    assert cluster.silhouette(df, ["id"], "c").first().silhouette == pytest.approx(_silhouette(X, lab), rel=1e-9)
    guided = spark.createDataFrame([(i, float(X[i, 0] + (i % 5 == 0)), int(i % 5 == 0)) for i in range(1000)],
                                   "id bigint, a double, label int")
    out, scores = cluster.under_cluster_guided(guided, ["id"], ["a"], "label", 2)
    assert scores.count() == 4 and out.where("label = 1").count() == 200 and out.count() < 1000
    with pytest.raises(Exception, match="a vector"):
        _sums_of(df.withColumn("vec", F.array(F.when(F.col("id") > 3, F.col("vec")[0]))))
