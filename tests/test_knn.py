import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import knn


def _vecs(spark, n=120, d=5, seed=3):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    y = (rng.random(n) < 0.3).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in X[i]], int(y[i])) for i in range(n)],
                               "id bigint, vec array<double>, label int")
    return df, X, y


def _brute(X, k, exclude_self=True):
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    if exclude_self:
        np.fill_diagonal(D, np.inf)
    return {i: list(np.lexsort((np.arange(len(X)), D[i]))[:k]) for i in range(len(X))}


@pytest.mark.parametrize("block_rows", [16, 1000])
def test_knn_join_matches_bruteforce(spark, block_rows):
    df, X, _ = _vecs(spark)
    got = knn.knn_join(df, df, 4, ["id"], exclude_self=True, block_rows=block_rows).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.id, r.rank)):
        res.setdefault(r.id, []).append(r.nn_id)
    assert res == {i: [int(j) for j in v] for i, v in _brute(X, 4).items()}


def test_knn_classify(spark):
    df, X, y = _vecs(spark)
    train = df.where("id >= 30")
    test = df.where("id < 30")
    got = {r.id: r.pred for r in knn.knn_classify(train, test, ["id"], 5).collect()}
    D = np.sqrt(((X[:30, None, :] - X[None, 30:, :]) ** 2).sum(-1))
    for i in range(30):
        nn = np.lexsort((np.arange(30, len(X)), D[i]))[:5]
        votes = y[30:][nn]
        assert got[i] == int(votes.sum() >= 3)


def _clustered(spark, n=3000, d=3, seed=5):
    rng = np.random.default_rng(seed)
    centre = rng.uniform(-100, 100, size=(24, d))
    X = centre[rng.integers(0, 24, n)] + rng.normal(scale=0.5, size=(n, d))
    X[10] = X[11] = X[12]  # ties
    X[13] = 1000.0  # far from every cell
    df = spark.createDataFrame([(i, [float(v) for v in X[i]]) for i in range(n)], "id bigint, vec array<double>")
    return df, X


@pytest.mark.parametrize("exclude_self", [True, False])
@pytest.mark.parametrize("block_rows", [0, 40])
def test_cells_skip_pairs_and_lose_nothing(spark, exclude_self, block_rows):
    df, X = _clustered(spark)
    found, visits = knn.cell_join(df, df, 5, ["id"], ["id"], exclude_self=exclude_self, block_rows=block_rows,
                                  rows_per_cell=32)
    n_cells = 3000 // 32
    copies = [len(r["__to"]) for r in visits.select("id", "__to").collect()]
    assert len(copies) == 3000  # every row asks once
    # of 93 cells a row visits a few: nearly all pairs are ruled out by the triangle inequality
    assert sum(copies) / len(copies) < 0.1 * n_cells
    got = {}
    for r in knn.knn_join(df, df, 5, ["id"], exclude_self=exclude_self, block_rows=block_rows, rows_per_cell=32).collect():
        got.setdefault(r.id, []).append((r["rank"], r.nn_id))
    want = _brute(X, 5, exclude_self)
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {i: [int(j) for j in v] for i, v in want.items()}


@pytest.mark.parametrize("k, n", [(7, 5), (40, 60)])
def test_fewer_rows_than_neighbours_in_a_cell(spark, k, n):
    df, X, _ = _vecs(spark, n=n, d=2)
    for exclude_self in (True, False):
        got = {}
        for r in knn.knn_join(df, df, k, ["id"], exclude_self=exclude_self, rows_per_cell=4).collect():
            got.setdefault(r.id, []).append((r["rank"], r.nn_id))
        D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
        for i in range(n):
            order = [int(j) for j in np.lexsort((np.arange(n), D[i])) if j != i or not exclude_self]
            assert [j for _, j in sorted(got[i])] == order[:k]


def test_one_crowded_cell_is_cut_into_blocks(spark):
    # a third of the rows share one point, so one cell holds them whatever the pivots
    rows = [(i, [0.0, 0.0] if i % 3 == 0 else [float(i), 1.0]) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    X = np.array([v for _, v in rows])
    got = {}
    for r in knn.knn_join(df, df, 3, ["id"], exclude_self=True, block_rows=25, rows_per_cell=20).collect():
        got.setdefault(r.id, []).append((r["rank"], r.nn_id))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {
        i: [int(j) for j in v] for i, v in _brute(X, 3).items()}


def test_no_right_rows(spark):
    df, _, _ = _vecs(spark, n=4)
    assert knn.knn_join(df, df.limit(0), 3, ["id"]).count() == 0
    assert knn.knn_join(df.limit(0), df, 3, ["id"]).count() == 0


def _ranked(df, k, **options):
    got = {}
    for r in knn.knn_join(df, df, k, ["id"], exclude_self=True, **options).collect():
        got.setdefault(r.id, []).append((r["rank"], r.nn_id))
    return {i: [j for _, j in sorted(v)] for i, v in got.items()}


def test_rows_without_structure_are_copied_once_a_bin(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(2500, 16))
    df = spark.createDataFrame([(i, [float(v) for v in X[i]]) for i in range(2500)], "id bigint, vec array<double>")
    _, visits = knn.cell_join(df, df, 3, ["id"], ["id"], exclude_self=True, rows_per_cell=32)
    # 78 cells, hardly any ruled out: a row was copied to each of them
    assert max(len(r["__to"]) for r in visits.select("__to").collect()) <= knn.TARGET_BINS
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(D, np.inf)
    want = np.argsort(D, axis=1)[:, :3]
    assert _ranked(df, 3, rows_per_cell=32) == {i: [int(j) for j in want[i]] for i in range(2500)}


def test_text_keys_over_several_bins(spark):
    X = [[float(i % 29), float(i % 31)] for i in range(400)]
    df = spark.createDataFrame([(f"r{i:03d}", X[i]) for i in range(400)], "id string, vec array<double>")
    want = _brute(np.array(X), 2)
    assert _ranked(df, 2, block_rows=60, rows_per_cell=20) == {f"r{i:03d}": [f"r{j:03d}" for j in v] for i, v in want.items()}


def test_single_precision_bounds_lose_no_pair(spark):
    # rows that single precision cannot tell apart, far from the origin, among far ones and many equal ones
    rng = np.random.default_rng(4)
    X = np.vstack([1e6 + rng.normal(scale=1e-3, size=(200, 3)), rng.normal(scale=1e8, size=(40, 3)),
                   np.repeat([[5.0, 5.0, 5.0]], 60, axis=0), np.zeros((3, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id bigint, vec array<double>")
    acc = np.zeros((len(X), len(X)))
    for c in X.T:
        acc += (c[:, None] - c[None, :]) ** 2
    D = np.sqrt(acc)
    np.fill_diagonal(D, np.inf)
    want = {i: [int(j) for j in np.lexsort((np.arange(len(X)), D[i]))[:4]] for i in range(len(X))}
    assert _ranked(df, 4, block_rows=90, rows_per_cell=16) == want


def test_every_pair_of_blocks_meets(spark):
    import pandas as pd
    df = spark.range(600).select("id", F.array(F.col("id").cast("double")).alias("vec"))

    def sizes(lp, rp):
        return pd.DataFrame({"id": rp["id"].to_numpy(), "n": [len(lp)] * len(rp)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with tables that are not tiny
    try:
        met = knn.pairwise_blocks(df, df, ["id"], ["id"], sizes, "id bigint, n bigint", block_rows=100)
        got = {r.id: r.n for r in met.groupBy("id").agg(F.sum("n").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: 600 for i in range(600)}
