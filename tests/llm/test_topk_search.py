import math
from fractions import Fraction

import numpy as np
import pytest

from riskframe.llm.topk_search import LEVELS, block_top_k, segment_statistics, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, id long, block int"


def brute(rows, queries, k):
    def ints(v):
        return [math.floor(256 * float(np.float32(x))) for x in v]

    def ok(r):
        return r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])
    out = []
    cand = [(r[0], ints(r[1])) for r in rows if ok(r)]
    for q in filter(ok, queries):
        a = ints(q[1])
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in cand if i != q[0] and len(a) == len(b))[:k]
        out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=12).round(2)], 0, 5, 6) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0, 5, 6) for i in range(9)]  # ties
    rows += [(50, None, 0, 5, 6), (100, [1.0, None], 0, 5, 6), (150, [float("nan")] * 12, 0, 5, 6),
             (200, [float("inf")] * 12, 0, 5, 6), (None, [1.0] * 12, 0, 5, 6), (250, [], 0, 5, 6),
             (2000, [1.0, 2.0], 0, 5, 6), (2050, [3.0, 2.0], 0, 5, 6), rows[7]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for block_bytes, query_bytes in ((1 << 25, 1 << 20), (64 * 96, 3 * 96)):
        out = top_k(df, df.where("vec_id % 50 = 0"), block_bytes=block_bytes, query_bytes=query_bytes)
        assert sorted(map(tuple, out.collect())) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0], 5)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_k(df, df).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for d in (1, 3, 64, 70):
        a, b = rng.integers(-200, 200, (30, d)).astype(float), rng.integers(-200, 200, (40, d)).astype(float)
        for n in LEVELS:
            assert (segment_statistics(a, n) @ segment_statistics(b, n).T >= a @ b.T - 1e-6).all()


@pytest.mark.parametrize("size", [1e5, 1e8, 1e15, 1e160, 1e300, 4e307])
def test_large_components_are_exact(spark, size):
    rng = np.random.default_rng(int(np.log10(size)))
    rows = [(i, [float(x) for x in rng.normal(size=8) * size / 4]) for i in range(0, 400, 10)]
    rows += [(i, [float(x) for x in rng.normal(size=8)]) for i in range(1, 40, 10)]
    rows += [(50_000 + i, rows[3][1]) for i in range(3)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(df, df.where("vec_id % 50 = 0")).collect()))
    ints = {i: [math.floor(256 * Fraction(x)) for x in v] for i, v in rows}
    want = []
    for q in [i for i, _ in rows if i % 50 == 0]:
        found = sorted((-sum(x * y for x, y in zip(ints[q], ints[i])), i) for i in ints if i != q)[:5]
        want += [(q, n, i, max(min(-s, (1 << 63) - 1), -(1 << 63))) for n, (s, i) in enumerate(found, 1)]
    assert got == sorted(want)


def test_clustered_vectors_are_pruned():
    rng = np.random.default_rng(3)
    centre = rng.normal(scale=400, size=(60, 64)).round()
    c = np.floor(centre[rng.integers(0, 60, 8000)] + rng.normal(scale=20, size=(8000, 64)))
    q, ids, work = c[:40], np.arange(8000), {}
    at, i, s = block_top_k(ids[:40], q, ids, c, 5, work)
    score = q @ c.T
    score[np.arange(40), np.arange(40)] = -np.inf
    want = [sorted((-score[r, j], j) for j in range(8000))[:5] for r in range(40)]
    assert [(-x, j) for x, j in zip(s.tolist(), i.tolist())] == [(x, j) for w in want for x, j in w]
    assert work["exact"] < 0.2 * work["pairs"]
