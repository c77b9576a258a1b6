import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from riskframe.llm import common
from riskframe.llm import jaccard_join as jaccard
from riskframe.llm.graph import components
from riskframe.llm.jaccard_join import jaccard_join

from . import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = cases.words((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=90):
    sets = [shingles(r[1]) for r in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                comp[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), cases.LAST), cases.order(r[0]))
    return sorted(((r[0], len(sets[i]), (r[0] if not sets[i] else least[find(i)]) if (r[0] is not None or sets[i]) and
                    least[find(i)] != cases.LAST else None) for i, r in enumerate(rows)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("chunk_bytes,bucket_bytes", [(1 << 22, 1 << 22), (3000, 700), (500, 5000), (2000, 9000)])
def test_matches_brute_force(spark, chunk_bytes, bucket_bytes):
    rows = cases.documents()
    df = jaccard_join(cases.frame(spark, rows), chunk_bytes=chunk_bytes, bucket_bytes=bucket_bytes)
    assert got(df) == brute(rows)


def test_chains_of_copies_without_exact_ones(spark):
    """Neighbours link, ends do not; no exact copies anywhere, many buckets."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(24):
        base[(i * 29) % 400] = f"x{i}"
        rows.append((i * 7 % 24, " ".join(base), None, None, None, None, None, None))
    want = brute(rows)
    assert len({c for *_, c in want}) == 1
    assert got(jaccard_join(cases.frame(spark, rows), chunk_bytes=4000, bucket_bytes=1500)) == want


def test_empty_table(spark):
    assert jaccard_join(cases.empty(spark)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (7, 8), (5, 3), (4, 4)]
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert dict(map(tuple, out)) == {1: 1, 2: 1, 3: 1, 5: 1, 7: 7, 8: 7, 9: 7}


def test_span_hashes_do_not_depend_on_blocks():
    data = np.random.default_rng(1).integers(97, 123, 200_000).astype(np.uint8)
    start = np.array([0, 5, 65_530, 65_536, 131_071, 150_000, 199_990, 200_000])
    end = np.minimum(start + np.array([7, 0, 12, 70_000, 2, 9, 10, 0]), 200_000)
    got = common.span_hashes(data, start, end)
    alone = [common.span_hashes(data[s:e], np.array([0]), np.array([e - s]))[0] for s, e in zip(start, end, strict=True)]
    assert got.tolist() == alone
    value = sum(int(common._BYTE[b]) * pow(int(common._BASE), i, 1 << 64) for i, b in enumerate(data[:7].tolist())) + 7
    assert got[0] == common.mix(np.array([value % (1 << 64)], np.uint64))[0]


def test_fingerprints_hold_little_memory():
    words = [f"{w:x}" for w in np.random.default_rng(2).integers(0, 1 << 40, 400_000)]
    texts = [" ".join(words[i:i + 500]) for i in range(0, len(words), 500)]
    batch = pa.RecordBatch.from_pydict({"chunk": pa.array([0] * len(texts), pa.int32()),
                                        "id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    tracemalloc.start()
    rows = sum(b.num_rows for b in jaccard._fingerprints(5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 10 * sum(map(len, texts)), peak
