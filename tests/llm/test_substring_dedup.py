import pytest

from riskframe.llm.substring_dedup import COVER, PERIOD, remove_repeats

from . import cases


def brute(rows, window):
    first = {}
    for doc_id, text, *_ in rows:
        w = cases.words(text)
        for j in range(len(w) - window + 1):
            key = tuple(w[j:j + window])
            first[key] = min(first.get(key, cases.LAST), cases.order(doc_id))
    out = []
    for doc_id, text, *_ in rows:
        w = cases.words(text)
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < cases.order(doc_id):
                gone |= set(range(j, j + window))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def test_cover_aligns_any_two_positions():
    for i in range(PERIOD):
        for j in range(PERIOD):
            assert any((i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER for d in range(PERIOD))


@pytest.mark.parametrize("chunk_bytes,bucket_bytes", [(1 << 22, 1 << 22), (3000, 2000), (200, 4000)])
def test_matches_brute_force(spark, chunk_bytes, bucket_bytes):
    rows = cases.documents()
    out = remove_repeats(cases.frame(spark, rows), chunk_bytes=chunk_bytes, bucket_bytes=bucket_bytes).collect()
    assert sorted(map(tuple, out), key=repr) == brute(rows, 13)
    assert any(r.n_removed for r in out)


def test_other_window_and_empty_table(spark):
    rows = cases.documents(30, 1)
    out = remove_repeats(cases.frame(spark, rows), window=8, chunk_bytes=2000).collect()
    assert sorted(map(tuple, out), key=repr) == brute(rows, 8)
    assert remove_repeats(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(cases.empty(spark), window=7)
