import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riskframe.llm import collocations as mod
from riskframe.llm.collocations import collocations, frequent_phrases, shard_of, shards
from riskframe.llm.common import prepare, utf8

from . import cases

SPLIT, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def pieces(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return [WORD.findall(p) for p in SPLIT.split(low)]


def counts(rows):
    f, n = {}, Counter()
    for r in rows:
        lang = r[2] or "und"
        for w in pieces(r[1]):
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    key = lang, tuple(w[i:i + m])
                    f[key] = f.get(key, 0) + 1
    return f, n


def brute(rows, least, top=2000):
    f, n = counts(rows)
    f = {k: a for k, a in f.items() if a >= least}
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(o == lang and len(q) > len(p) and b >= a and any(
            q[i:i + len(p)] == p for i in range(len(q))) for (o, q), b in f.items())
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def texts(n=300, seed=0):
    r = random.Random(seed)
    vocabulary = ["a", "B", "the", "of", "é", "x-y", "日本", "q's", " ", "z"]
    rows = cases.documents(40)
    for i in range(n):
        words = r.choices(vocabulary, [9, 5, 9, 7, 3, 2, 1, 1, 1, 1], k=r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(words))
            words[at:at] = ["once", "upon", "a", "time"]
        text = "".join(w + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "! "]) for w in words)
        rows.append((10000 + i, text, r.choice(["en", "en", "de", None, "und"]), None, 1, "c", 7, "z"))
    return rows


@pytest.mark.parametrize("shard_bytes", [1 << 24, 3000, 200])
def test_equals_brute_force(spark, shard_bytes):
    rows = texts()
    got = collocations(cases.frame(spark, rows), min_count=8, top=30, shard_bytes=shard_bytes, bits=1 << 17).collect()
    assert sorted(map(tuple, got)) == brute(rows, 8, 30)


def test_a_full_union_only_costs_work(spark):
    rows = texts(80, seed=1)
    parts = shards(cases.frame(spark, rows), shard_bytes=900)
    f, n = counts(rows)
    want = sorted((lang, " ".join(p), len(p), a, n[lang]) for (lang, p), a in f.items() if a >= 5)
    for bits in (1 << 15, 1 << 20):
        assert sorted(map(tuple, frequent_phrases(parts, 5, bits=bits).collect())) == want


def test_local_support_is_lowered_and_prunes(spark):
    rows = [(i, "p q. r s." if i % 2 else "p q. t u v.", "en", None, 1, "c", 7, "z") for i in range(400)]
    parts = shards(cases.frame(spark, rows), shard_bytes=1 << 20)
    assert parts.count() <= 3  # one a task: no shuffle
    found = {r.phrase: r.a for r in frequent_phrases(parts, 250).collect()}
    assert found == {"p": 400, "q": 400, "p q": 400}


def test_large_products_stay_exact(spark):
    big = 3_000_000_019
    frame = spark.createDataFrame([(big, big * 3001, big + 7, big + 9)], "a long, total long, l long, r long")
    got = frame.selectExpr("(CAST(a * 1000 AS DECIMAL(19, 0)) * CAST(total AS DECIMAL(19, 0))) div "
                           "(CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0))) AS s").first().s
    assert got == 1000 * big * big * 3001 // ((big + 7) * (big + 9))


def test_shard_keeps_pieces_apart():
    data, offsets = utf8(pa.array(["A b. a", "", " . ", "b\tC", "c"]))
    words, ids = shard_of(data, offsets)
    said = [None if i < 0 else words[i].as_py() for i in ids.tolist()]
    assert said == ["a", "b", None, "a", None, "b", "c", None, "c"]
    assert shard_of(np.zeros(0, np.uint8), np.zeros(1, np.int64))[1].size == 0


def test_empty_and_blank(spark):
    assert collocations(cases.empty(spark)).count() == 0
    blank = cases.frame(spark, [(1, " .\n", "en", None, 1, "c", 7, "z"), (2, None, None, None, 1, "c", 7, "z")])
    assert collocations(blank, min_count=1).count() == 0


class Held:
    def __init__(self, value):
        self.value = value


def all_words(n_words):
    union = mod.Union([], 1 << 15)
    union.bits[:] = 255  # holds every window
    words = pa.array([f"w{i}" for i in range(40)])
    ids = np.random.default_rng(0).integers(0, 40, n_words).astype(np.int32)
    row = pa.RecordBatch.from_pydict({
        "lang": pa.array(["en"]), "n_words": pa.array([n_words]), "total": pa.array([n_words]), "slack": pa.array([0]),
        "words": pa.array([mod._pressed(mod._listed(words))], pa.binary()), "ids": pa.array([mod._pressed(ids)], pa.binary())})
    return union, words, ids, row


def test_counting_a_shard_takes_few_bytes_a_word():
    union, words, ids, row = all_words(1 << 21)
    tracemalloc.start()
    try:
        out = pa.Table.from_batches(list(mod._counter(Held([union] * 3), 2)(iter([row]))))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 28 * len(ids)  # whole-shard sorts took 71
    exact = Counter(zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True))
    several = {r["phrase"]: r["n"] for r in out.to_pylist() if r["n_words"] == 2}
    assert several == {f"w{a} w{b}": n for (a, b), n in exact.items()}


def test_word_lists_survive_pressing():
    for said in (["a"], ["a", "é", "", "日本"], [""]):
        assert mod._unlisted(mod._unpressed(pa.py_buffer(mod._pressed(mod._listed(pa.array(said)))))).to_pylist() == said


def test_batches_for_python_are_bounded(spark):
    held = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(held)
    prepare(spark)
    assert int(spark.conf.get(held).rstrip("b")) <= 8 << 20
    spark.conf.set(held, "1048576b")
    prepare(spark)
    assert int(spark.conf.get(held).rstrip("b")) == 1 << 20  # a smaller one stays
    spark.conf.unset(held)
