import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from riskframe.llm import language_id as lid
from riskframe.llm import quality
from riskframe.llm.queries import QUERIES

from . import cases

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    out = QUERIES["op9_language_id"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    assert len(out) == len(docs)
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    held = out[out.held_out].merge(docs, on="doc_id")
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert out.score.between(0, 1).all()
    assert -np.log(held.score.where(held.lang == held.lang_pred, 1 - held.score).clip(1e-9)).mean() < 0.1


def test_language_awkward_rows(spark):
    rows = cases.documents()
    df = cases.frame(spark, rows)
    model = lid.fit(df, ~lid.held_out())
    out = lid.predict(df, model).collect()
    assert len(out) == len(rows) and set(model.languages) == {"en", "de"}
    for r in out:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
        assert r.chunk == (None if r.n_chars is None else "c")  # other columns pass
    assert lid.predict(cases.empty(spark), model).count() == 0
    nothing = lid.fit(cases.empty(spark), ~lid.held_out())
    assert {r.lang_pred for r in lid.predict(df, nothing).collect()} == {"und"}


def test_ngrams_match_a_plain_count():
    import pyarrow as pa
    grams, doc, letters = lid.ngrams(pa.array(["Ab, c", None, "--", "É"]))
    assert letters.tolist() == [True, False, False, True]
    assert np.bincount(doc, minlength=4).tolist() == [5, 0, 0, 0]  # ab b_ _c + ab_ b_c
    same, _, _ = lid.ngrams(pa.array(["ab c"]))
    assert sorted(grams) == sorted(same)


def test_elastic_net_makes_weights_sparse():
    rng = np.random.default_rng(0)
    samples = []
    for _ in range(300):
        y = int(rng.integers(2))
        at = np.array([y, *rng.choice(np.arange(10, 400), 20, replace=False), lid.BUCKETS])
        samples.append((at, np.append(np.full(21, 0.5), 1.0), y))
    dense, _ = lid.train_ftrl(samples, 2, l1=0.0)
    w, _ = lid.train_ftrl(samples, 2, l1=1.0)
    assert (w != 0).sum() < (dense != 0).sum() / 2
    assert w[0, 0] > 0.1 and w[1, 1] > 0.1


def test_temperature_recovers_scale():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=p) for p in lid.softmax(logits)])
    assert lid.fit_temperature(5 * logits, y) == pytest.approx(5, rel=0.15)


def test_quality_held_out(spark):
    out = QUERIES["op10_quality"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    held = out[out.held_out].merge(labels, on="doc_id")
    rank, ones = held.score.rank(), held.quality.sum()
    auc = (rank[held.quality == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(held) - ones))
    assert auc > 0.95 and (held.predicted == held.quality).mean() > 0.95
    assert ((out.score >= 0.5) == (out.predicted == 1)).all() and out.score.between(0, 1).all()


def test_quality_votes_match_brute_force(spark):
    rows = cases.documents()
    df = cases.frame(spark, rows)
    labels = spark.createDataFrame([(i * 3, i % 2) for i in range(40)] + [(None, 1), (3, None), (6, 5), (0, 0)],
                                   "doc_id long, quality int")
    model = quality.fit(df, labels, lid.held_out(parts=1, part=0))  # every row with an id
    out = quality.score(df, model).collect()
    assert len(out) == len(rows)
    import pyarrow as pa
    for r in out:
        v = model.project(pa.array([r.text]))[0].astype(float)
        near = sorted(((float(v @ w), float(y)) for w, y in zip(model.vectors.astype(float), model.labels)), reverse=True)
        best = [(max(c, 0.0) ** model.sharpness, y) for c, y in near[:model.k]]
        want = ((sum(w * y for w, y in best) + model.prior * model.share) / (sum(w for w, _ in best) + model.prior))
        assert r.score == pytest.approx(want, abs=2e-2)
    assert {r.score for r in out if not cases.words(r.text)} == {model.share}
    assert quality.score(cases.empty(spark), model).count() == 0
    none = quality.fit(df, labels.limit(0), lid.held_out(parts=1, part=0))
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}


def test_long_texts_are_counted_piece_by_piece(spark, monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("ab é.  ÜЖ日—1"), 4000))
    grams, _, letters = lid.ngrams(pa.array([text]))
    want = np.bincount(grams, minlength=lid.BUCKETS)
    for size in (7, 64, 1000):
        monkeypatch.setattr(lid, "RUN_BYTES", size)
        got, lettered = lid.long_counts(pa.array([text]))
        assert (got == want).all() and lettered == letters[0]
        assert lid.long_counts(pa.array(["--- 12" * 30]))[1] is False
    model = lid.Model(["a", "b"], rng.normal(size=(lid.BUCKETS, 2)), np.array([0.1, 0.2]), 0.7)
    for a, b in zip(model.scores(pa.array([text])), model.long_score(pa.array([text]))):
        assert np.allclose(a, b)


def plain_grams(text):
    """Counts of hashed 2- and 3-grams, symbol by symbol."""
    import pyarrow as pa
    seq = []
    for ch in text or "":
        if ch.isalpha():
            seq.append(ch.lower() if len(ch.lower()) == 1 else ch)
        elif seq and seq[-1] != " ":
            seq.append(" ")
    out = {}
    for n in (2, 3):
        for i in range(len(seq) - n + 1):
            key = 0
            for ch in seq[i:i + n]:
                key = key << 21 | (0 if ch == " " else ord(ch))
            h = int(lid.mix(np.array([key + n], np.uint64))[0]) >> (64 - lid.BITS)
            out[h] = out.get(h, 0) + 1
    return out


def test_frequencies_and_scores_equal_plain_formulas(spark):
    texts = ["Das ist ein Haus", "the house", "la casa es", None, "--", "Haus haus HAUS", "é è"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    idf = lid.inverse_frequencies(docs.where("text is not null"))
    counts = [plain_grams(t) for t in texts if t is not None]
    for h in {h for c in counts for h in c}:
        assert idf[h] == pytest.approx(np.log((1 + len(counts)) / (1 + sum(h in c for c in counts))))
    rng = np.random.default_rng(0)
    model = lid.Model(["x", "y", "z"], rng.normal(size=(lid.BUCKETS, 3)), rng.normal(size=3), 0.5)
    for r in lid.predict(docs, model).collect():
        c = plain_grams(r.text)
        if not any(ch.isalpha() for ch in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        n = sum(c.values())
        z = [(model.bias[k] + sum(m * model.weights[h, k] for h, m in c.items()) / max(n, 1)) / 0.5 for k in range(3)]
        p = np.exp(z) / np.exp(z).sum()
        assert r.lang_pred == "xyz"[int(p.argmax())] and r.score == pytest.approx(p.max())


def test_one_epoch_of_ftrl_equals_plain_steps():
    rng = np.random.default_rng(1)
    samples = [(np.append(rng.choice(50, 6, replace=False), lid.BUCKETS), np.append(rng.random(6), 1.0), int(y))
               for y in rng.integers(0, 3, 40)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.05
    z, n = {}, {}

    def weight(f, k):
        zz = z.get((f, k), 0.0)
        if abs(zz) <= l1:
            return 0.0
        return -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n.get((f, k), 0.0))) / alpha + l2)
    for i in np.random.default_rng(0).permutation(40):
        at, x, y = samples[i]
        w = {(f, k): weight(f, k) for f in at.tolist() for k in range(3)}
        score = np.array([sum(v * w[f, k] for f, v in zip(at.tolist(), x)) for k in range(3)])
        p = np.exp(score - score.max())
        p /= p.sum()
        for f, v in zip(at.tolist(), x):
            for k in range(3):
                g = v * (p[k] - (k == y))
                old = n.get((f, k), 0.0)
                z[f, k] = z.get((f, k), 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w[f, k]
                n[f, k] = old + g * g
    w, bias = lid.train_ftrl(samples, 3, epochs=1)
    for f in range(50):
        assert w[f] == pytest.approx([weight(f, k) for k in range(3)])
    assert bias == pytest.approx([weight(lid.BUCKETS, k) for k in range(3)])


def test_short_texts_are_counted_in_small_slices():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["the quick brown fox, " * 100] * 1000)})
    list(lid._presence(iter([batch.slice(0, 1)])))  # tables that stay
    tracemalloc.start()
    try:
        out = list(lid._presence(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out[0]["docs"][0].as_py() == 1000
    assert peak < 60 << 20  # slices of 1 MB took 162 MB
