import random
from collections import Counter
from pathlib import Path

import corpus_pipeline as pipeline
from riskframe.llm.mixing import mix_sources
from riskframe.session import ensure_checkpoint_dir

from . import cases
from .test_exact_dedup import normal
from .test_jaccard_join import LOWER, brute


def run(spark, name, rows):
    stage = dict(pipeline.STAGES)[name]
    docs = cases.frame(spark, rows)
    out = stage(spark, docs, "")
    assert name == "packing" or out.columns == docs.columns
    return [tuple(r) for r in out.collect()]


def test_order_and_shape():
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mixing", "packing"]


def test_stages_on_awkward_rows(spark):
    rows = cases.documents()
    kept = run(spark, "language_id", rows)
    assert all(any(c.isalpha() for c in r[1]) for r in kept) and set(kept) <= set(rows)
    lone = run(spark, "exact_dedup", rows)
    assert sorted(normal(r[1]) for r in lone) == sorted({normal(r[1]) for r in rows}) and set(lone) <= set(rows)
    near = run(spark, "jaccard_join", rows)
    heads = {c for _, n, c in brute(rows) if n}
    assert heads <= {r[0] for r in near} and set(near) <= set(rows)
    assert sum(bool(cases.words(r[1])) for r in near) == len(heads)
    mixed = run(spark, "mixing", rows)
    assert set(mixed) <= set(rows) and max(mixed.count(r) - rows.count(r) for r in set(mixed)) <= 1 + 1
    assert len(run(spark, "packing", rows)) >= len(rows)


def test_run_small(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0 < out.select("doc_id").distinct().count() <= docs.count()
    assert out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


def test_empty(spark):
    for name, stage in pipeline.STAGES:
        assert stage(spark, cases.empty(spark), "").count() == 0, name


def near_heads(rows, size, percent):
    """Rows that stay: of each component of near copies the one with the smallest id."""
    sets = []
    for r in rows:
        w = cases.words((r[1] or "").translate(LOWER))
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= percent * len(a | b) and comp[i] != comp[j]:
                comp = [comp[j] if c == comp[i] else c for c in comp]
    return {min(r[0] for r, c in zip(rows, comp, strict=True) if c == k) for k in comp}


def test_near_copies_are_of_five_words_and_four_fifths(spark):
    rows = [r for r in cases.documents() if r[0] is not None and cases.words(r[1])]
    rows = [r for i, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:i]}]
    base = [f"w{i}" for i in range(200)]
    edited = ["x" if i in (20, 70, 120, 170) else w for i, w in enumerate(base)]
    texts = [base, edited, base + [f"y{i}" for i in range(28)], ["z" if i % 35 == 20 else w for i, w in enumerate(base)]]
    rows += [(1000 + i, " ".join(t), "en", "s1", 1, "c", 7, "z") for i, t in enumerate(texts)]
    got = {r[0] for r in run(spark, "jaccard_join", rows)}
    assert got == near_heads(rows, 5, 80) != near_heads(rows, 3, 90)
    assert {1000, 1003} == {i for i in got if i >= 1000}


def test_copies_go_where_an_id_repeats(spark):
    rest = ("en", "s1", 1, "c", 7, "z")
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a b", *rest), (1, "ab", *rest), (2, "c", *rest), (3, "c ", *rest), (3, "d", *rest), (2, "e", *rest),
            (None, "f", *rest), (None, "f", *rest)]
    assert sorted((r[1] for r in run(spark, "exact_dedup", rows))) == ["a b", "c ", "d", "e", "f"]
    rows = [(1, base, *rest), (1, base + " x", *rest), (5, "other", *rest), (7, "other", *rest), (7, "third", *rest),
            (None, None, *rest), (None, None, *rest), (8, "", *rest), (9, "", *rest)]
    near = run(spark, "jaccard_join", rows)
    assert len(near) == 6 and sum(r[0] == 1 for r in near) == 1
    assert {(r[0], r[1]) for r in near if r[0] != 1} == {(5, "other"), (7, "third"), (None, None), (8, ""), (9, "")}


def stored(spark, rows, at, files=3):
    cases.frame(spark, rows).repartition(files).write.parquet(str(at))
    return spark.read.parquet(str(at))


def test_stages_on_stored_rows_write_no_texts_again(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(f"{r.getrandbits(40):x}" for _ in range(150)), "en", f"s{i % 3}", 1, "c", 7, "z") for i in range(400)]
    rows += [(1000 + i, rows[i][1], *rows[i][2:]) for i in range(20)]
    docs = stored(spark, rows, tmp_path / "docs")
    size = sum(p.stat().st_size for p in (tmp_path / "docs").rglob("*.parquet"))
    shared = Path(spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark).removeprefix("file:"))
    roots = {shared, shared.parent}
    held = lambda: {p: p.stat().st_size for root in roots for p in root.glob("**/riskframe-*/**/*.parquet")}
    for name in ("exact_dedup", "jaccard_join", "mixing"):
        before = held()
        out = dict(pipeline.STAGES)[name](spark, docs, "")
        got = Counter(map(tuple, out.collect()))
        wrote = sum(v for p, v in held().items() if p not in before)
        assert 0 < wrote < size / 4, (name, wrote, size)
        if name != "mixing":
            assert got == Counter(rows[:400])
        else:
            assert set(got) <= set(rows) and max(got.values()) <= 2
            mixed = mix_sources(cases.frame(spark, rows)).collect()
            assert {r[0]: n for r, n in got.items()} == {r.id: r.copies for r in mixed if r.copies}


def test_stages_take_stored_rows_as_others(spark, tmp_path):
    rows = cases.documents()
    docs = stored(spark, rows, tmp_path / "a b%20c" / "docs")
    assert pipeline._places(docs)
    for name in ("exact_dedup", "mixing"):
        stage = dict(pipeline.STAGES)[name]
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert Counter(map(tuple, out.collect())) == Counter(run(spark, name, rows)), name


def test_rows_that_are_no_whole_files_are_written(spark, tmp_path):
    rows = [r for r in cases.documents() if r[0] is not None]
    docs = stored(spark, rows, tmp_path / "docs")
    none = docs.limit(0)
    twice = docs.union(docs)
    joined = docs.join(spark.range(2).withColumnRenamed("id", "n"))
    for some in (docs.where("doc_id > 30"), docs.limit(40), none, twice, joined, docs.sample(0.5, 1), cases.frame(spark, rows)):
        assert pipeline._places(some) is None
    few = Counter(r for r in rows if r[0] > 30)
    numbered, row = pipeline._numbered(docs.where("doc_id > 30"))
    assert Counter(map(tuple, numbered.drop(row).collect())) == few
    assert numbered.select(row).distinct().count() == few.total()


def test_row_numbers_of_files_are_distinct(spark, tmp_path):
    rows = cases.documents() + [cases.documents()[0]] * 5
    numbered, row = pipeline._numbered(stored(spark, rows, tmp_path / "docs", 7))
    got = numbered.collect()
    assert len({r[row] for r in got}) == len(got) == len(rows)
    assert Counter(tuple(r)[:-1] for r in got) == Counter(rows)
    again = {r[row]: tuple(r) for r in numbered.repartition(5).collect()}
    assert again == {r[row]: tuple(r) for r in got}
