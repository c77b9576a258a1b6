import hashlib
import re

from riskframe.llm.exact_dedup import DigestIndex, exact_dedup

from . import cases


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_matches_brute_force(spark):
    rows = cases.documents()
    groups = {}
    for r in rows:
        groups.setdefault(normal(r[1]), []).append(r)
    out = exact_dedup(cases.frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by_digest = {}
    for r in out:
        by_digest.setdefault(bytes(r.digest), []).append(r)
    assert len(by_digest) == len(groups)
    for text, members in groups.items():
        got = by_digest[hashlib.sha256(text.encode()).digest()]
        keep = min(members, key=lambda r: (-len(r[1] or ""), cases.order(r[0])))[0]
        assert sorted(map(str, (r.id for r in got))) == sorted(str(r[0]) for r in members)
        assert {r.keep_id for r in got} == {keep} and {r.group_size for r in got} == {len(members)}
        assert sum(r.kept for r in got) == 1 and [r.id for r in got if r.kept] == [keep]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_later_batches_meet_the_index(spark):
    index = DigestIndex(spark, buckets=3)
    first = index.add(frame(spark, [(5, "a b"), (9, "c"), (7, "e")])).collect()
    assert all(r.kept for r in first)
    more = index.add(frame(spark, [(1, "ab  "), (2, "d"), (3, "d "), (4, "c"), (8, "e")])).collect()
    # a longer text, or an equally long one with a smaller id, takes over from the earlier batch
    assert sorted((r.id, r.keep_id, r.kept) for r in more) == [
        (1, 1, True), (2, 3, False), (3, 3, True), (4, 4, True), (8, 7, False)]
    assert index.read().count() == 6 and index.best().count() == 4
    plan = index.read().join(index.read().select("digest").hint("merge"), "digest", "left_anti")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_another_session_opens_the_index_by_path(spark):
    index = DigestIndex(spark, buckets=5)
    index.add(frame(spark, [(5, "a b"), (9, "c")]))
    other = DigestIndex(spark.newSession(), index.path)
    assert (other.buckets, other.id_type, other.name != index.name) == (5, "long", True)
    got = other.add(other.spark.createDataFrame([(1, "ab"), (2, "new")], "doc_id long, text string")).collect()
    assert sorted((r.id, r.keep_id, r.kept) for r in got) == [(1, 5, False), (2, 2, True)]
    assert {(r.id, r.batch) for r in DigestIndex(spark, index.path).read().collect()} == {(5, 1), (9, 1), (2, 2)}
    plan = other.best()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_empty_table(spark):
    assert exact_dedup(cases.empty(spark)).count() == 0


def test_batches_of_one_call_meet_the_index(spark):
    rows = cases.documents() + [(9000 + i, f"same {' ' * (i % 7)}text", None, None, 1, "c", 7, "z") for i in range(40)]
    index = DigestIndex(spark, buckets=3)
    out = exact_dedup(cases.frame(spark, rows), index=index).collect()
    entries = index.read().collect()
    distinct = {normal(r[1]) for r in rows}
    assert {e.batch for e in entries} == {1, 2} and len({bytes(e.digest) for e in entries}) == len(distinct)
    # both batches hold copies of the text: the second batch's rows were dropped or replaced the first's entry
    shared = [e for e in entries if bytes(e.digest) == hashlib.sha256(b"sametext").digest()]
    assert len(shared) in (1, 2) and {r.keep_id for r in out if r.id is not None and r.id >= 9000} == {9006}
    assert sum(r.kept for r in out) == len(distinct) and len(out) == len(rows)
    again = exact_dedup(cases.frame(spark, rows), index=index, batches=1).collect()
    assert not any(r.kept for r in again) and index.read().count() == len(entries)
