import duckdb
import pytest

from riskframe.llm.mixing import mix_sources
from riskframe.llm.queries import SQL

from . import cases


@pytest.mark.parametrize("cell_rows", [50_000, 3])
def test_against_sql_on_awkward_rows(spark, cell_rows, tmp_path):
    rows = cases.documents(200, 2)
    df = cases.frame(spark, rows)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute("SELECT doc_id, size, source_size, target, taken FROM (" + SQL["op8_mixing"] + ")").fetchall()
    out = mix_sources(df, cell_rows=cell_rows)
    again = mix_sources(df.repartition(5), cell_rows=cell_rows)
    pick = lambda d: sorted((tuple(r) for r in d.select("id", "size", "source_size", "target", "taken").collect()), key=repr)
    assert pick(out) == sorted(want, key=repr) == pick(again)


def test_targets_are_met(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), None, "abc"[i % 3] if i % 2 else None, 0, "", 0, "")
            for i in range(3000)]
    out = mix_sources(cases.frame(spark, rows), keep=("source", "text")).toPandas()
    total = out["size"].sum()
    by = out.groupby(out.source_size).agg(target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - 1.5 * total) < 1e-6 * total
    assert ((by.taken - by.target).abs() <= 2 * 90).all()
    assert (out.taken <= 2 * out["size"]).all() and out.copies.max() <= 2
    assert (out.kept.map(lambda k: len(k["text"].split())) == out["size"]).all()


def test_empty_and_wordless(spark):
    assert mix_sources(cases.empty(spark)).count() == 0
    rows = [(1, None, None, "a", 0, "", 0, ""), (2, " ", None, None, 0, "", 0, "")]
    assert {(r.size, r.target, r.taken) for r in mix_sources(cases.frame(spark, rows)).collect()} == {(0, 0.0, 0)}
