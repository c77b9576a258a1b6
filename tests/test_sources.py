import math

from pyspark.sql import functions as F

from riskframe.session import shared_path
from riskframe.sources import io


def test_union_cycles_missing_columns(spark):
    a = spark.createDataFrame([(1, 2.0)], "id bigint, x double")
    b = spark.createDataFrame([(2, "z")], "id bigint, s string")
    u = io.union_cycles({9: a, 10: b}, "cycle").orderBy("id").collect()
    assert (u[0].cycle, u[0].x, u[0].s) == (9, 2.0, None)
    assert (u[1].cycle, u[1].x, u[1].s) == (10, None, "z")


def test_read_cycles_nan_to_null(spark):
    p = shared_path(spark, "cycle_test")
    spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id bigint, v double").write.parquet(p)
    df = io.read_cycles(spark, {1: p})
    vals = {r.id: r.v for r in df.collect()}
    assert vals[1] is None and vals[2] == 3.0


def test_fixed_width_roundtrip_and_blanks(spark):
    layout = [io.Field("id", 1, 4, "int"), io.Field("name", 5, 6, "string"), io.Field("v", 11, 5, "double")]
    df = spark.createDataFrame([(1, "ab", 2.5), (22, None, None)], "id int, name string, v double")
    lines = io.to_fixed_width(df, layout)
    assert [len(r.value) for r in lines.collect()] == [15, 15]
    back = io.parse_fixed_width(lines, layout).orderBy("id").collect()
    assert (back[0].id, back[0].name, back[0].v) == (1, "ab", 2.5)
    assert (back[1].id, back[1].name, back[1].v) == (22, None, None)


def test_numeric_only_and_schema_table(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "id bigint, s string, x double")
    assert io.numeric_only(df).columns == ["id", "x"]
    rows = io.schema_table(df).collect()
    assert [(r.column_name, r.data_type, r.ordinal) for r in rows] == [("id", "bigint", 1), ("s", "string", 2),
                                                                      ("x", "double", 3)]


def test_sink_roundtrip(spark):
    df = spark.createDataFrame([(0, 5), (1, 2)], "label int, count bigint")
    back = io.sink_and_reload(df, "sink_test", "csv")
    assert sorted(map(tuple, back.collect())) == [(0, 5), (1, 2)]


def test_timer(spark):
    with io.Timer(spark, "x") as t:
        pass
    r = t.table().collect()[0]
    assert r.name == "x" and r.seconds >= 0


def test_result_folder_round_trips_by_its_manifest(spark, tmp_path):
    import pytest
    from riskframe.operators import profile
    from riskframe.sources.io import Timer
    rows = [(i, float(i) / 3 if i % 4 else None, i * 1e9, i % 2, "a,\"b\"" if i % 3 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, label int, note string")
    with Timer(spark, "run") as timer:
        tables = {"describe": profile.describe(df, ["x", "y"]), "counts": profile.value_counts(df, "label"),
                  "types": io.schema_table(df), "correlation": profile.correlation(df, ["x", "y"], "label"), "rows": df}
    tables["elapsed"] = timer.table()
    first = io.write_results(tables, str(tmp_path / "results"))
    again = io.read_results(spark, first)
    assert again.keys() == tables.keys()
    for name, table in tables.items():
        assert again[name].schema.simpleString() == table.schema.simpleString()
        assert sorted(map(repr, again[name].collect())) == sorted(map(repr, table.collect())), name
    # a second run leaves the first one readable, and lost files are noticed
    io.write_results({"counts": tables["counts"].limit(1)}, str(tmp_path / "results"))
    assert io.read_results(spark, first)["counts"].count() == 2
    import pathlib
    for f in pathlib.Path(again["counts"].inputFiles()[0].removeprefix("file://")).parent.glob("part-*"):
        f.write_text("")
    with pytest.raises(ValueError):
        io.read_results(spark, first)
