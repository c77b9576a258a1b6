"""Sources and sinks (S1-S7): multi-cycle load, linkage, projections, writes."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.rules import nan_to_null
from riskframe.session import shared_path


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | str | None = None, **options) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def union_cycles(frames: Mapping[int, DataFrame], cycle_col: str = "SDDSRVYR") -> DataFrame:
    """Stack per-cycle tables whose column sets differ.

    Columns absent from a cycle become NULL; the cycle number is added as a
    column (a good partition column when the result is stored).
    """
    tagged = [df.withColumn(cycle_col, F.lit(int(c))) for c, df in sorted(frames.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_cycles(spark: SparkSession, paths: Mapping[int, str], fmt: str = "parquet",
                cycle_col: str = "SDDSRVYR", **options) -> DataFrame:
    """S1 from files: one path per cycle, NaN turned into NULL at ingest."""
    frames = {c: nan_to_null(read_table(spark, p, fmt, **options)) for c, p in paths.items()}
    return union_cycles(frames, cycle_col)


def link_mortality(survey: DataFrame, mortality: DataFrame, key: str | Sequence[str],
                   how: str = "left") -> DataFrame:
    """Person <-> death-record equi join.

    No broadcast hint: the mortality table grows with the survey, so the
    choice between broadcast and sort-merge is left to Spark's size check
    (autoBroadcastJoinThreshold, re-planned at runtime by AQE).
    """
    keys = [key] if isinstance(key, str) else list(key)
    return survey.join(mortality, on=keys, how=how)


_STRINGY = (T.StringType, T.BinaryType, T.VarcharType, T.CharType)


def numeric_only(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """S3: drop string-typed columns (schema-only, no job)."""
    cols = [f.name for f in df.schema.fields
            if f.name in keep or not isinstance(f.dataType, _STRINGY)]
    return df.select(*cols)


def schema_table(df: DataFrame) -> DataFrame:
    """(column_name, data_type, ordinal) of a DataFrame's schema."""
    rows = [(f.name, f.dataType.simpleString(), i + 1) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, data_type string, ordinal int")


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> str:
    """Result sink. CSV gets a header; parquet keeps types."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    return path


def sink_and_reload(df: DataFrame, name: str, fmt: str = "csv") -> DataFrame:
    """Write ``df`` under the shared folder and read it back with its schema."""
    spark = df.sparkSession
    path = write_table(df, shared_path(spark, name), fmt)
    reader = spark.read.format(fmt).schema(df.schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def write_results(tables: dict[str, DataFrame], base: str, fmt: str = "csv") -> str:
    """A result folder.  Every table is written aside, under a new name, then one manifest publishes them all.

    The manifest (table, path, schema, rows) is written last: readers see the
    tables of one run or none, and a run that ends early leaves no manifest.
    Returns the manifest's path.
    """
    run, rows = uuid.uuid4().hex, []
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        path = write_table(df, f"{base.rstrip('/')}/{name}-{run}", fmt)
        rows.append((name, path, df.schema.json(), _reload(spark, path, df.schema, fmt).count(), fmt))
    if spark is None:
        raise ValueError("write_results: no tables")
    manifest = f"{base.rstrip('/')}/manifest-{run}"
    spark.createDataFrame(rows, "table string, path string, schema string, rows bigint, format string").coalesce(1) \
        .write.json(manifest)
    return manifest


def read_results(spark: SparkSession, manifest: str) -> dict[str, DataFrame]:
    """The tables that a manifest of :func:`write_results` names; a table that lost rows is an error."""
    out = {}
    for r in spark.read.schema("table string, path string, schema string, rows bigint, format string") \
            .json(manifest).collect():  # one row per table
        df = _reload(spark, r["path"], T.StructType.fromJson(json.loads(r["schema"])), r["format"])
        if df.count() != r["rows"]:
            raise ValueError(f"{r['table']}: the manifest has {r['rows']} rows")
        out[r["table"]] = df
    return out


def _reload(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.format(fmt).schema(schema)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


@dataclass(frozen=True)
class Field:
    name: str
    start: int      # 1-based
    length: int
    dtype: str = "string"


def parse_fixed_width(lines: DataFrame, layout: Sequence[Field], value_col: str = "value") -> DataFrame:
    """Cut fixed-width records into typed columns; blank fields -> NULL."""
    exprs = []
    for f in layout:
        raw = F.trim(F.substring(F.col(value_col), f.start, f.length))
        raw = F.when(raw == "", F.lit(None)).otherwise(raw)
        exprs.append((raw if f.dtype == "string" else raw.cast(f.dtype)).alias(f.name))
    return lines.select(*exprs)


def read_fixed_width(spark: SparkSession, path: str, layout: Sequence[Field]) -> DataFrame:
    return parse_fixed_width(spark.read.text(path), layout)


def to_fixed_width(df: DataFrame, layout: Sequence[Field]) -> DataFrame:
    """Inverse of :func:`parse_fixed_width` (numbers right-, text left-aligned).

    A value that is longer than its field is an error: cut, it would read back as another value.
    """
    parts = []
    for f in layout:
        s = F.coalesce(F.col(f.name).cast("string"), F.lit(""))
        s = F.when(F.char_length(s) > f.length, F.raise_error(F.concat(
            F.lit(f"field {f.name} has {f.length} places; too long: "), s)).cast("string")).otherwise(s)
        parts.append(F.rpad(s, f.length, " ") if f.dtype == "string" else F.lpad(s, f.length, " "))
    return df.select(F.concat(*parts).alias("value"))


class Timer:
    """Wall time of a block as a one-row table ``(name, seconds)``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.seconds = None

    def __enter__(self):
        self._t0 = time.perf_counter()
        return self

    def __exit__(self, *exc):
        self.seconds = time.perf_counter() - self._t0
        return False

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([(self.name, float(self.seconds))], "name string, seconds double")
