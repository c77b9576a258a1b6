"""Row-wise predicates and scalar helpers, all plain Catalyst expressions.

Missing-value semantics follow the survey tables the engine was built for:
a missing answer never satisfies ``==``, ``<``, ``>``, ``<=`` or ``>=`` (it is a
negative), and always satisfies ``!=``.  NaN is turned into NULL at ingest
(:func:`nan_to_null`), because Spark orders NaN above every number.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_true(cond: Column) -> Column:
    """NULL-safe truth: NULL counts as False."""
    return F.coalesce(cond, F.lit(False))


_OPS = {
    "==": lambda c, v: c == v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}


@dataclass(frozen=True)
class Rule:
    """``column <op> value`` with survey missing-value semantics."""

    column: str
    op: str
    value: Any

    def to_column(self) -> Column:
        c = F.col(self.column)
        if self.op == "!=":
            return ~c.eqNullSafe(F.lit(self.value))
        if self.op == "in":
            return is_true(c.isin(list(self.value)))
        if self.op not in _OPS:
            raise ValueError(f"unknown operator {self.op!r}")
        return is_true(_OPS[self.op](c, F.lit(self.value)))


def as_column(r: Rule | Column) -> Column:
    return r.to_column() if isinstance(r, Rule) else is_true(r)


def any_of(rules: Sequence[Rule | Column]) -> Column:
    return reduce(lambda a, b: a | b, [as_column(r) for r in rules])


def all_of(rules: Sequence[Rule | Column]) -> Column:
    return reduce(lambda a, b: a & b, [as_column(r) for r in rules])


def flag_count(rules: Sequence[Rule | Column]) -> Column:
    """Number of satisfied flags per row (each flag NULL-guarded)."""
    return reduce(lambda a, b: a + b, [as_column(r).cast("int") for r in rules])


def row_mean(cols: Sequence[str | Column]) -> Column:
    """Mean over the non-missing values of a row; NULL when all are missing."""
    cs = [col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cs])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cs])
    return total / F.nullif(n, F.lit(0))


def yes_no(c: str | Column) -> Column:
    """Questionnaire code 1 -> 1 (yes), 2 -> 0 (no), anything else -> NULL."""
    c = col(c)
    return F.when(c == 1, F.lit(1)).when(c == 2, F.lit(0))


def decode(c: str | Column, codes: Mapping[int, str], missing_code: int) -> Column:
    """Decode an integer code to its name.

    Missing values take ``missing_code``; a code outside ``codes`` fails the
    job (a silent NULL would hide bad input).
    """
    code = decoded_code(c, codes, missing_code)
    lookup = F.create_map(*[x for k, v in sorted(codes.items()) for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(lookup, code)


def decoded_code(c: str | Column, codes: Mapping[int, str], missing_code: int) -> Column:
    """The validated integer code (missing -> ``missing_code``, unknown -> error)."""
    code = F.coalesce(col(c).cast("int"), F.lit(missing_code))
    known = code.isin(list(codes))
    return F.when(~known, F.raise_error(F.concat(F.lit("unknown code "), code.cast("string")))) \
        .otherwise(code)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Ingest rule: NaN in floating columns becomes NULL."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            exprs.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


# ---- deterministic pseudo-randomness ----------------------------------------
# Every random choice is a function of (seed, operator, key), never rand(), so a
# result does not depend on partitioning and can be recomputed after a failure.

def hash_key(seed: int | str, tag: str, key_cols: Sequence[str | Column], *extra: Column) -> Column:
    """md5 hex of ``seed:tag:key...[:extra...]`` (same bytes in any SQL engine)."""
    parts = [F.lit(str(seed)), F.lit(tag)] + [col(k).cast("string") for k in key_cols] + \
        [e.cast("string") for e in extra]
    return F.md5(F.concat_ws(":", *parts))


def hash_unit(h: Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of an md5 hex string."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_bucket(h: Column, bits: int) -> Column:
    """Leading ``bits`` bits of an md5 hex string (buckets preserve hash order)."""
    hex_chars = (bits + 3) // 4
    v = F.conv(F.substring(h, 1, hex_chars), 16, 10).cast("bigint")
    return F.shiftright(v, hex_chars * 4 - bits)


def key_struct(key_cols: Iterable[str]) -> Column:
    return F.struct(*[F.col(k) for k in key_cols])
