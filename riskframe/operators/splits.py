"""Exact, reproducible splits and folds.

Row order inside a stratum is ``md5(seed:tag:key)`` (ties broken by the key),
so results never depend on partitioning and any SQL engine can recompute them.

No single-partition window is used: rows are bucketed by the leading bits of
their hash (buckets follow hash order), per-bucket counts are prefix-summed in
a table of ``strata x 2^bits`` rows, and rows are sorted only inside a bucket.
A split needs even less: only the one bucket per stratum that straddles the
boundary is sorted; every other bucket is wholly train or wholly test.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.rules import hash_bucket, hash_key
from riskframe.operators.profile import null_safe_join

DEFAULT_BITS = 16
_H, _B = "__h", "__bucket"


def _with_hash(df: DataFrame, key: Sequence[str], seed: int, tag: str, bits: int) -> DataFrame:
    h = hash_key(seed, tag, key)
    return df.withColumn(_H, h).withColumn(_B, hash_bucket(F.col(_H), bits))


def _bucket_offsets(hashed: DataFrame, strata: Sequence[str]) -> DataFrame:
    """(strata..., bucket, cnt, offset, total): rows before each bucket in its stratum.

    The table has at most strata x 2^bits rows, independent of the row count.
    """
    counts = hashed.groupBy(*strata, _B).agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(*strata).orderBy(_B) if strata else Window.orderBy(_B)
    return counts.select(
        *strata, _B, "__cnt",
        F.coalesce(F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__tot"))


def exact_rank(df: DataFrame, key: Sequence[str], strata: Sequence[str] = (), seed: int = 42,
               tag: str = "rank", bits: int = DEFAULT_BITS, rank_col: str = "rank",
               total_col: str | None = None) -> DataFrame:
    """1-based rank of each row inside its stratum in hash order (plus stratum size)."""
    strata, key = list(strata), list(key)
    hashed = _with_hash(df, key, seed, tag, bits)
    offs = _bucket_offsets(hashed, strata)
    j = null_safe_join(hashed, offs, [*strata, _B])  # a NULL stratum is a stratum of its own
    w = Window.partitionBy(*strata, _B).orderBy(_H, *key)
    out = j.withColumn(rank_col, F.col("__off") + F.row_number().over(w))
    if total_col:
        out = out.withColumn(total_col, F.col("__tot"))
    return out.drop(_H, _B, "__cnt", "__off", "__tot")


def _n_first(total, fraction: float):
    """Rows taken by a fraction, rounded half up (integer-exact in any engine)."""
    return F.floor(total * F.lit(float(fraction)) + F.lit(0.5)).cast("bigint")


def flag_first(df: DataFrame, key: Sequence[str], n_first, strata: Sequence[str] = (), seed: int = 42,
               tag: str = "split", bits: int = DEFAULT_BITS, flag_col: str = "is_first") -> DataFrame:
    """Flag the first ``n_first(stratum_total)`` rows of each stratum in hash order.

    ``n_first`` is a function of the stratum-size column.  Only boundary
    buckets are sorted.
    """
    strata, key = list(strata), list(key)
    hashed = _with_hash(df, key, seed, tag, bits)
    offs = _bucket_offsets(hashed, strata).withColumn("__n", n_first(F.col("__tot")))
    j = null_safe_join(hashed, offs, [*strata, _B])  # a NULL stratum is a stratum of its own
    inside = F.col("__off") + F.col("__cnt") <= F.col("__n")
    outside = F.col("__off") >= F.col("__n")
    settled = j.where(inside | outside).withColumn(flag_col, inside.cast("int"))
    w = Window.partitionBy(*strata, _B).orderBy(_H, *key)
    edge = j.where(~(inside | outside)).withColumn(
        flag_col, ((F.col("__off") + F.row_number().over(w)) <= F.col("__n")).cast("int"))
    return settled.unionByName(edge).drop(_H, _B, "__cnt", "__off", "__tot", "__n")


def split_stratified(df: DataFrame, key: Sequence[str], label: str = "label", test_size: float = 0.2,
                     seed: int = 42, bits: int = DEFAULT_BITS, flag_col: str = "is_test") -> DataFrame:
    """Per class, the first round(n_c * test_size) rows in hash order are test."""
    return flag_first(df, key, lambda t: _n_first(t, test_size), [label], seed, "split", bits, flag_col)


def split_holdout(df: DataFrame, key: Sequence[str], test_size: float = 0.1, seed: int = 42,
                  bits: int = DEFAULT_BITS, flag_col: str = "is_holdout") -> DataFrame:
    """Unstratified exact hold-out of round(n * test_size) rows."""
    return flag_first(df, key, lambda t: _n_first(t, test_size), [], seed, "holdout", bits, flag_col)


def train_test(flagged: DataFrame, flag_col: str = "is_test") -> tuple[DataFrame, DataFrame]:
    return (flagged.where(F.col(flag_col) == 0).drop(flag_col),
            flagged.where(F.col(flag_col) == 1).drop(flag_col))


def folds_stratified(df: DataFrame, key: Sequence[str], label: str = "label", k: int = 10,
                     seed: int = 42, bits: int = DEFAULT_BITS, fold_col: str = "fold") -> DataFrame:
    """fold = (rank in class - 1) mod k: class balance is exact in every fold.

    The column can be fed to ``CrossValidator(foldCol=...)``.
    """
    ranked = exact_rank(df, key, [label], seed, "fold", bits, "__rank")
    return ranked.withColumn(fold_col, ((F.col("__rank") - 1) % k).cast("int")).drop("__rank")


def split_by_class(df: DataFrame, label: str = "label", positive=1) -> tuple[DataFrame, DataFrame]:
    """(positives, the rest)."""
    is_pos = F.coalesce(F.col(label) == positive, F.lit(False))
    return df.where(is_pos), df.where(~is_pos)


def class_roles(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, count, is_majority) for a binary label; equal sizes -> class 0 is the majority."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    pos = F.coalesce(F.col(label) == 1, F.lit(False))
    w = Window.orderBy(F.col("count").desc(), pos.cast("int"))
    return counts.withColumn("is_majority", (F.row_number().over(w) == 1).cast("int"))


def split_majority(df: DataFrame, label: str = "label") -> DataFrame:
    """P5: tag rows with ``is_majority`` from the class table."""
    return null_safe_join(df, class_roles(df, label).select(label, "is_majority"), [label])
