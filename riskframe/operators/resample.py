"""Class rebalancing (R1-R6): fit-time only steps, deterministic by hash.

Each sampler is a function ``DataFrame -> DataFrame`` over (key..., label,
features/vec).  Class sizes come from one grouped count (two rows); every
random choice is ``md5(seed:tag:key[:copy])``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.rules import hash_key, hash_unit
from riskframe.operators.knn import knn_join
from riskframe.operators.splits import class_roles, exact_rank, flag_first
from riskframe.session import cut_lineage


def roles(df: DataFrame, label: str = "label") -> tuple[int, int, int, int]:
    """(majority label, majority size, minority label, minority size) from a <=2-row table."""
    rows = class_roles(df, label).collect()
    maj = next(r for r in rows if r.is_majority == 1)
    mins = [r for r in rows if r.is_majority == 0]
    if not mins:
        return maj[label], maj["count"], 1 - maj[label], 0
    return maj[label], maj["count"], mins[0][label], mins[0]["count"]


def under_random(df: DataFrame, key: Sequence[str], label: str = "label", seed: int = 42) -> DataFrame:
    """Keep the first n_minority majority rows in hash order, all minority rows."""
    maj, n_maj, mino, n_min = roles(df, label)
    flagged = flag_first(df.where(F.col(label) == maj), key, lambda t: F.lit(n_min).cast("bigint"),
                         [], seed, "under", flag_col="__keep")
    return flagged.where("__keep = 1").drop("__keep").unionByName(df.where(F.col(label) != maj))


def _copies(n_syn: int, n_min: int):
    base, rem = divmod(n_syn, n_min) if n_min else (0, 0)
    return base, rem


def over_random(df: DataFrame, key: Sequence[str], label: str = "label", seed: int = 42) -> DataFrame:
    """R2: minority rows replicated to the majority size.

    Every minority row gets floor(M/m) copies; the remaining M mod m copies go
    to the first rows in hash order.  Adds ``copy`` (1-based; originals = 1).
    """
    maj, n_maj, mino, n_min = roles(df, label)
    base, rem = _copies(n_maj, n_min)
    m = exact_rank(df.where(F.col(label) == mino), key, [], seed, "over", rank_col="__r")
    n = F.lit(base) + (F.col("__r") <= rem).cast("int")
    rep = m.withColumn("copy", F.explode(F.sequence(F.lit(1), n))).where(n > 0).drop("__r")
    return df.where(F.col(label) != mino).withColumn("copy", F.lit(1)).unionByName(rep)


def smote(df: DataFrame, key: Sequence[str], label: str = "label", vec: str = "vec", k: int = 5,
          seed: int = 42) -> DataFrame:
    """Synthetic minority rows x + g * (nn - x) up to the majority size.

    Neighbours are the exact k nearest minority rows; the neighbour index and
    the gap g come from the hash of (key, copy).  Returns only the synthetic
    rows: (key..., copy, label, vec, nn key..., gap).
    """
    key = list(key)
    maj, n_maj, mino, n_min = roles(df, label)
    n_syn = n_maj - n_min
    if n_syn > 0 and n_min <= k:
        raise ValueError(f"SMOTE needs more than {k} minority rows to have {k} neighbours each; there are {n_min}")
    if n_syn <= 0:
        return df.limit(0).select(*key, F.lit(1).alias("copy"), label, vec,
                                  *[F.col(c).alias(f"nn_{c}") for c in key], F.lit(0.0).alias("gap"))
    kk = k
    minority = df.where(F.col(label) == mino).select(*key, label, vec)
    nn = knn_join(minority, minority, kk, key, key, vec, exclude_self=True)
    base, rem = _copies(n_syn, n_min)
    ranked = exact_rank(minority, key, [], seed, "smote_rank", rank_col="__r")
    n = F.lit(base) + (F.col("__r") <= rem).cast("int")
    rows = ranked.where(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), n))).drop("__r")
    rows = rows.withColumn("__pick", (F.floor(hash_unit(hash_key(seed, "smote_nn", key, F.col("copy"))) * kk)
                                      + 1).cast("int")) \
        .withColumn("gap", hash_unit(hash_key(seed, "smote_gap", key, F.col("copy"))))
    picked = rows.join(nn.select(*key, F.col("rank").alias("__pick"), *[f"nn_{c}" for c in key]),
                       [*key, "__pick"], "inner")
    nn_vec = minority.select(*[F.col(c).alias(f"nn_{c}") for c in key], F.col(vec).alias("__nv"))
    j = picked.join(nn_vec, [f"nn_{c}" for c in key], "inner")
    syn = F.zip_with(F.col(vec), F.col("__nv"), lambda a, b: a + F.col("gap") * (b - a))
    return j.select(*key, "copy", label, syn.alias(vec), *[f"nn_{c}" for c in key], "gap")


def with_copy(df: DataFrame) -> DataFrame:
    return df if "copy" in df.columns else df.withColumn("copy", F.lit(0))


def smote_union(df: DataFrame, key: Sequence[str], label: str = "label", vec: str = "vec", k: int = 5,
                seed: int = 42) -> DataFrame:
    """Originals (copy 0) plus SMOTE rows (copy >= 1), keyed by (key..., copy)."""
    syn = smote(df, key, label, vec, k, seed).select(*key, "copy", label, vec)
    return with_copy(df.select(*key, label, vec)).unionByName(syn)


def _settled(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder: the cleaners read a resampled set several times."""
    return cut_lineage(df)


def enn_remove(df: DataFrame, key: Sequence[str], label: str = "label", vec: str = "vec", k: int = 3,
               classes: str = "majority") -> DataFrame:
    """Edited nearest neighbours, rows to remove: (key...).

    A row is removed when any of its k nearest neighbours has another label.
    ``classes='majority'`` edits only the majority class; ``'all'`` edits both.
    """
    key = list(key)
    nn = knn_join(df.select(*key, vec), df.select(*key, vec), k, key, key, vec, exclude_self=True)
    lab = df.select(*key, label)
    nlab = df.select(*[F.col(c).alias(f"nn_{c}") for c in key], F.col(label).alias("__nl"))
    j = nn.join(lab, key).join(nlab, [f"nn_{c}" for c in key])
    bad = j.groupBy(*key, label).agg(F.max((F.col("__nl") != F.col(label)).cast("int")).alias("__bad")) \
        .where("__bad = 1")
    if classes == "majority":
        maj = roles(df, label)[0]
        bad = bad.where(F.col(label) == maj)
    return bad.select(*key)


def clean_enn(df: DataFrame, key: Sequence[str], label: str = "label", vec: str = "vec", k: int = 3,
              classes: str = "majority") -> DataFrame:
    return df.join(enn_remove(df, key, label, vec, k, classes), list(key), "left_anti")


def tomek_remove(df: DataFrame, key: Sequence[str], label: str = "label", vec: str = "vec",
                 classes: str = "majority") -> DataFrame:
    """Members of Tomek links (mutual nearest neighbours with different labels)."""
    key = list(key)
    nn = knn_join(df.select(*key, vec), df.select(*key, vec), 1, key, key, vec, exclude_self=True) \
        .select(*key, *[f"nn_{c}" for c in key])
    back = nn.select(*[F.col(c).alias(f"nn_{c}") for c in key], *[F.col(f"nn_{c}").alias(f"__b_{c}") for c in key])
    mutual = nn.join(back, [f"nn_{c}" for c in key]).where(
        F.expr(" AND ".join(f"`__b_{c}` = `{c}`" for c in key)))
    lab = df.select(*key, label)
    nlab = df.select(*[F.col(c).alias(f"nn_{c}") for c in key], F.col(label).alias("__nl"))
    links = mutual.join(lab, key).join(nlab, [f"nn_{c}" for c in key]).where(F.col(label) != F.col("__nl"))
    if classes == "majority":
        maj = roles(df, label)[0]
        links = links.where(F.col(label) == maj)
    return links.select(*key)


def clean_tomek(df: DataFrame, key: Sequence[str], label: str = "label", vec: str = "vec",
                classes: str = "majority") -> DataFrame:
    return df.join(tomek_remove(df, key, label, vec, classes), list(key), "left_anti")


def smote_enn(df: DataFrame, key: Sequence[str], label: str = "label", vec: str = "vec", seed: int = 42) -> DataFrame:
    """SMOTE, then ENN (k=3) over both classes."""
    u = _settled(smote_union(df, key, label, vec, 5, seed))
    return clean_enn(u, [*key, "copy"], label, vec, 3, "all")


def smote_tomek(df: DataFrame, key: Sequence[str], label: str = "label", vec: str = "vec", seed: int = 42) -> DataFrame:
    """SMOTE, then removal of both members of every Tomek link."""
    u = _settled(smote_union(df, key, label, vec, 5, seed))
    return clean_tomek(u, [*key, "copy"], label, vec, "all")
