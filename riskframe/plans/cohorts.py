"""Bindings of the operators to the test tables (cohorts T1-T4).

The survey rules read codes such as ``ELIGSTAT`` or ``UCOD_LEADING``; on the
test tables those codes are derived from real columns by expressions, so every
query's work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T1_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
T1_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
T2_KEY = ["o_orderkey"]
T2_FEATURES = ["o_totalprice", "c_acctbal", "n_regionkey"]
T3_KEY = ["doc_id"]
T3_FEATURES = ["n_chars", "text_len", "n_words", "n_lines", "toxic"]
T4_KEY = ["vec_id"]
T4_DIM = 64
T4_FEATURES = [f"e{i:02d}" for i in range(T4_DIM)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def t1(spark: SparkSession, sf_dir: str, extra: bool = False) -> DataFrame:
    """lineitem with gaps: discount missing on line 7, tax on lines 1-4."""
    li = table(spark, sf_dir, "lineitem")
    cols = [*T1_KEY, "l_quantity", "l_extendedprice",
            F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double"))
             .otherwise(F.col("l_discount")).alias("l_discount"),
            F.when(F.col("l_linenumber") <= 4, F.lit(None).cast("double"))
             .otherwise(F.col("l_tax")).alias("l_tax"),
            ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).cast("int").alias("label")]
    if extra:
        cols += ["l_returnflag", "l_linestatus", F.year("l_shipdate").alias("ship_year")]
    return li.select(*cols)


def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> customer -> nation, shaped like a survey table linked to mortality.

    ELIGSTAT: 1 = linked (status F or O), 2 = not linked (P).
    MORTSTAT: 1 = dead (F), 0 = alive (O), NULL when not linked.
    UCOD_LEADING: custkey mod 12 (0 -> missing), only for the dead.
    HYPERTEN: orderkey mod 2, missing when custkey mod 3 = 0.
    SDDSRVYR: order year - 1992 (cycles 3..9).
    """
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left")
    linked = F.col("o_orderstatus") != "P"
    dead = F.col("o_orderstatus") == "F"
    ucod = F.col("o_custkey") % 12
    return j.select(
        "o_orderkey", "o_custkey", "o_totalprice", "c_acctbal", "n_regionkey", "o_orderpriority",
        F.when(linked, 1.0).otherwise(2.0).alias("ELIGSTAT"),
        F.when(linked, F.when(dead, 1.0).otherwise(0.0)).alias("MORTSTAT"),
        F.when(dead & (ucod != 0), ucod.cast("double")).alias("UCOD_LEADING"),
        F.when(F.col("o_custkey") % 3 != 0, (F.col("o_orderkey") % 2).cast("double")).alias("HYPERTEN"),
        (F.year("o_orderdate") - 1992).alias("SDDSRVYR"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"))


def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels joined to documents: small, imbalanced (quality = 0 is positive)."""
    lab = table(spark, sf_dir, "labels")
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(  # numbers meet the labels, no text is shuffled
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.length(text).cast("double").alias("text_len"),
        F.size(F.split(F.trim(text), r"\s+")).cast("double").alias("n_words"),
        F.size(F.split(text, "\n")).cast("double").alias("n_lines"))
    j = lab.join(docs, "doc_id", "inner")
    return j.select(
        "doc_id", "n_chars", "text_len", "n_words", "n_lines",
        F.col("toxic").cast("double").alias("toxic"),
        (F.col("quality") == 0).cast("int").alias("label"))


def t4(spark: SparkSession, sf_dir: str, as_columns: bool = True) -> DataFrame:
    """embeddings: 64 doubles, label 0 against the rest."""
    e = table(spark, sf_dir, "embeddings")
    vec = F.transform("embedding", lambda x: x.cast("double"))
    base = e.select("vec_id", vec.alias("vec"), (F.col("label") == 0).cast("int").alias("label"),
                    F.col("label").alias("class"))
    if not as_columns:
        return base
    return base.select("vec_id", "label", "class", "vec",
                       *[F.col("vec")[i].alias(n) for i, n in enumerate(T4_FEATURES)])
