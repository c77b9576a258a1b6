"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

A source's target is a share of all words by weight, at most ``most`` times the
words it has; what is over is shared again by weight among the others.  Every
document of a source then has the same expected number of copies,
target / words.  Documents are ordered by size within their source, expected
copies are prefix-summed, one random offset per source is added, and a document
is emitted once per integer that its interval crosses.  Ordering by size makes
the taken *words*, not only the copies, come near the target.

The prefix sum needs no window over a source: documents are counted per cell
(source, size, leading hex digits of the document's hash), cells are summed
within sizes and sizes within sources, and only the rows of one cell (about
``cell_rows``) are ever sorted together.  Windows over sources and sizes run on
these pre-aggregated counts.

Defined cases: null text has size 0; a null source is one source, sorted last;
a document of size 0 can be emitted but adds no words; a null id is ordered by
its text; repeated rows are separate documents; an empty table gives no rows.
Results depend on the rows and the seed only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, written

#: Weights by position of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Expected rows that one cell may hold.
CELL_ROWS = 50_000


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sources: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """``sources`` (source key, words), one row each, with weight and target (water filling)."""
    by_key = Window.orderBy("source_key")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod(F.row_number().over(by_key) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = sources.withColumn("weight", weight).withColumn("most", most * F.col("source_size"))
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), "source_key")
    everything = Window.partitionBy()
    filled = (capped.withColumn("order", F.row_number().over(by_fill))
              .withColumn("above", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("size_below", F.coalesce(
                  F.sum("source_size").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("total", F.sum("source_size").over(everything)))
    level = (F.lit(share) * F.col("total") - F.lit(most) * F.col("size_below")) / F.col("above")
    filled = filled.withColumn("level", level)
    free = F.col("level") * F.col("weight") <= F.col("most")
    filled = filled.withColumn("level", F.min_by(F.when(free, F.col("level")),
                                                 F.when(free, F.col("order"))).over(everything))
    return filled.select("source_key", "source_size", "weight",
                         F.least("most", F.coalesce(F.col("level") * F.col("weight"), "most")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix",
                keep: tuple[str, ...] = (), cell_rows: int = CELL_ROWS) -> DataFrame:
    """id, size, source_size, target, copies and taken words for every row; ``keep`` names columns to carry in a
    struct ``kept``, so their names cannot clash."""
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), text, F.lit(""))
    rows = written(docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("source_key"),
        word_count(text).alias("size"), F.md5(name).alias("hash"),
        *[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)]), "sizes")
    digits, n = 0, rows.count()
    while n > cell_rows * 16 ** digits:
        digits += 1
    rows = rows.withColumn("cell", F.substring("hash", 1, digits))
    key = ["source_key", "size", "cell"]
    cells = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "cells")
    sizes = cells.groupBy("source_key", "size").agg(F.sum("n").alias("n_size"))
    sources = sizes.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n_size")).alias("source_size"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("source_key", "size", F.coalesce(F.sum("n_size").over(before(
        Window.partitionBy("source_key").orderBy("size"))), F.lit(0)).alias("below_size"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("source_key"))), 1, 8), 16, 10).cast("double")
    rates = targets(sources, share, most, weights).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ).withColumn("offset", offset / F.lit(float(1 << 32)))
    below = F.coalesce(F.sum("n").over(before(Window.partitionBy("source_key", "size").orderBy("cell"))), F.lit(0))
    starts = (cells.select(*key, below.alias("below_cell")).join(sizes, ["source_key", "size"])
              .join(rates, "source_key"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("hash", "id")))
    placed = ranked.join(starts, key).withColumn("rank", F.col("below_size") + F.col("below_cell") + F.col("rank"))
    crossed = (F.floor(F.col("rank") * F.col("rate") + F.col("offset"))
               - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset")))
    copies = F.least(crossed, F.ceil("rate"))
    own = ["id", "size", "source_size", "target"]
    return placed.select(*own, copies.alias("copies"), (copies * F.col("size")).alias("taken"),
                         *([F.struct(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)]).alias("kept")]
                           if keep else []))
