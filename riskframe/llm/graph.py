"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long); label is the smallest node of its component.

    Alternates large-star and small-star steps (each node hands its larger, then
    its smaller neighbours to the smallest one it knows) until the edges stop
    changing: O(log n) rounds in practice, each one a grouped minimum and a join,
    cut by a written table.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, F.col("b") > F.col("a"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = written(_star(down, F.lit(True)), "edges")
        new = _state(edges)
        if new == state:
            break
        state = new
    # now every edge is (node, smallest)
    labels = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label"))
    return labels.union(labels.select(F.col("label").alias("node"), "label")).distinct()


def _star(pairs: DataFrame, moved) -> DataFrame:
    """Link each node's ``moved`` neighbours (and the node itself) to the smallest of node and neighbours."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    hung = pairs.where(moved).join(least, "a").select(F.col("b").alias("x"), "m")
    own = least.select(F.col("a").alias("x"), "m")
    return (hung.union(own).where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64(F.greatest("a", "b"), F.least("a", "b"))
    r = edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)"))).first()
    return r[0], r[1]

