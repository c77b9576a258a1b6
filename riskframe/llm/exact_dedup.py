"""Exact dedup against a persistent digest index (DataFrame functions only).

Two texts are equal when they are identical after deleting every white-space
character ``[\\x20\\x09-\\x0D]``.  Of equal rows, the one with the most code
points in the original text stays, then the smallest id (null last), then the
earliest batch, then the smallest row number.

:class:`DigestIndex` is a table bucketed and sorted by digest, kept under a path
that any later session can open.  A new batch is reduced to one row per digest
with partial aggregation and sort-merge anti-joined with the index (the index
side needs no shuffle: it is bucketed); what is new is appended.  A digest that
the index has is appended again only where the batch holds a better row for it;
readers take the best entry of a digest.  Rows meet their digest's entry in a
join that adaptive execution can split, so a text that a third of the rows hold
is not one task.

Defined cases: null text counts as empty, and all empty texts are equal; a null
id can stay (its ``keep_id`` is null); of repeated rows exactly one is kept; an
empty batch adds nothing; a batch that is added again adds nothing and keeps
nothing; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, prepare, shared_path, written


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """id, digest, chars and a row number (``row_col``, or a new one) for every row; the text is read once and not shuffled."""
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"),
                       F.unhex(F.sha2(F.translate(text, SPACES, ""), 256)).alias("digest"),
                       F.char_length(text).alias("chars"), row.alias("row"))


def _rank():
    """Orders the rows of a digest, the one that stays first."""
    return F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"),
                    F.col("batch").alias("batch"), F.col("row").alias("row"))


class DigestIndex:
    """Entries (digest, chars, id, row, batch), bucketed and sorted by digest, in files under ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, id_type: str = "long"):
        """Open the index at ``path``, or make an empty one (by default in the shared folder).

        ``buckets`` and ``id_type`` are those of the index where it exists.
        """
        prepare(spark)
        self.spark = spark
        self.path = path or shared_path(spark, "digest-index")
        about = f"{self.path}-about"
        try:
            known = spark.read.json(about, schema="buckets int, id_type string").first()
        except AnalysisException:  # no such path
            known = None
        if known is None:
            known = (buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), id_type)
            spark.createDataFrame([known], "buckets int, id_type string").coalesce(1).write.json(about)
        self.buckets, self.id_type = known
        self.name = f"digest_index_{uuid.uuid4().hex}"  # of this session; the files are the index
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, chars INT, id {self.id_type}, row LONG, batch LONG) "
                  f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
                  f"LOCATION '{self.path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def best(self) -> DataFrame:
        """digest and ``best`` (less, no_id, id, batch, row) of every digest; no shuffle."""
        return self.read().groupBy("digest").agg(F.min(_rank()).alias("best"))

    def next_batch(self) -> int:
        return (self.read().agg(F.max("batch").alias("b")).first().b or 0) + 1

    def _append(self, rows: DataFrame) -> None:
        (rows.select("digest", "chars", F.col("id").cast(self.id_type).alias("id"), "row", "batch")
         .repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest")
         .format("parquet").mode("append").saveAsTable(self.name))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            row_col: str | None = None) -> DataFrame:
        """Append the batch's new texts; one row per input row says what became of it.

        Columns: id, keep_id (id of the row that stays, of this batch or an
        earlier one), group_size (rows of this batch with that text), kept,
        digest, row (number of the input row; ``row_col`` where given).
        """
        rows = written(digests(docs, id_col, text_col, row_col).withColumn("batch", F.lit(self.next_batch())), "digests")
        self.add_digests(rows)
        return self.verdicts(rows)

    def add_digests(self, rows: DataFrame) -> None:
        """Append what is new, or better than the index has, of a written batch (:func:`digests` with ``batch``)."""
        groups = rows.groupBy("digest").agg(F.min(_rank()).alias("mine"))
        new = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        better = groups.join(self.best().hint("merge"), "digest").where("mine < best").drop("best")
        self._append(new.unionByName(better).select("digest", (-F.col("mine.less")).alias("chars"), "mine.id",
                                                    "mine.row", "mine.batch"))

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """What the index says of written rows (:func:`digests` with ``batch``)."""
        sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        found = written(sizes.join(self.best().hint("merge"), "digest"), "verdicts")
        return rows.join(found, "digest").select(
            "id", F.col("best.id").alias("keep_id"), "group_size",
            ((F.col("best.batch") == F.col("batch")) & (F.col("best.row") == F.col("row"))).alias("kept"),
            "digest", "row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
                index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """Verdicts (see :meth:`DigestIndex.add`) after ``batches`` batches were added to ``index`` (a new one by default).

    Rows are dealt to batches by hash of their number, so equal texts meet
    across batches: a later batch is anti-joined with what the index holds, and
    moves ``keep_id`` where it has the better row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    index = index or DigestIndex(docs.sparkSession, id_type=kind)
    first = index.next_batch()
    part = F.pmod(F.xxhash64("row"), F.lit(batches))
    rows = written(digests(docs, id_col, text_col, row_col).withColumn("batch", part + first), "digests")
    for i in range(batches):
        index.add_digests(rows.where(F.col("batch") == first + i))
    return index.verdicts(rows)
