"""From raw documents to packed training sequences.

``STAGES``: language ID, exact dedup, n-gram Jaccard join, mixing to target
weights, packing.  Each stage takes (spark, docs, sf_dir) and returns a
DataFrame; its result is written to the shared folder and read as the next
stage's ``docs``.  All but the last return the columns they got.

Defined cases: a document with a null id is told apart by its text; of rows
equal in id and text one survives the dedup stages, and of copies that share an
id too; null texts are rejected by
language ID; where a stage gets them they count as empty.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import language_id as lid
from riskframe.llm.common import prepare, read, written
from riskframe.llm.exact_dedup import exact_dedup
from riskframe.llm.jaccard_join import jaccard_join
from riskframe.llm.mixing import mix_sources
from riskframe.llm.packing import pack
from riskframe.llm.queries import tokenizer_path

#: A document is rejected when no language is at least this likely.
LEAST_SCORE = 0.4
#: Words of a shingle, and Jaccard similarity in percent from which documents are near copies.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _surrogate() -> Column:
    """The id, or for a null id a large number from the text."""
    own = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2) + F.lit(1 << 62)
    return F.coalesce(F.col("doc_id").cast("long"), own)


def _bitmap(number: Column) -> tuple[Column, Column]:
    """Which bitmap has the bit of a row number from 0, and where."""
    return F.bitmap_bucket_number(number + 1), F.bitmap_bit_position(number + 1)


def _places(docs: DataFrame) -> tuple[Column, Column] | None:
    """File and position of each row, where ``docs`` holds every row of its Parquet files once; else None.

    Only file footers are read.  A row then has the same place in every later read.
    """
    try:
        about = docs.metadataColumn("_metadata")
        path, at = about["file_path"], about["row_index"]
        bucket, bit = _bitmap(at)
        held = docs.select(path.alias("path"), bucket.alias("bucket"), bit.alias("bit")).groupBy("path", "bucket").agg(
            F.count(F.lit(1)).alias("n"), F.bitmap_count(F.bitmap_construct_agg("bit")).alias("places"))
        found = held.agg(F.sum("n").alias("n"), F.sum("places").alias("places")).first()
        files = [unquote(f) for f in docs.inputFiles()]
        stored = docs.sparkSession.read.schema(docs.schema).parquet(*files).count() if found.n else None
    except AnalysisException:  # not read from Parquet files, or not from all of their rows as they are
        return None
    return (path, at) if found.n and found.n == found.places == stored else None


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for every row, and the name of that column (one that ``docs`` has not).

    Rows of Parquet files are numbered by their place there, so texts are not
    written again; others are written with their numbers.
    """
    name = "__row"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    places = _places(docs)
    if not places:
        return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
    path, at = f"{name}path", f"{name}at"
    placed = docs.select("*", places[0].alias(path), places[1].alias(at))
    files = sorted(r[0] for r in placed.select(path).distinct().collect())
    known = docs.sparkSession.createDataFrame(list(enumerate(files)), f"`{name}` long, `{path}` string")
    number = F.shiftleft(F.col(name), FILE_BITS) + F.col(at)
    return placed.join(F.broadcast(known), path).select(*[F.col(f"`{c}`") for c in docs.columns], number.alias(name)), name


#: A row's number is its file's number and, in so many bits, its position there.
FILE_BITS = 40
#: Most bytes of row bitmaps that are broadcast (a quarter of a billion rows and more); beyond, rows are joined to them.
BITMAP_BYTES = 32 << 20


def _only(docs: DataFrame, row: str, keepers: DataFrame, copy: Column | None = None) -> DataFrame:
    """The rows of numbered ``docs`` whose numbers are in ``keepers`` (column row), without their numbers.

    A row comes once for each ``copy`` (a column of ``keepers``) with its number.
    The decisions are a bit a row and copy, so texts are not shuffled to meet them.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c != row]
    bucket, bit = _bitmap(F.col("row"))
    copy = F.lit(1) if copy is None else copy
    maps = written(keepers.groupBy(bucket.alias("bucket"), copy.alias("copy")).agg(
        F.bitmap_construct_agg(bit).alias("bits")), "kept").select("bucket", "bits")
    small = maps.count() * 4096 <= BITMAP_BYTES
    bucket, bit = _bitmap(F.col(row))
    rows = docs.select(F.struct(*columns).alias("doc"), bucket.alias("bucket"), bit.alias("bit"))
    kept = F.expr("shiftright(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), "
                  "cast(bit % 8 as int)) % 2 = 1")
    return rows.join(F.broadcast(maps) if small else maps, "bucket").where(kept).select("doc.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; undetermined ones go."""
    prepare(spark)
    model = lid.fit(docs, F.col("doc_id").isNotNull() & ~lid.held_out())
    found = lid.predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), model)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select("row.*")


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    prepare(spark)
    rows, row = _numbered(docs)
    verdict = exact_dedup(rows.select(_surrogate().alias("sid"), "text", F.col(row).alias("__row")), id_col="sid",
                          row_col="__row")
    return _only(rows, row, verdict.where("kept").select("row"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component of near copies.

    Near copies have a Jaccard similarity of 0.8 or more over five-word shingles.
    """
    prepare(spark)
    rows, row = _numbered(docs)
    keys = rows.select(F.col(row).alias("row"), _surrogate().alias("sid"), F.xxhash64("text").alias("text"))
    found = jaccard_join(rows.select(F.col(row).alias("__row"), "text"), id_col="__row", size=NEAR_WORDS, percent=NEAR_PERCENT)
    found = found.select(F.col("id").alias("row"), "n_shingles", "component_id").join(keys, "row")
    # texts without words are no near copies: of those only rows equal in id and text are one
    blank = F.col("n_shingles") == 0
    best = found.groupBy(F.when(~blank, F.col("component_id")), F.when(blank, F.col("sid")),
                         F.when(blank, F.col("text"))).agg(F.min(F.struct("sid", "row")).alias("best"))
    return _only(rows, row, best.select("best.row"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit every document as many times as the mix takes it (0, 1 or 2)."""
    prepare(spark)
    rows, row = _numbered(docs)
    mixed = mix_sources(rows, keep=(row,)).where("copies > 0").select(
        F.col(f"kept.{row}").alias("row"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return _only(rows, row, mixed, F.col("copy"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece, with its ids."""
    prepare(spark)
    return pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language_id", language_id), ("exact_dedup", dedup_exact), ("jaccard_join", dedup_near), ("mixing", mix),
          ("packing", packing)]

#: Language ID is a trained model, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
