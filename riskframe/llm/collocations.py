"""Phrase collocation mining by SON partitioning.

**Shards.**  Documents are read once, where they lie, into shards: a few MB of
one language's text as numbers of a shard dictionary, pieces apart.  A shard is
the unit of work, and all that a task ever holds.

**Local mining.**  A phrase with at least ``s`` occurrences in a language of
``W`` words has, in at least one shard of ``w`` words, ``s * w / W`` or more.
Each shard is mined completely at that lowered support, length by length: a
window is looked at only where both of its shorter windows can be frequent.

**Union.**  What shards report is united per phrase.  A shard that did not report a
phrase holds fewer occurrences than its support, so the reports bound the
phrase's count from above; phrases that cannot reach ``s`` leave the union.  The
union of each length becomes one bitmap of fixed size (a Bloom filter built by
native bitmap aggregation), which tells the shards what the next length can
build on, and the last pass what to count.  False positives only cost work.

**Exact count.**  A last pass counts every window that the union holds, by
its words and not by a hash, and adds the counts per phrase text.

With more than ``s`` shards the lowered support is 1: shards then report every
window whose parts are frequent, and the bound from above is the exact count.
Nothing is capped; reports and counts are added up within a task before they are
shuffled, and no pass shuffles text.

Scores are exact integers: products are decimals of 38 digits.

Defined cases: a null language is ``und``; null, empty and blank texts have no
words; repeated rows count as often as they occur; languages with no frequent
phrase give no rows; ties are ordered by phrase; texts longer than a shard are
cut between pieces (a single piece longer than that stays whole); other columns
are not read; an empty table gives no rows.  The table of languages, one row
each, is joined to the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, group_sizes, group_starts, mix, prepare, shared_path, span_hashes, utf8, written
from .pretokens import cut_rows

#: Bytes of one shard's text, and of all unfinished shards of a task.
SHARD_BYTES, TASK_BYTES = 64 << 20, 160 << 20
#: Bytes of text that are cut into words at a time.
RUN_BYTES = 1 << 20
#: Windows that are hashed at a time, and rows of a task's results that are merged before they leave it.
SLICE, MERGED_ROWS = 1 << 18, 1 << 20
#: Bits of the bitmap that stands for the union of one length.
UNION_BITS = 1 << 25
_BUCKET_BITS = 32768  # bits of a row of Spark's bitmap aggregation
_FACTOR = np.uint64(0x9E3779B97F4A7C55)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def shard_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of some texts, and the texts as their numbers, with -1 between pieces."""
    data = _LOWER[data]
    inside = ~_GAP[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    starts[edge] = inside[edge]
    word_start = np.flatnonzero(starts)
    if not len(word_start):
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    # words without the bytes between them, and where each begins there
    kept = np.append(0, np.cumsum(inside, dtype=np.int64))
    cuts = np.append(kept[word_start], kept[-1])
    words = pa.Array.from_buffers(pa.large_string(), len(word_start), [
        None, pa.py_buffer(np.ascontiguousarray(cuts)), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    coded = pc.dictionary_encode(words)
    breaks = _BREAK[data].astype(np.int64)
    breaks[edge] += 1
    piece = np.cumsum(breaks)[word_start]
    at = np.flatnonzero(np.diff(piece)) + 1
    return coded.dictionary.cast(pa.string()), np.insert(coded.indices.to_numpy().astype(np.int32), at, -1)


def joined(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Several results of :func:`shard_of` as one, with a break between them."""
    coded = pc.dictionary_encode(pa.concat_arrays([w for w, _ in parts]))
    number = np.append(coded.indices.to_numpy().astype(np.int32), np.int32(-1))  # -1 stays -1
    base, at, out = 0, 0, np.full(sum(len(ids) + 1 for _, ids in parts), -1, np.int32)
    for words, ids in parts:
        out[at:at + len(ids)] = number[np.where(ids >= 0, ids + base, -1)]
        base, at = base + len(words), at + len(ids) + 1
    return coded.dictionary, out[:-1]


def _pressed(data: bytes | pa.Buffer | np.ndarray) -> bytes:
    """Compressed, with the length before it: a third of the bytes where rows are written and handed over."""
    size = memoryview(data).nbytes
    return size.to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpressed(data: pa.Buffer) -> pa.Buffer:
    return pa.decompress(data.slice(8), int.from_bytes(data.slice(0, 8).to_pybytes(), "little"), codec="zstd")


def _listed(words: pa.Array) -> pa.Buffer:
    """The words, a newline between them."""
    rows = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.large_string()))
    return pc.binary_join(rows, pa.scalar("\n", pa.large_string()))[0].as_buffer()


def _unlisted(data: pa.Buffer) -> pa.Array:
    """Inverse of :func:`_listed`."""
    rows = np.frombuffer(data, np.uint8)
    end = np.append(np.flatnonzero(rows == 0x0A), len(rows))
    kept = rows[rows != 0x0A]
    return pa.Array.from_buffers(pa.large_string(), len(end), [
        None, pa.py_buffer(np.append(0, end - np.arange(len(end)))), pa.py_buffer(kept)]).cast(pa.string())


def _sharder(shard_bytes: int, task_bytes: int):
    def flush(lang: str, parts: list) -> pa.RecordBatch:
        words, ids = joined(parts)
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([lang]), "n_words": pa.array([int((ids >= 0).sum())], pa.int64()),
            "words": pa.array([_pressed(_listed(words))], pa.binary()),
            "ids": pa.array([_pressed(ids)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_parts: dict[str, list] = {}
        size: dict[str, int] = {}
        run_bytes = min(RUN_BYTES, shard_bytes)
        for batch in batches:
            langs = pc.dictionary_encode(batch.column("lang"))
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                data, offsets = utf8(batch.column("text").filter(pc.equal(langs.indices, i)))
                edges = cut_rows(offsets, run_bytes, lambda a, b: np.flatnonzero(_BREAK[data[a:b]]) + 1)
                at = 0
                while at < len(edges) - 1:
                    upto = max(at + 1, int(np.searchsorted(edges, edges[at] + run_bytes, side="right")) - 1)
                    upto = min(upto, len(edges) - 1)
                    part = shard_of(data[edges[at]:edges[upto]], edges[at:upto + 1] - edges[at])
                    open_parts.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + int(edges[upto] - edges[at])
                    at = upto
                    if size[lang] >= shard_bytes:
                        yield flush(lang, open_parts.pop(lang))
                        del size[lang]
            while sum(size.values()) > task_bytes:
                lang = max(size, key=size.get)
                yield flush(lang, open_parts.pop(lang))
                del size[lang]
        for lang in list(open_parts):
            yield flush(lang, open_parts.pop(lang))
        give_back()
    return run


def _fewer_tasks(rows: DataFrame) -> DataFrame:
    """Up to eight input splits a task, but two tasks a core: the more a task holds, the fuller its shards
    and the more of its results are added up before they are shuffled."""
    return rows.coalesce(max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() // 8))


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES,
           task_bytes: int = TASK_BYTES) -> DataFrame:
    """lang, n_words, words (no word holds a newline), ids: the partition that is mined, written once."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.col(f"`{text_col}`").alias("text")).where(F.length("text") > 0)
    rows = _fewer_tasks(rows)
    made = rows.mapInArrow(_sharder(shard_bytes, task_bytes),
                           "lang string, n_words long, words binary, ids binary").where("n_words > 0")
    spark = docs.sparkSession
    prepare(spark)
    path = shared_path(spark, "phrase-shards")
    made.write.option("compression", "none").parquet(path)  # the columns are compressed
    return spark.read.schema(made.schema).parquet(path)


class Union:
    """Phrases that can be frequent, as a bitmap over their keys; it may hold others too."""

    def __init__(self, rows, bits: int):
        self.mask = np.uint64(bits - 1)
        self.bits = np.zeros(bits // 8, np.uint8)
        width = _BUCKET_BITS // 8
        for bucket, bitmap in rows:
            self.bits[(bucket - 1) * width:bucket * width] = np.frombuffer(bitmap, np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for shift in (0, 32):
            p = keys >> np.uint64(shift) & self.mask
            found &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def _bitmap(keys: DataFrame, bits: int) -> tuple[Union, bool]:
    """The bitmap of some keys, and whether there is any; what reaches the driver (``bits / 8`` bytes) is fixed."""
    place = F.explode(F.array(*[F.shiftrightunsigned("key", s).bitwiseAND(F.lit(bits - 1)) + 1 for s in (0, 32)]))
    rows = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap")).collect()
    return Union(rows, bits), bool(rows)


def _unite(reports: DataFrame, min_count: int, bits: int) -> tuple[Union, bool]:
    """The bitmap of the reported phrases that can reach ``min_count``, and whether there is any."""
    able = reports.groupBy("key", "slack").agg(F.sum("excess").alias("excess")).where(
        F.col("excess") + F.col("slack") >= min_count)
    return _bitmap(able.select("key"), bits)


class _Shard:
    """A shard's windows of some length, hashed slice by slice; a window is whole when no break is inside."""

    def __init__(self, lang: str, words: pa.Array, ids: np.ndarray):
        data, offsets = utf8(words)
        own = mix(span_hashes(data, offsets[:-1], offsets[1:]) ^ _text_hash(lang))
        self.ids, self.word = ids, np.append(own, np.uint64(0))  # -1: the last

    def keys(self, length: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Places, keys and wholeness of all windows."""
        n = len(self.ids) - length + 1
        for a in range(0, n, SLICE):
            m = min(n - a, SLICE)
            ids = self.ids[a:a + m]
            key, whole = self.word[ids], ids >= 0
            for t in range(1, length):
                ids = self.ids[a + t:a + t + m]
                key = mix(key * _FACTOR + self.word[ids])
                whole &= ids >= 0
            yield slice(a, a + m), key, whole

    def among(self, length: int, union: Union, where: np.ndarray | None = None) -> np.ndarray:
        """Which windows (of those in ``where``) are whole and held by ``union``."""
        out = np.zeros(max(0, len(self.ids) - length + 1), bool)
        for place, key, whole in self.keys(length):
            at = np.flatnonzero(whole if where is None else whole & where[place])
            out[place.start + at] = union.holds(key[at])
        return out


def _text_hash(text: str) -> np.uint64:
    data = np.frombuffer(text.encode(), np.uint8)
    return span_hashes(data, np.array([0]), np.array([len(data)]))[0]


def _shards_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, _Shard, pa.Array]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("lang", "n_words", "total", "slack")}
            words = _unlisted(_unpressed(batch.column("words")[i].as_buffer()))
            ids = np.frombuffer(_unpressed(batch.column("ids")[i].as_buffer()), np.int32)
            yield row, _Shard(row["lang"], words, ids), words
            large = len(ids) > SLICE
            del words, ids
            if large:
                give_back()


def _merged(batches: Iterator[pa.RecordBatch], by: list[str], added: str) -> Iterator[pa.RecordBatch]:
    """The rows of a task's shards, those of equal ``by`` added up as far as ``MERGED_ROWS`` rows allow."""
    held, n = [], 0

    def leave(table: pa.Table) -> list[pa.RecordBatch]:
        return table.combine_chunks().to_batches(max_chunksize=1 << 16)

    def merge() -> pa.Table:
        table = pa.Table.from_batches(held)
        return table.group_by(by, use_threads=False).aggregate([(added, "sum")]).rename_columns([*by, added]) if len(held) > 1 else table
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > MERGED_ROWS:
            table = merge()
            if table.num_rows > MERGED_ROWS // 2:
                yield from leave(table)
                held, n = [], 0
            else:
                held, n = table.combine_chunks().to_batches(), table.num_rows
    if held:
        yield from leave(merge())
    held.clear()
    give_back()


def _miner(length: int, before, min_count: int):
    """Reports of the phrases of ``length`` words that are frequent in their shard."""
    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, shard, _ in _shards_in(batches):
            support = -(-min_count * row["n_words"] // row["total"])
            if length > 1:  # both shorter windows can be frequent
                part = shard.among(length - 1, before.value)
                where = part[:-1] & part[1:]
                keys, upto = np.empty(np.count_nonzero(where), np.uint64), 0
                for place, key, _ in shard.keys(length):
                    found = key[where[place]]
                    keys[upto:upto + len(found)] = found
                    upto += len(found)
                keys.sort()
                first = group_starts(keys)
                keys, count = keys[first], group_sizes(first, len(keys))
            else:
                keys, count = shard.word[:-1], _occurrences(shard.ids, len(shard.word) - 1)
            kept = count >= support
            keys, count = keys[kept].astype(np.int64), count[kept]
            # a shard that reports nothing has at most support - 1 occurrences
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(keys), "slack": pa.array(np.full(len(keys), row["slack"])),
                "excess": pa.array(count - (support - 1))})
    return lambda batches: _merged(mine(batches), ["key", "slack"], "excess")


def _occurrences(numbers: np.ndarray, n: int) -> np.ndarray:
    """How often each of the numbers 0 to n - 1 occurs; -1 does not count."""
    count, step = np.zeros(n + 1, np.int64), max(SLICE, n)
    for a in range(0, len(numbers), step):
        count += np.bincount(numbers[a:a + step] + 1, minlength=n + 1)
    return count[1:]


def _numbered(where: np.ndarray, number: np.ndarray, ids: np.ndarray, length: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of ``length`` words at the places ``where``, numbered by ``number``, their first words' numbers, and
    ``ids``, their last words: a number for each place (-1: none), and a place of each phrase."""
    def slices() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a in range(0, len(where), SLICE):
            at = np.flatnonzero(where[a:a + SLICE]) + a
            if len(at):
                yield at, number[at].astype(np.int64) * n_words + ids[at + length - 1]
    exact, fresh, held = np.zeros(0, np.int64), [], 0
    for _, keys in slices():
        fresh.append(np.unique(keys))
        held += len(fresh[-1])
        if held > max(len(exact), SLICE):
            exact, fresh, held = np.unique(np.concatenate([exact, *fresh])), [], 0
    exact = np.unique(np.concatenate([exact, *fresh]))
    out, place = np.full(len(where), -1, np.int32), np.zeros(len(exact), np.int64)
    for at, keys in slices():
        out[at] = own = np.searchsorted(exact, keys)
        place[own] = at
    return out, place


def _counter(unions, first: int):
    """Exact counts of all windows of ``first`` words or more that the unions hold, with their words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, shard, words in _shards_in(batches):
            ids, number, where = shard.ids, shard.ids, None  # number: of the phrase at each place, exact
            for length, union in enumerate(unions.value, 1):
                where = shard.among(length, union, None if length == 1 else where[:-1] & where[1:])
                if not where.any():
                    break
                if length == 1:
                    number = np.where(where, ids, np.int32(-1))
                    n = _occurrences(number, len(words)) if first == 1 else None
                else:
                    number, place = _numbered(where, number, ids, length, len(words))
                    n = _occurrences(number, len(place)) if length >= first else None
                if n is None:
                    continue
                if length == 1:
                    own = np.flatnonzero(n)
                    said, n = [words.take(pa.array(own))], n[own]
                else:
                    said = [words.take(pa.array(ids[place + t])) for t in range(length)]
                for a in range(0, len(n), SLICE):
                    m = min(len(n) - a, SLICE)
                    several = [x.slice(a, m) for x in said]
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([row["lang"]] * m, pa.string()),
                        "phrase": pc.binary_join_element_wise(*several, " ") if length > 1 else several[0],
                        "n_words": pa.array(np.full(m, length, np.int32)), "n": pa.array(n[a:a + m])})
    return lambda batches: _merged(count(batches), ["lang", "phrase", "n_words"], "n")


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of single words, as shards have them."""
    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            words = batch.column("phrase").filter(pc.equal(batch.column("lang"), lang))
            yield pa.RecordBatch.from_pydict({"key": pa.array(_Shard(lang, words, np.zeros(0, np.int32)).word[:-1]
                                                             .astype(np.int64))})


def frequent_phrases(parts: DataFrame, min_count: int = 100, longest: int = 5, bits: int = UNION_BITS,
                     every_word: bool = True) -> DataFrame:
    """lang, phrase, n_words, a (occurrences), total (words of the language) of all phrases with ``min_count``.

    ``parts``: a result of :func:`shards`.  Unless ``every_word``, single words
    are those of the longer phrases only.
    """
    spark = parts.sparkSession
    totals = parts.groupBy("lang").agg(F.sum("n_words").alias("total"))
    # the most occurrences that shards can have without reporting them
    support = F.expr(f"({min_count}L * n_words + total - 1) div total")
    slack = parts.select("lang", "n_words").join(totals, "lang").groupBy("lang", "total").agg(
        F.sum(support - 1).alias("slack"))
    languages = written(slack, "phrase-languages")
    rows = _fewer_tasks(parts).join(languages, "lang").select(
        "lang", "n_words", "words", "ids", "total", "slack")
    unions, before = [], None
    for length in range(1, longest + 1):
        reports = rows.mapInArrow(_miner(length, before, min_count), "key long, slack long, excess long")
        union, some = _unite(reports, min_count, bits)
        if not some:
            break
        unions.append(union)
        before = spark.sparkContext.broadcast(union)

    def count(unions: list[Union], first: int) -> DataFrame:
        counted = rows.mapInArrow(_counter(spark.sparkContext.broadcast(unions), first),
                                  "lang string, phrase string, n_words int, n long")
        found = counted.groupBy("lang", "phrase", "n_words").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)
        return written(found.join(languages.drop("slack"), "lang"), "phrases")
    if every_word:
        return count(unions, 1)
    several = count(unions, 2)
    said = several.select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct()
    inside, _ = _bitmap(said.mapInArrow(_word_keys, "key long"), bits)
    return several.unionByName(count([inside], 1))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100,
                 longest: int = 5, contained_percent: int = 100, top: int = 2000, shard_bytes: int = SHARD_BYTES,
                 bits: int = UNION_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words.

    The score of a cut into two parts with ``l`` and ``r`` occurrences is
    ``floor(1000 * a * n / (l * r))``, a phrase's score that of its lowest cut
    (the first of equal ones).  Phrases inside a longer one that occurs at least
    ``contained_percent`` percent as often are left out.
    """
    phrases = frequent_phrases(shards(docs, text_col, lang_col, shard_bytes), min_count, longest, bits,
                               every_word=False)
    several = phrases.where("n_words > 1").withColumn("w", F.split("phrase", " "))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cut = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select(
        "lang", "phrase", "a", "total", "k", part(F.lit(1), F.col("k")).alias("left"),
        part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"))
    # parts of a frequent phrase are frequent: every join finds its row
    counts = phrases.select("lang", "phrase", "a")
    cut = cut.join(counts.toDF("lang", "left", "l"), ["lang", "left"]).join(counts.toDF("lang", "right", "r"),
                                                                         ["lang", "right"])
    score = F.expr("(CAST(a * 1000 AS DECIMAL(19, 0)) * CAST(total AS DECIMAL(19, 0))) div "
                   "(CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a", "total").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best"))
    longer = several.where("n_words > 2").select(
        "lang", "w", "n_words", "a", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("size")).select(
        "lang", "w", "a", "size", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)).alias("at"))
    longer = longer.groupBy("lang", part(F.col("at"), F.col("size")).alias("phrase")).agg(
        F.max("a").alias("within"))
    free = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("within").isNull() | (F.col("within") * 100 < F.col("a") * contained_percent))
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    return free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r",
        F.col("total").alias("n"), "best.score")
