"""Shared pieces of the text operators: word spans and hashes over Arrow buffers.

Kernels run on one chunk of documents at a time.  They work on the UTF-8 bytes
of the whole chunk with numpy, so no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import ensure_checkpoint_dir, shared_path, ship_package

#: UTF-8 bytes of text that one kernel call should get.
CHUNK_BYTES = 4 << 20
#: Bytes of a batch handed to a Python worker: it is held by the JVM, with room to double, and by the worker.
BATCH_BYTES = 8 << 20
#: Java regex of one word, and of the characters between words.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Stands for a null id where ids are compared: after every other id.
NO_ID = np.iinfo(np.int64).max


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make checkpoints and the executors' imports work, and keep batches for Python small; safe to call again."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    held = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(held).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(held, f"{BATCH_BYTES}b")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage: a lost executor costs no recomputation of what was written.
    """
    prepare(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of the text column (one scan, no shuffle of rows)."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return int(row.n), int(row.b or 0)


def chunk_of(n_chunks: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n_chunks)).cast("int")


def chunked(docs: DataFrame, total: int, cols: list[Column], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``cols`` and a chunk number spread evenly by the whole row's content."""
    n = max(1, -(-total // chunk_bytes))
    picked = docs.select(*cols)
    return picked.select(chunk_of(n, *[F.col(f"`{c}`") for c in picked.columns]).alias("chunk"), *picked.columns)


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Inverse of :func:`utf8`."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)),
        pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Words:
    """Word spans of a chunk: ``start``/``end`` bytes, ``doc`` row, ``first`` word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~IS_SPACE[data]
        begins = inside[:n].copy()
        begins[1:] &= ~inside[:n - 1]
        edge = offsets[:-1][offsets[:-1] < n]
        begins[edge] = inside[edge]  # a row's first byte never continues the row before
        stops = inside[:n] & ~inside[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        stops[last] = inside[last]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)  # n_docs + 1
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.rank = np.arange(len(self.start)) - self.first[:-1][self.doc]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Bytes that the running sum takes at a time.
_BLOCK = 1 << 16
_BLOCK_POWERS = _powers(_BASE, _BLOCK)
_BLOCK_BACK = _powers(_BASE_INVERSE, _BLOCK)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: differences of one running polynomial sum."""
    sums = np.zeros(len(data) + 1, np.uint64)
    for k, at in enumerate(range(0, len(data), _BLOCK)):  # one array as long as the data, not five
        part = _BYTE[data[at:at + _BLOCK]]
        part *= _BLOCK_POWERS[:len(part)]
        part *= np.uint64(pow(int(_BLOCK_POWERS[_BLOCK]), k, 1 << 64))
        part[:1] += sums[at:at + 1]
        np.cumsum(part, dtype=np.uint64, out=sums[at + 1:at + 1 + len(part)])
    far = _powers(_BLOCK_BACK[_BLOCK], len(data) // _BLOCK)
    back = far[start // _BLOCK] * _BLOCK_BACK[start % _BLOCK]
    return mix((sums[end] - sums[start]) * back + (end - start).astype(np.uint64))


def run_hashes(words: np.ndarray, at: np.ndarray, length: int, factor: int) -> np.ndarray:
    """Hash of ``length`` consecutive word hashes from each position in ``at``."""
    h = np.zeros(len(at), np.uint64)
    for t in range(length):
        h = h * np.uint64(factor) + words[at + t]
    return mix(h)


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which ``values`` occur in the sorted array ``ordered``."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def blobs(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated arrays of a binary column, and the row each item came from."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.repeat(np.arange(len(parts)), sizes)


def by_bucket(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted 64-bit ``keys`` that fall into each of ``n_buckets`` equal key ranges."""
    step = (1 << 64) // n_buckets + 1
    edges = np.searchsorted(keys, np.array([step * b for b in range(1, n_buckets)], np.uint64))
    edges = [0, *edges.tolist(), len(keys)]
    for b in range(n_buckets):
        if edges[b] < edges[b + 1]:
            yield b, slice(edges[b], edges[b + 1])


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Positions where a new group begins in jointly sorted key arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def group_sizes(starts: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the groups that begin at ``starts`` in an array of length ``n``."""
    return np.diff(np.append(starts, n)) if len(starts) else np.zeros(0, np.int64)


def give_back() -> None:
    """Return a worker's freed memory to the system: an idle worker would hold it beside the next stage's."""
    import ctypes
    import gc
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def row_slices(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right"))
        upto = max(at + 1, upto)
        yield batch.slice(at, upto - at)
        at = upto
