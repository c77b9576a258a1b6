"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent space.

A document's features are its words, the words' shapes (runs of capitals,
small letters, digits and each other character), and how long a word has been
repeated (a feature for each doubling of the run), hashed to ``BUCKETS``.  Weights are (1 + log count) x idf with idf
over all documents; a truncated singular value decomposition of the labelled
sample gives the latent-semantic space.  The labelled vectors are broadcast
(their number is the parameter ``neighbours_kept``), and every document's
cosine with all of them is computed in blocks; the ``k`` nearest vote with
weight cosine ** ``sharpness``.  The score is the share of label 1, calibrated
with the sample's own prior as a vote of weight ``prior``.

Scoring needs no shuffle.  Defined cases: null, empty and word-free texts have
no neighbours and get the prior share as score; labelled rows whose label or
text is null are not learned from; documents without a label row are scored
like others; repeated rows are separate documents; with nothing to learn from
the score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import CHUNK_BYTES, Words, group_sizes, group_starts, mix, row_slices, span_hashes, utf8, written

BITS = 13
BUCKETS = 1 << BITS
#: Bound of the labelled sample (expected rows), and dimensions of the latent space.
NEIGHBOURS_KEPT, DIMENSIONS = 4096, 64
_PARTS = 8
_BLOCK = 512

#: Class of each byte for word shapes: 1 capital, 2 small, 3 digit, 4 part of a non-ASCII letter, else itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, feature, count) of distinct features, rows ascending, and the number of rows."""
    words = Words(*utf8(column))
    rows = len(words.offsets) - 1
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), rows
    name = span_hashes(words.data, words.start, words.end)
    shape_bytes = _CLASS[words.data]
    new = np.ones(len(shape_bytes), bool)  # runs of one class count once
    new[1:] = shape_bytes[1:] != shape_bytes[:-1]
    new[words.start] = True
    place = np.append(0, np.cumsum(new))
    shape = span_hashes(shape_bytes[new], place[words.start], place[words.end])
    runs = group_starts(words.doc, name)  # of one word repeated
    length = group_sizes(runs, len(name))
    depth = np.arange(len(name)) - np.repeat(runs, length)
    again = np.flatnonzero(depth)
    kinds = [(name, words.doc), (shape, words.doc), (np.log2(depth[again]).astype(np.uint64), words.doc[again])]
    flat = np.concatenate([(doc.astype(np.int64) << BITS) | (mix(mix(h + np.uint64(i + 1)) + np.uint64(i)) >> np.uint64(
        64 - BITS)).astype(np.int64) for i, (h, doc) in enumerate(kinds)])
    flat, count = np.unique(flat, return_counts=True)
    return flat >> BITS, flat & (BUCKETS - 1), count, rows


@dataclass
class Model:
    idf: np.ndarray
    space: np.ndarray  # features x dimensions
    vectors: np.ndarray  # labelled documents x dimensions, of unit length
    labels: np.ndarray
    share: float
    k: int = 25
    sharpness: float = 4.0
    prior: float = 0.5

    def project(self, column) -> np.ndarray:
        row, at, count, rows = features(column)
        out = np.zeros((rows, self.space.shape[1]), np.float32)
        weight = ((1 + np.log(count)) * self.idf[at]).astype(np.float32)
        starts = group_starts(row)
        edges = np.append(starts, len(row))
        for b in range(0, len(starts), _BLOCK):  # bounds the gathered rows of the space
            s = slice(edges[b], edges[min(b + _BLOCK, len(starts))])
            out[row[starts[b:b + _BLOCK]]] = np.add.reduceat(
                weight[s, None] * self.space[at[s]], starts[b:b + _BLOCK] - s.start, axis=0)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    def scores(self, column) -> np.ndarray:
        docs = self.project(column)
        out = np.full(len(docs), self.share)
        k = min(self.k, len(self.labels))
        if not k:
            return out
        for b in range(0, len(docs), _BLOCK):
            part = docs[b:b + _BLOCK]
            near = part @ self.vectors.T
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(float) ** self.sharpness
            good = (weight * self.labels[best]).sum(axis=1)
            out[b:b + _BLOCK] = (good + self.prior * self.share) / (weight.sum(axis=1) + self.prior)
        return out


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(BUCKETS, np.int64), 0
    for whole in batches:
        for batch in row_slices(whole, "text"):
            _, at, _, rows = features(batch.column("text"))
            df += np.bincount(at, minlength=BUCKETS)
            docs += rows
    if docs:
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(list(range(_PARTS)), pa.int32()), "docs": pa.array([docs] * _PARTS, pa.int64()),
            "df": pa.array([x.tobytes() for x in df.reshape(_PARTS, -1)], pa.binary())})


def _sum_presence(table: pa.Table) -> pa.Table:
    df = sum(np.frombuffer(x, np.int64) for x in table["df"].to_pylist())
    return pa.table({"part": table["part"].slice(0, 1), "docs": pa.array([int(np.sum(table["docs"].to_numpy()))]),
                     "df": pa.array([df.tobytes()], pa.binary())})


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """idf of every feature over all rows (column text); of fixed size whatever the input."""
    rows = (docs.select("text").mapInArrow(_presence, "part int, docs long, df binary").groupBy("part")
            .applyInArrow(_sum_presence, "part int, docs long, df binary").orderBy("part").collect())
    if not rows:
        return np.zeros(BUCKETS)
    df = np.concatenate([np.frombuffer(r.df, np.int64) for r in rows])
    return np.log((1 + rows[0].docs) / (1 + df))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in row_slices(whole, "text"):
            row, at, count, rows = features(batch.column("text"))
            edges = np.searchsorted(row, np.arange(rows + 1))
            part = [(at[s:e].astype(np.int16).tobytes(), count[s:e].astype(np.int32).tobytes())
                    for s, e in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "label": batch.column("label"),
                                              "at": pa.array([p[0] for p in part], pa.binary()),
                                              "count": pa.array([p[1] for p in part], pa.binary())})


def latent_space(x: np.ndarray, dimensions: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors of ``x``, by subspace iteration from a fixed start."""
    start = np.random.default_rng(0).standard_normal((x.shape[0], min(dimensions + 16, *x.shape))).astype(np.float32)
    basis, _ = np.linalg.qr(x.T @ start)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ turn.T)[:, :dimensions].astype(np.float32)


def _trainer(idf: np.ndarray, dimensions: int):
    def train(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["key"].to_pylist(), table["label"].to_pylist(), table["at"].to_pylist(),
                          table["count"].to_pylist(), strict=True))  # the same order on every run
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, (_, _, at, count) in enumerate(rows):
            at = np.frombuffer(at, np.int16)
            x[i, at] = (1 + np.log(np.frombuffer(count, np.int32))) * idf[at]
        length = np.linalg.norm(x, axis=1, keepdims=True)
        np.divide(x, length, out=x, where=length > 0)
        space = latent_space(x, dimensions)
        return pa.table({"space": pa.array([space.tobytes()], pa.binary()),
                         "vectors": pa.array([(x @ space).tobytes()], pa.binary()),
                         "labels": pa.array([np.array([r[1] for r in rows], np.float64).tobytes()], pa.binary()),
                         "dimensions": pa.array([space.shape[1]], pa.int32())})
    return train


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id",
        label_col: str = "quality", neighbours_kept: int = NEIGHBOURS_KEPT, dimensions: int = DIMENSIONS) -> Model:
    """Learn from labelled rows where ``learn`` (on the id) holds; idf from all of ``docs``."""
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = (labels.where(F.coalesce(learn, F.lit(False)) & F.col(f"`{label_col}`").isin(0, 1))
             .groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(f"`{label_col}`").cast("int").alias("label")))
    n, ones = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    idf = inverse_frequencies(text)
    nothing = Model(idf, np.zeros((BUCKETS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    if not n:
        return nothing
    key = F.xxhash64(F.col("id").cast("string"), F.lit("sample"))
    chosen = known.withColumn("key", key).where(
        F.pmod("key", F.lit(1 << 30)) / float(1 << 30) < min(1.0, neighbours_kept / n))
    sample = text.where(F.col("text").isNotNull()).join(chosen, "id").select("key", "label", "text")
    vectors = written(sample.mapInArrow(_vectors, "key long, label int, at binary, count binary"), "labelled")
    row = vectors.withColumn("all", F.pmod("key", F.lit(1))).groupBy("all").applyInArrow(
        _trainer(idf, dimensions), "space binary, vectors binary, labels binary, dimensions int").first()
    if row is None:
        return nothing
    found = np.frombuffer(row.vectors, np.float32).reshape(-1, row.dimensions).copy()
    length = np.linalg.norm(found, axis=1, keepdims=True)
    np.divide(found, length, out=found, where=length > 0)
    return Model(idf, np.frombuffer(row.space, np.float32).reshape(BUCKETS, -1), found, np.frombuffer(row.labels),
                 float(ones) / n)


def score(docs: DataFrame, model: Model, text_col: str = "text", run_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with score and predicted after its own columns (columns of these names are replaced)."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, text_col, run_bytes):
                p = shared.value.scores(batch.column(text_col))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                    names=[*batch.schema.names, "score", "predicted"])
    return docs.mapInArrow(run, StructType(list(docs.schema)).add("score", "double").add("predicted", "integer"))
