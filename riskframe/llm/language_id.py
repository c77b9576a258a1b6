"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Text is lower-cased code points with every run of non-letters as one gap;
2-grams and 3-grams are hashed to ``BUCKETS`` features.  Features are weighted
by term frequency (share of the text's n-grams) times inverse document
frequency, counted over *all* documents that may be learned from.  Weights are
trained by follow-the-regularised-leader (FTRL-proximal, per-coordinate rates)
under an elastic-net penalty, on ``per_language`` documents a language chosen by
hash; a fifth of them is held out to fit one temperature for the softmax.

Prediction needs no shuffle: every document is scored where it lies, by a model
of fixed size (features x languages).

Texts longer than a run are counted piece by piece, so memory follows the run.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
a document with a null id or language is predicted but not learned from; ties
go to the language first by code point; repeated rows are separate documents;
an empty table, or nothing to learn from, gives ``und`` everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, group_sizes, group_starts, mix, row_slices, utf8, written

BITS = 16
BUCKETS = 1 << BITS
#: Bound of the training sample: expected documents of each language.
PER_LANGUAGE = 1200
#: Texts longer than this are counted piece by piece.
RUN_BYTES = 1 << 20
#: Bytes of shorter texts in one kernel call: n-gram arrays take up to a hundred bytes per byte of text.
SLICE_BYTES = 1 << 18
_PARTS = 16  # ranges of features whose counts are summed together
_FOLD: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Code point to lower-case letter, or 0 for a non-letter."""
    if not _FOLD:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def ngrams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all rows, their rows (ascending), and which rows have letters."""
    data, offsets = utf8(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    edges = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    rows = len(offsets) - 1
    doc = np.repeat(np.arange(rows), np.diff(edges))
    folded = _folded()[points]
    letters = np.bincount(doc, folded > 0, minlength=rows) > 0
    keep = folded > 0
    keep[1:] |= (folded[:-1] > 0) & (doc[1:] == doc[:-1])  # one gap after each run of letters
    c, doc = folded[keep].astype(np.uint64), doc[keep]
    out, rows_of = [], []
    for n in (2, 3):
        if len(c) < n:
            continue
        key = np.zeros(len(c) - n + 1, np.uint64)
        for t in range(n):
            key = (key << np.uint64(21)) | c[t:len(c) - n + 1 + t]
        same = doc[n - 1:] == doc[:len(c) - n + 1]
        out.append((mix(key + np.uint64(n)) >> np.uint64(64 - BITS))[same].astype(np.int64))
        rows_of.append(doc[:len(c) - n + 1][same])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    grams, doc = np.concatenate(out), np.concatenate(rows_of)
    order = np.argsort(doc, kind="stable")
    return grams[order], doc[order], letters


def long_counts(column) -> tuple[np.ndarray, bool]:
    """N-gram counts of one text, piece by piece, and whether it has letters; as :func:`ngrams` would give them."""
    data, _ = utf8(column)
    counts, letters = np.zeros(BUCKETS, np.int64), False
    tail, after_letter, at = np.zeros(0, np.uint64), False, 0
    while at < len(data):
        end = min(at + RUN_BYTES, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        points = np.frombuffer(data[at:end].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        folded = _folded()[points]
        is_letter = folded > 0
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[0] |= after_letter
        letters, after_letter = letters or bool(is_letter.any()), bool(is_letter[-1])
        c = np.concatenate([tail, folded[keep].astype(np.uint64)])
        for n in (2, 3):  # those that end in this piece
            first = max(0, len(tail) - n + 1)
            size = len(c) - n + 1 - first
            if size > 0:
                key = np.zeros(size, np.uint64)
                for t in range(n):
                    key = (key << np.uint64(21)) | c[first + t:first + t + size]
                counts += np.bincount((mix(key + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64),
                                      minlength=BUCKETS)
        tail, at = c[-2:], end
    return counts, letters


def _is_long(batch: pa.RecordBatch, text: str = "text") -> bool:
    """Whether a slice is one text that is read piece by piece."""
    return batch.num_rows == 1 and (pc.binary_length(batch.column(text))[0].as_py() or 0) > RUN_BYTES


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages, with the idf inside
    bias: np.ndarray
    temperature: float

    def scores(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Language index (-1: undetermined) and calibrated probability of each row."""
        grams, doc, letters = ngrams(column)
        rows = len(letters)
        logits = np.tile(self.bias, (rows, 1))
        starts = group_starts(doc)
        if len(starts):
            n = group_sizes(starts, len(doc))
            for i in range(len(self.languages)):
                logits[doc[starts], i] += np.add.reduceat(self.weights[grams, i], starts) / n
        return self._calibrated(logits, letters)

    def long_score(self, column) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`scores` of one long text."""
        counts, letters = long_counts(column)
        logits = self.bias + (counts @ self.weights) / max(1, counts.sum())
        return self._calibrated(logits[None], np.array([letters]))

    def _calibrated(self, logits: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(letters)
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1) if p.shape[1] else np.zeros(rows, int)
        known = letters & (len(self.languages) > 0)
        return np.where(known, best, -1), np.where(known, p.max(axis=1, initial=0), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True, initial=-np.inf))
    return e / e.sum(axis=1, keepdims=True)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's documents hold each feature, as ranges of the feature space."""
    df, seen, docs = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, bool), 0
    for whole in batches:
        for batch in row_slices(whole, "text", SLICE_BYTES):
            docs += batch.num_rows
            if _is_long(batch):
                df += long_counts(batch.column("text"))[0] > 0
                continue
            grams, doc, letters = ngrams(batch.column("text"))
            starts = group_starts(doc)
            for s, n in zip(starts.tolist(), group_sizes(starts, len(doc)).tolist(), strict=True):
                seen[:] = False
                seen[grams[s:s + n]] = True
                df += seen
    if docs:
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(list(range(_PARTS)), pa.int32()), "docs": pa.array([docs] * _PARTS, pa.int64()),
            "df": pa.array([x.tobytes() for x in df.reshape(_PARTS, -1)], pa.binary())})
    give_back()


def _sum_presence(table: pa.Table) -> pa.Table:
    df = sum(np.frombuffer(x, np.int64) for x in table["df"].to_pylist())
    docs = int(np.sum(table["docs"].to_numpy()))
    return pa.table({"part": table["part"].slice(0, 1), "docs": pa.array([docs], pa.int64()),
                     "df": pa.array([df.tobytes()], pa.binary())})


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + frequency)) over all rows (column text); fixed size whatever the input."""
    rows = (docs.select("text").mapInArrow(_presence, "part int, docs long, df binary").groupBy("part")
            .applyInArrow(_sum_presence, "part int, docs long, df binary").orderBy("part").collect())
    if not rows:
        return np.zeros(BUCKETS)
    df = np.concatenate([np.frombuffer(r.df, np.int64) for r in rows])
    return np.log((1 + rows[0].docs) / (1 + df))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse counts of the sampled documents."""
    for whole in batches:
        for batch in row_slices(whole, "text", SLICE_BYTES):
            at, count, found = [], [], []
            if _is_long(batch):
                counts = long_counts(batch.column("text"))[0]
                found.append((np.flatnonzero(counts), counts[counts > 0]))
            else:
                grams, doc, _ = ngrams(batch.column("text"))
                edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                found += [np.unique(grams[edges[r]:edges[r + 1]], return_counts=True) for r in range(batch.num_rows)]
            for f, c in found:
                at.append(f.astype(np.int32).tobytes())
                count.append(c.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "lang": batch.column("lang"),
                                              "at": pa.array(at, pa.binary()), "count": pa.array(count, pa.binary())})
    give_back()


def train_ftrl(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5,
               beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal for softmax regression: weights (features x classes) and bias.

    ``l1`` keeps unused and weak weights at exactly 0; ``l2`` shrinks the rest.
    """
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def solve(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(samples)):
            at, x, y = samples[i]
            zs, ns = z[at], n[at]
            w = solve(zs, ns)
            p = softmax((x @ w)[None])[0]
            p[y] -= 1
            g = x[:, None] * p
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[at] = more
    w = solve(z, n)
    return w[:BUCKETS], w[BUCKETS]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The softmax temperature of the smallest log loss (geometric grid, refined)."""
    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean())
    grid = np.geomspace(0.05, 20, 61)
    best = min(grid, key=loss)
    return float(min(np.geomspace(best / 1.2, best * 1.2, 41), key=loss))


#: TF-IDF values are shares of a text; this brings them near 1 for the learning rates.
_SCALE = 100.0


def _trainer(idf: np.ndarray, languages: list[str]):
    def train(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["key"].to_pylist(), table["lang"].to_pylist(), table["at"].to_pylist(),
                          table["count"].to_pylist(), strict=True))  # the same order on every run
        place = {x: i for i, x in enumerate(languages)}
        samples = []
        for _, lang, at, count in rows:
            at, count = np.frombuffer(at, np.int32), np.frombuffer(count, np.int32)
            if len(at):
                x = _SCALE * count / count.sum() * idf[at]
                samples.append((np.append(at, BUCKETS), np.append(x, 1.0), place[lang]))
        held = samples[::5] if len(samples) >= 50 else []
        w, bias = train_ftrl([s for i, s in enumerate(samples) if i % 5 or not held], len(languages))
        full = np.vstack([w, bias])
        logits = np.array([x @ full[at] for at, x, _ in held])
        t = fit_temperature(logits, np.array([y for _, _, y in held])) if held else 1.0
        del rows, samples, held
        give_back()
        return pa.table({"weights": pa.array([w.tobytes()], pa.binary()), "bias": pa.array([bias.tobytes()], pa.binary()),
                         "temperature": pa.array([t])})
    return train


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        per_language: int = PER_LANGUAGE) -> Model:
    """Train on rows where ``learn`` holds and the language is not null."""
    usable = docs.where(F.coalesce(learn, F.lit(False))).select(
        F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"),
        F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit("sample")).alias("key")).where("lang is not null")
    counts = {r.lang: r["n"] for r in usable.where("text is not null").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    idf = inverse_frequencies(usable.where("text is not null"))
    share = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, per_language / counts[lang]))])
    part = F.pmod("key", F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(F.col("text").isNotNull() & (part < share[F.col("lang")]))
    vectors = written(sample.mapInArrow(_vectors, "key long, lang string, at binary, count binary"), "sample")
    row = vectors.withColumn("all", F.pmod("key", F.lit(1))).groupBy("all").applyInArrow(
        _trainer(idf, languages), "weights binary, bias binary, temperature double").first()
    if row is None:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    weights = np.frombuffer(row.weights).reshape(BUCKETS, -1) * idf[:, None] * _SCALE
    return Model(languages, weights, np.frombuffer(row.bias), row.temperature)


def predict(docs: DataFrame, model: Model, text_col: str = "text", run_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` with lang_pred and score after its own columns (columns of these names are replaced).

    Only the text goes to the Python workers; other columns stay where they are.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array([*shared.value.languages, "und"], object)
        for text in texts:
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for batch in row_slices(pa.RecordBatch.from_arrays([text], names=["text"]), "text", run_bytes):
                read = shared.value.long_score if _is_long(batch) else shared.value.scores
                for column, value in zip((best, score), read(batch.column("text")), strict=True):
                    column.append(value)
            yield pa.StructArray.from_arrays(
                [pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score), pa.float64())],
                names=["lang_pred", "score"])
        give_back()
    name = "found"
    while name in docs.columns:
        name += "_"
    out = docs.withColumn(name, found(F.col(f"`{text_col}`")))
    return out.select(*[f"`{c}`" for c in docs.columns], f"{name}.lang_pred", f"{name}.score")


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the held-out part (a null id: no)."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(parts)) == part, F.lit(False))
