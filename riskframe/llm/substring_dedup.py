"""Substring dedup by difference-cover anchors.

Remove every word covered by a run of ``window`` words that also starts in a
document with a smaller id.

Method.  ``COVER`` is a difference cover modulo ``PERIOD``: any two positions
can be moved by the same 0..PERIOD-1 so that both fall on cover positions.
Two equal windows therefore share an aligned anchor of
``window - PERIOD + 1`` words, and only the anchors at cover positions (3 of
7) are hashed and shuffled.

1. Each chunk of documents sends its distinct anchor hashes to key-range
   buckets (sorted blobs: one entry per anchor and chunk, so a passage that a
   third of the corpus holds costs one entry per chunk).
2. A bucket answers each chunk with the anchors that other rows hold too.
3. The chunk extends those anchors to all windows around them, and sends the
   windows' 96-bit hashes with the smallest id it has for each.
4. A bucket answers with the windows that a smaller id of another chunk holds.
5. The chunk covers words from these answers and from its own rows.

All three passes over the documents use the same exchange by chunk, so text is
shuffled once (Spark reuses the exchange).  Nothing is capped and nothing is
collected; the numbers of chunks and buckets follow the input's bytes.

Defined cases: null or empty text has no words (kept text empty); a null id
sorts after every other id; rows with equal ids never remove each other's
words; repeated rows give one result row each; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (CHUNK_BYTES, NO_ID, Words, blobs, by_bucket, chunked, group_sizes, group_starts, member, run_hashes,
                     span_hashes, strings, text_bytes, utf8)

PERIOD = 7
COVER = (0, 1, 3)
#: Bytes of anchor hashes that one bucket should hold.
BUCKET_BYTES = 8 << 20
_F1, _F2, _F3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD
_REPLY = np.dtype([("a", "<u8"), ("b", "<u4")])


def _parsed(table: pa.Table):
    words = Words(*utf8(table["text"]))
    ids = table["id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    return words, span_hashes(words.data, words.start, words.end), ids


def _anchors(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    size = window - PERIOD + 1
    ok = np.isin(words.rank % PERIOD, COVER) & (words.rank + size <= words.count[words.doc])
    at = np.flatnonzero(ok & (words.count[words.doc] >= window))
    return at, run_hashes(hashes, at, size, _F1) & ~np.uint64(1)


def _windows(words: Words, hashes: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return run_hashes(hashes, at, window, _F2), run_hashes(hashes, at, window, _F3).astype(np.uint32)


def _planes(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> bytes:
    """Column by column, ids byte by byte: the ids' equal high bytes then compress to nothing."""
    return a.tobytes() + b.tobytes() + ids.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(blob) // 20
    ids = np.frombuffer(blob, np.uint8, 8 * n, 12 * n).reshape(8, n).T.copy().view("<i8").ravel()
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.uint32, n, 8 * n), ids


def _send(sorted_keys: np.ndarray, payload, chunk: int, buckets: int) -> pa.Table:
    """``payload`` gives the bytes of a slice of the sorted keys' entries."""
    rows = [(b, payload(s)) for b, s in by_bucket(sorted_keys, buckets)]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()),
                     "chunk": pa.array([chunk] * len(rows), pa.int32()),
                     "blob": pa.array([r[1] for r in rows], pa.binary())})


def _answers(chunk: np.ndarray, items: np.ndarray) -> pa.Table:
    order = np.argsort(chunk, kind="stable")
    chunk, items = chunk[order], items[order]
    starts = group_starts(chunk)
    ends = starts + group_sizes(starts, len(chunk))
    return pa.table({"chunk": pa.array(chunk[starts], pa.int32()),
                     "blob": pa.array([items[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())})


def _anchor_sender(window: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        words, hashes, _ = _parsed(table)
        at, keys = _anchors(words, hashes, window)
        order = np.argsort(keys, kind="stable")
        keys, doc = keys[order], words.doc[at][order]
        starts = group_starts(keys)
        ends = starts + group_sizes(starts, len(keys)) - 1
        several = (doc[starts] != doc[ends]).astype(np.uint64) if len(keys) else np.zeros(0, np.uint64)
        keys = keys[starts]
        return _send(keys, lambda s: (keys[s] | several[s]).tobytes(), table["chunk"][0].as_py(), buckets)
    return send


def _shared_anchors(table: pa.Table) -> pa.Table:
    marked, row = blobs(table["blob"], np.uint64)
    chunk = table["chunk"].to_numpy()[row]
    keys = marked & ~np.uint64(1)
    order = np.argsort(keys, kind="stable")
    keys, chunk, several = keys[order], chunk[order], (marked[order] & np.uint64(1)) == 1
    starts = group_starts(keys)
    sizes = group_sizes(starts, len(keys))
    shared = (sizes > 1) | (np.logical_or.reduceat(several, starts) if len(starts) else np.zeros(0, bool))
    keep = np.repeat(shared, sizes)
    return _answers(chunk[keep], keys[keep])


def _window_sender(window: int, buckets: int):
    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table) or not len(replies):
            return _send(np.zeros(0, np.uint64), None, 0, buckets)
        words, hashes, ids = _parsed(table)
        at, keys = _anchors(words, hashes, window)
        at = at[member(keys, np.sort(blobs(replies["blob"], np.uint64)[0]))]
        wanted = np.zeros(len(words.start), bool)
        for back in range(PERIOD):
            j = at - back
            fits = (words.rank[at] >= back) & (words.rank[at] - back + window <= words.count[words.doc[at]])
            wanted[j[fits]] = True
        j = np.flatnonzero(wanted)
        a, b = _windows(words, hashes, j, window)
        owner = ids[words.doc[j]]
        order = np.lexsort((owner, b, a))
        a, b, owner = a[order], b[order], owner[order]
        starts = group_starts(a, b)
        a, b, owner = a[starts], b[starts], owner[starts]
        return _send(a, lambda s: _planes(a[s], b[s], owner[s]), table["chunk"][0].as_py(), buckets)
    return send


def _held_before(table: pa.Table) -> pa.Table:
    parts = [_unplaned(x) for x in table["blob"].to_pylist()]
    chunk = np.repeat(table["chunk"].to_numpy(), [len(p[0]) for p in parts])
    a, b, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((ids, b, a))
    a, b, ids, chunk = a[order], b[order], ids[order], chunk[order]
    starts = group_starts(a, b)
    late = np.repeat(ids[starts], group_sizes(starts, len(a))) < ids
    out = np.empty(int(late.sum()), _REPLY)
    out["a"], out["b"] = a[late], b[late]
    return _answers(chunk[late], out)


def _remover(window: int):
    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
                             "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        words, hashes, ids = _parsed(table)
        at = np.flatnonzero(words.rank + window <= words.count[words.doc])
        a, b = _windows(words, hashes, at, window)
        owner = ids[words.doc[at]]
        known = np.sort(blobs(replies["blob"], _REPLY)[0], order=("a", "b")) if len(replies) else np.zeros(0, _REPLY)
        hit = np.zeros(len(at), bool)
        maybe = np.flatnonzero(member(a, known["a"].copy()))  # few; exact on both halves below
        if len(maybe):
            pairs = np.empty(len(maybe), _REPLY)
            pairs["a"], pairs["b"] = a[maybe], b[maybe]
            hit[maybe] = np.isin(pairs.view("V12"), known.view("V12"))
        order = np.argsort(a, kind="stable")
        sizes = group_sizes(group_starts(a[order]), len(at))
        twice = order[np.repeat(sizes > 1, sizes)]
        twice = twice[np.lexsort((owner[twice], b[twice], a[twice]))]
        starts = group_starts(a[twice], b[twice])
        smallest = np.repeat(owner[twice][starts], group_sizes(starts, len(twice)))
        hit[twice] |= smallest < owner[twice]
        depth = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(depth, at[hit], 1)
        np.add.at(depth, at[hit] + window, -1)
        keep = np.cumsum(depth)[:-1] == 0
        data, offsets = _joined(words, keep)
        kept = np.bincount(words.doc[keep], minlength=len(ids))
        return pa.table({"id": table["id"].combine_chunks(), "n_words": pa.array(words.count, pa.int64()),
                         "n_removed": pa.array(words.count - kept, pa.int64()), "kept_text": strings(data, offsets)})
    return remove


def _joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each row joined by single spaces, as bytes and offsets."""
    start, end, doc = words.start[keep], words.end[keep], words.doc[keep]
    step = np.zeros(len(words.data) + 1, np.int8)
    step[start] += 1
    np.subtract.at(step, end, 1)
    chosen = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    data = words.data.copy()
    later = np.zeros(len(start), bool)
    later[1:] = doc[1:] == doc[:-1]
    gap = start[later] - 1  # the separator before a kept word that is not its row's first kept one
    data[gap] = 0x20
    chosen[gap] = True
    return data[chosen], np.append(0, np.cumsum(chosen))[words.offsets]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13,
                   chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``id_col``, n_words, n_removed and kept_text for every row of ``docs``.

    ``window`` must exceed ``PERIOD``; see the module docstring for the method
    and the defined cases.
    """
    if window <= PERIOD:
        raise ValueError(f"window must be over {PERIOD}")
    _, total = text_bytes(docs, text_col)
    buckets = max(1, -(-total // (2 * bucket_bytes)))  # anchors weigh about half a byte per byte of text
    parts = chunked(docs, total, [F.col(f"`{id_col}`").cast("long").alias("id"),
                                  F.col(f"`{text_col}`").alias("text")], chunk_bytes)
    chunks = parts.groupBy("chunk")
    sent, reply = "bucket int, chunk int, blob binary", "chunk int, blob binary"
    anchors = chunks.applyInArrow(_anchor_sender(window, buckets), sent)
    shared = anchors.groupBy("bucket").applyInArrow(_shared_anchors, reply)
    windows = chunks.cogroup(shared.groupBy("chunk")).applyInArrow(_window_sender(window, buckets), sent)
    late = windows.groupBy("bucket").applyInArrow(_held_before, reply)
    out = chunks.cogroup(late.groupBy("chunk")).applyInArrow(
        _remover(window), "id long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("id", id_col)
