"""N-gram Jaccard join by grouped prefixes.

Documents are sets of word shingles; two link when their Jaccard similarity is
at least ``percent`` / 100.  Result: one row per document with its component.

1. Documents with equal sets are one class (128-bit set fingerprint, size).
2. Document frequencies of all shingles over the classes: each chunk of
   documents sends its distinct shingles once (sorted blobs to key-range
   buckets), and learns which ones other classes hold too, and how often.
3. Shingles are ordered rare first.  Two linked sets share one of their first
   n - ceil(t n) + 1 shingles, so a class whose prefix holds nobody else's
   shingle has no partner, and drops out here.
4. The others are collapsed into groups with identical prefix and size.
   Group pairs come from shared prefix shingles under the size filter and the
   positional filter; then members are expanded and verified on whole sets.

Pairs inside a hot group are not all emitted.  First each group's members meet
its first member, and each group meets one hub that shares a prefix shingle
with it; that joins large families by stars.  Then only pairs of *different*
components that share a prefix shingle are expanded, all of them, so no link
between components can be lost.

Defined cases: null and empty texts have no shingles and link with nothing;
texts under ``size`` words are one shingle (the whole sequence); ties do not
matter (all comparisons are exact integers); repeated rows share a class; a
null id takes part, sorts last and has a null component only where every
member's id is null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (CHUNK_BYTES, NO_ID, Words, blobs, by_bucket, chunked, give_back, group_sizes, group_starts, member,
                     mix, row_slices, run_hashes, span_hashes, text_bytes, utf8, written)
from .graph import components

#: Bytes of text that are fingerprinted at a time: their arrays take up to forty bytes per byte of text.
PRINT_BYTES = 1 << 20
#: Bytes of shingle hashes that one bucket should hold.
BUCKET_BYTES = 8 << 20
_F = 0x9E3779B97F4A7C15
_A, _B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRINT = np.dtype([("a", "<i8"), ("b", "<i8")])


class ShingleSets:
    """Distinct shingle hashes of each row, sorted within the row."""

    def __init__(self, text: pa.ChunkedArray, size: int):
        data, offsets = utf8(text)
        words = Words(_LOWER[data], offsets)
        hashes = span_hashes(words.data, words.start, words.end)
        at = np.flatnonzero(words.rank + size <= words.count[words.doc])
        keys, doc = run_hashes(hashes, at, size, _F), words.doc[at]
        short = np.flatnonzero((words.count > 0) & (words.count < size))
        if len(short):  # few: the whole sequence, and its length, as one shingle
            whole = [int(run_hashes(hashes, words.first[[d]], int(words.count[d]), _F)[0]) for d in short]
            whole = mix(np.array(whole, np.uint64) + words.count[short].astype(np.uint64))
            keys, doc = np.append(keys, whole), np.append(doc, short)
            order = np.argsort(doc, kind="stable")
            keys, doc = keys[order], doc[order]
        edges = np.searchsorted(doc, np.arange(len(offsets)))
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            keys[s:e].sort()
        new = np.zeros(len(keys), bool)
        new[group_starts(doc, keys)] = True
        self.keys, self.doc = keys[new], doc[new]
        self.edges = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.n = np.diff(self.edges)
        self.prints = np.zeros(len(self.n), _PRINT)
        full = np.flatnonzero(self.n)
        if len(full):
            for field, salt in (("a", _A), ("b", _B)):
                self.prints[field][full] = np.add.reduceat(mix(self.keys ^ salt), self.edges[full]).view(np.int64)

    def firsts(self, dropped: np.ndarray) -> np.ndarray:
        """Rows that stand for their class here: non-empty, not dropped, first of equal rows."""
        _, first = np.unique(self.prints, return_index=True)
        rows = np.sort(first)
        rows = rows[self.n[rows] > 0]
        return rows[~np.isin(self.prints[rows].view("V16"), dropped.view("V16"))]


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text", PRINT_BYTES):
                sets = ShingleSets(batch.column("text"), size)
                yield pa.RecordBatch.from_pydict({
                    "chunk": batch.column("chunk"), "id": batch.column("id"), "n": pa.array(sets.n, pa.int64()),
                    "a": pa.array(sets.prints["a"].copy()), "b": pa.array(sets.prints["b"].copy())})
                del sets
        give_back()
    return run


def _dropped(notes: pa.Table) -> np.ndarray:
    drops = notes.filter(pa.compute.is_null(notes["blob"])) if "blob" in notes.column_names else notes
    out = np.empty(len(drops), _PRINT)
    out["a"], out["b"] = drops["a"].to_numpy(), drops["b"].to_numpy()
    return out


def _shift(buckets: int) -> int:
    """Low bits of a shingle hash that frequency counting leaves out: offsets in a bucket then fit 40 bits."""
    return max(0, 64 - 39 - (buckets.bit_length() - 1))


def _planes(keys: np.ndarray, counts: np.ndarray, base: int, shift: int) -> bytes:
    """Key offsets in their bucket as five byte planes, then the counts: compresses better than rows."""
    offset = (keys - np.uint64(base)) >> np.uint64(shift)
    width = [((offset >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8).tobytes() for i in range(4, -1, -1)]
    return b"".join(width) + np.minimum(counts, 255).astype(np.uint8).tobytes()


def _unplaned(blob: bytes, base: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(blob, np.uint8).reshape(6, -1)
    keys = np.zeros(planes.shape[1], np.uint64)
    for p in planes[:5]:
        keys = (keys << np.uint64(8)) | p
    return (keys << np.uint64(shift)) + np.uint64(base), planes[5].astype(np.int64)


def _bucket_base(b: int, buckets: int, shift: int) -> int:
    return (((1 << 64) // buckets + 1) * b) >> shift << shift


def _shingle_sender(size: int, buckets: int):
    shift = _shift(buckets)

    def send(table: pa.Table, drops: pa.Table) -> pa.Table:
        out = []
        if len(table):
            sets = ShingleSets(table["text"], size)
            use = np.zeros(len(sets.n), bool)
            use[sets.firsts(_dropped(drops))] = True
            keys, counts = np.unique(sets.keys[use[sets.doc]] >> np.uint64(shift) << np.uint64(shift),
                                     return_counts=True)
            out = [(b, _planes(keys[s], counts[s], _bucket_base(b, buckets, shift), shift))
                   for b, s in by_bucket(keys, buckets)]
            del sets, use, keys, counts
            give_back()
        chunk = table["chunk"][0].as_py() if out else 0
        return pa.table({"bucket": pa.array([r[0] for r in out], pa.int32()),
                         "chunk": pa.array([chunk] * len(out), pa.int32()),
                         "blob": pa.array([r[1] for r in out], pa.binary())})
    return send


def _frequencies(buckets: int):
    shift = _shift(buckets)

    def count(table: pa.Table) -> pa.Table:
        """Tell each chunk its shingles of frequency 2 or more: 8-byte keys, then one byte of 8 log2(frequency)."""
        base = _bucket_base(table["bucket"][0].as_py(), buckets, shift)
        parts = [_unplaned(x, base, shift) for x in table["blob"].to_pylist()]
        chunk = np.repeat(table["chunk"].to_numpy(), [len(k) for k, _ in parts])
        keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, counts, chunk = keys[order], counts[order], chunk[order]
        starts = group_starts(keys)
        sizes = group_sizes(starts, len(keys))
        total = np.add.reduceat(counts, starts)
        level = np.minimum(255, np.floor(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
        keep = np.repeat(total > 1, sizes)
        keys, chunk, level = keys[keep], chunk[keep], np.repeat(level, sizes)[keep]
        order = np.argsort(chunk, kind="stable")
        keys, chunk, level = keys[order], chunk[order], level[order]
        starts = group_starts(chunk)
        ends = starts + group_sizes(starts, len(chunk))
        return pa.table({"chunk": pa.array(chunk[starts], pa.int32()), "blob": pa.array(
            [keys[s:e].tobytes() + level[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())})
    return count


_CANDIDATE = "a long, b long, n long, prefix long, tokens array<long>, places array<int>, members binary"


def _prefixer(size: int, percent: int, buckets: int):
    shift = _shift(buckets)

    def pick(table: pa.Table, notes: pa.Table) -> pa.Table:
        out = {k: [] for k in ("a", "b", "n", "prefix", "tokens", "places", "members")}
        if len(table):
            sets = ShingleSets(table["text"], size)
            replies = [x for x in notes["blob"].to_pylist() if x is not None] if len(notes) else []
            known = np.concatenate([np.frombuffer(x[:len(x) // 9 * 8], np.uint64) for x in replies] or [
                np.zeros(0, np.uint64)])
            level = np.concatenate([np.frombuffer(x[len(x) // 9 * 8:], np.uint8) for x in replies] or [
                np.zeros(0, np.uint8)])
            order = np.argsort(known)
            known, level = known[order], level[order]
            cut = sets.keys >> np.uint64(shift) << np.uint64(shift)
            shared = member(cut, known)
            rows = sets.firsts(_dropped(notes))
            length = sets.n - -(-percent * sets.n // 100) + 1
            rows = rows[100 * sets.n[rows] >= percent * (sets.n[rows] + 1)]  # smaller sets link with equal ones only
            lone = np.bincount(sets.doc[~shared], minlength=len(sets.n))
            for r in rows[lone[rows] < length[rows]].tolist():
                s = slice(sets.edges[r], sets.edges[r + 1])
                keys, ok = sets.keys[s], shared[s]
                rank = np.zeros(len(keys), np.uint8)
                rank[ok] = level[np.searchsorted(known, cut[s][ok])]
                first = np.lexsort((keys, rank))[:length[r]]
                places = np.flatnonzero(rank[first]).astype(np.int32)
                head = keys[first]
                out["a"].append(int(sets.prints["a"][r]))
                out["b"].append(int(sets.prints["b"][r]))
                out["n"].append(int(sets.n[r]))
                out["prefix"].append(int(run_hashes(head, np.zeros(1, np.int64), len(head), _F).view(np.int64)[0]))
                out["tokens"].append(head[places].view(np.int64))
                out["places"].append(places)
                out["members"].append(keys.tobytes())
            del sets, known, level, order, cut, shared, lone
            give_back()
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})
    return pick


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = int(member(x, y).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_pydict({k: batch.column(k).filter(pa.array(keep, pa.bool_())) for k in "ab"})
        give_back()
    return verify


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of class numbers whose whole sets are similar enough."""
    full = (pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            .join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y"))
    return full.mapInArrow(_verifier(percent), "a long, b long")


def _may_link(x: str, y: str, percent: int):
    """Size and positional filter for two sets that share a shingle at these places."""
    n, m, i, j = f"{x}.n", f"{y}.n", f"{x}.place", f"{y}.place"
    common = F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
    return ((100 * F.least(n, m) >= percent * F.greatest(n, m))
            & ((100 + percent) * common >= percent * (F.col(n) + F.col(m))))


def _labels(heads: DataFrame, found: DataFrame) -> DataFrame:
    """node, grp, label of every class under the links found so far."""
    return written(heads.select("node", "grp").join(components(found), "node", "left")
                   .withColumn("label", F.coalesce("label", "node")), "labels")


def links(sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) of class numbers that connect all linked classes.

    ``sets``: node, n, prefix, tokens, places, members.
    """
    groups = sets.groupBy("n", "prefix").agg(F.min("node").alias("grp"))
    heads = written(sets.select("node", "n", "prefix", "tokens", "places").join(groups, ["n", "prefix"]),
                    "prefix-groups")
    tokens = written(heads.where("node = grp").select("grp", "n", F.explode(F.arrays_zip("tokens", "places")).alias("t"))
                     .select("grp", "n", F.col("t.tokens").alias("token"), F.col("t.places").alias("place")), "tokens")
    # stars: members meet their group's first; each group meets one hub of another component that
    # shares a prefix shingle with it.  The hub of a shingle is the group that has the fewest rarer
    # shingles before it: the text that the others of a family are edits of.
    stars, label = heads.select(F.col("grp").alias("a"), F.col("node").alias("b")), None
    found = None
    for best in (F.min, F.max):
        own = (tokens.withColumn("label", F.col("grp")) if label is None else
               tokens.join(label.where("node = grp").select("grp", "label"), "grp"))
        hub = (own.groupBy("token").agg(F.min(F.struct("place", "grp", "n", "label")).alias("h"),
                                        (F.min("label") < F.max("label")).alias("several"))
               .where("several").select("token", "h.*"))
        near = (own.alias("t").join(hub.alias("h"), "token")
                .where((F.col("t.label") != F.col("h.label")) & _may_link("t", "h", percent))
                .groupBy(F.col("t.grp").alias("b")).agg(best(F.struct("h.place", "h.grp")).alias("h"))
                .select(F.col("h.grp").alias("a"), "b"))
        new = _verified(near if found is not None else stars.union(near), sets, percent)
        found = written(new if found is None else found.union(new), "stars")
        label = _labels(heads, found)
    # the rest: all pairs of different components that share a prefix shingle
    held = label.join(tokens, "grp")
    sides = held.groupBy("token", "label").agg(F.min("n").alias("lo"), F.max("n").alias("hi"),
                                               F.max(F.col("n") - F.col("place")).alias("rest"))
    several = sides.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    sides = written(sides.join(several, "token", "left_semi"), "sides")
    p, q = sides.alias("p"), sides.alias("q")
    met = (p.join(q, "token").where(
        (F.col("p.label") < F.col("q.label")) & (100 * F.col("p.hi") >= percent * F.col("q.lo"))
        & (100 * F.col("q.hi") >= percent * F.col("p.lo"))
        & ((100 + percent) * F.least("p.rest", "q.rest") >= percent * (F.col("p.lo") + F.col("q.lo"))))
        .select("token", F.col("p.label").alias("la"), F.col("q.label").alias("lb")))
    left = held.select("token", F.col("label").alias("la"), "node", "n", "place").alias("x")
    right = held.select("token", F.col("label").alias("lb"), "node", "n", "place").alias("y")
    cross = (met.join(left, ["token", "la"]).join(right, ["token", "lb"]).where(_may_link("x", "y", percent))
             .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    more = _verified(cross, sets, percent)
    return written(found.union(more), "links")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90,
                 chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """id, n_shingles, component_id and class keys (a, b) for every row; see the module docstring."""
    _, total = text_bytes(docs, text_col)
    buckets = max(1, -(-total // bucket_bytes))  # shingles weigh about one byte per byte of text
    parts = chunked(docs, total, [F.col(f"`{id_col}`").cast("long").alias("id"),
                                  F.col(f"`{text_col}`").alias("text")], chunk_bytes)
    rows = written(parts.mapInArrow(_fingerprints(size), "chunk int, id long, n long, a long, b long"), "prints")
    sets_key = ["a", "b"]
    full = rows.where("n > 0")
    classes = full.groupBy(*sets_key).agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("first_id"),
                                          F.min("chunk").alias("home"), F.max("chunk").alias("last"))
    classes = written(classes, "classes")
    away = (full.select("chunk", *sets_key).distinct().join(classes.where("home <> last"), sets_key)
            .where("chunk <> home").select("chunk", *sets_key))
    drops = written(away, "drops")
    chunks = parts.groupBy("chunk")
    sent = chunks.cogroup(drops.groupBy("chunk")).applyInArrow(
        _shingle_sender(size, buckets), "bucket int, chunk int, blob binary")
    replies = sent.groupBy("bucket").applyInArrow(_frequencies(buckets), "chunk int, blob binary")
    notes = replies.select("chunk", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "blob").union(
        drops.select("chunk", "a", "b", F.lit(None).cast("binary")))
    picked = chunks.cogroup(notes.groupBy("chunk")).applyInArrow(_prefixer(size, percent, buckets), _CANDIDATE)
    sets = written(picked.withColumn("node", F.monotonically_increasing_id()), "sets")
    label = components(links(sets, percent))
    named = (sets.select("a", "b", "node").join(label, "node").join(classes.select("a", "b", "first_id"), sets_key))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    joined = named.select("a", "b", "label").join(least, "label").select("a", "b", "component_id")
    verdict = written(classes.join(joined, sets_key, "left").select(
        "a", "b", F.coalesce("component_id", "first_id").alias("component_id")), "components")
    out = full.join(verdict, sets_key).select("id", F.col("n").alias("n_shingles"), F.nullif(
        F.col("component_id"), F.lit(NO_ID)).alias("component_id"), "a", "b")
    alone = rows.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), "a", "b")
    return out.union(alone)
