"""Hierarchical multi-length packing of tokenised documents.

Every document becomes token ids plus an end id.  Whole windows are cut off
long documents; what remains is routed to the smallest context tier it fits
(2048, 1024, 512, 256 tokens).  Tiers are packed from long to short: the
longest remainder opens a window of its tier, and the gap is filled from
shorter tiers, best fit first, at last by cutting a document to the gap.  All
sequences are then exactly as long as their tier, so nothing is padded; the
few tokens left at the end of a run of documents become sequences of smaller
powers of two.  Sequences are dealt to step groups of equal token counts.

Documents are packed in runs of a few MB of text, where they lie: no shuffle,
and memory is bounded by the run (or one document).

Tokens come from a given tokenizer file whose pre-tokenizer never joins words
over ASCII white space; each distinct piece of a word is encoded once per worker
as long as the cache has room.  A run is tokenised in slices, cut between words,
and the cache is a few arrays: a worker holds it while it waits, beside the next stage.

Defined cases: null text counts as empty (only the end id); repeated rows are
packed separately; a null id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, Words, give_back, group_sizes, group_starts, member, row_slices, span_hashes, utf8
from .pretokens import NUMBER, byte_classes, contractions, cut_rows, runs, spans
from .token_counts import byte_letters

TIERS = (2048, 1024, 512, 256)
#: Bytes of text that are tokenised and packed at a time.
RUN_BYTES = 2 << 20
#: Bytes of a run that are tokenised in one kernel call: its arrays take up to a hundred bytes per byte of text.
SLICE_BYTES = 1 << 18
#: Tokens of one step group.
STEP_TOKENS = 64 * 2048
#: Bytes that a worker's cache of pieces holds before it starts anew; changes no result.
CACHE_BYTES = 24 << 20
SCHEMA = ("id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long, step_group long")


#: The parts of a tokenizer file whose effect on plain words :class:`PieceEncoder` can
#: produce itself.  Words of other tokenizers, and all other words, go through the whole tokenizer.
_NORMAL = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Plain: printable ASCII and the precomposed Latin-1 letters (stable under NFC, one-letter lower case).
_PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of plain characters in lower case, and which bytes belong to characters that are not plain."""
    low = _LOWER[data]
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    latin = second & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
    low[latin & (data <= 0x9E)] += 32
    odd = (data >= 0x7F) | (data < 0x09) | ((data > 0x0D) & (data < 0x20))
    odd[latin] = False
    lead = np.flatnonzero(latin) - 1
    odd[lead] = False
    return low, odd


class PieceEncoder:
    """Token ids of texts through a cache of the pieces that the tokenizer cuts words into.

    A run of texts is cut at character classes all at once and dictionary-encoded;
    each distinct piece goes to the tokenizer's model once.  Words with other than
    plain characters, or with a special string, are pieces as a whole and go
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        self.cuts = (spec.get("normalizer") == _NORMAL and len(before) == 2
                     and before[0].get("pattern") == {"Regex": _SPLIT} and before[0].get("behavior") == "Removed"
                     and before[0].get("invert") is True and before[1].get("type") == "ByteLevel"
                     and not before[1].get("add_prefix_space") and not before[1].get("use_regex"))
        self.added = [x["content"].lower().encode() for x in spec.get("added_tokens", [])]
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        """Forget all pieces."""
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # ascending hashes, and whose they are
        self.text, self.edge = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # bytes of all pieces
        self.ids, self.token = np.zeros(0, np.uint32), np.zeros(1, np.int64)  # ids of all pieces

    def held(self) -> int:
        """Bytes of the cache."""
        return sum(x.nbytes for x in (self.keys, self.slot, self.text, self.edge, self.ids, self.token))

    def _known(self, text: np.ndarray, edge: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The slot of each piece of ``text``, -1 for those not in the cache; equal hashes are compared byte by byte."""
        slots = np.full(len(keys), -1)
        if not len(self.keys):
            return slots
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        slot, size = self.slot[at], np.diff(edge)
        hit = np.flatnonzero((self.keys[at] == keys) & (np.diff(self.edge)[slot] == size))
        slot, size = slot[hit], size[hit]
        first = np.cumsum(size) - size
        byte = np.arange(int(size.sum()))
        differs = self.text[byte + np.repeat(self.edge[slot] - first, size)] != text[byte + np.repeat(edge[hit] - first, size)]
        same = np.bincount(np.repeat(np.arange(len(hit)), size)[differs], minlength=len(hit)) == 0
        slots[hit[same]] = slot[same]
        return slots

    def _learn(self, pieces: list[bytes], keys: np.ndarray) -> None:
        """Give new pieces the next slots; of equal hashes the first is found again."""
        got: list = [None] * len(pieces)
        other = []
        for i, piece in enumerate(pieces):
            if piece[0] <= 0x20 and not piece.strip():
                got[i] = ()
            elif self.cuts and _PLAIN.fullmatch(piece) and not any(a in piece.lower() for a in self.added):
                shown = piece.decode("latin-1")
                got[i] = [t.id for t in self.tokenizer.model.tokenize(
                    shown if piece.isascii() else shown.translate(self.letters))]
            else:
                other.append(i)
        encoded = self.tokenizer.encode_batch_fast([pieces[i].decode() for i in other], add_special_tokens=False)
        for i, e in zip(other, encoded, strict=True):
            got[i] = e.ids
        size = np.array([len(x) for x in got], np.int64)
        new, first = np.unique(keys, return_index=True)
        slot = first + len(self.edge) - 1
        fresh = ~member(new, self.keys)
        at = np.searchsorted(self.keys, new[fresh])
        self.keys, self.slot = np.insert(self.keys, at, new[fresh]), np.insert(self.slot, at, slot[fresh])
        self.text = np.append(self.text, np.frombuffer(b"".join(pieces), np.uint8))
        self.edge = np.append(self.edge, self.edge[-1] + np.cumsum([len(p) for p in pieces]))
        self.ids = np.append(self.ids, np.fromiter((i for x in got for i in x), np.uint32, int(size.sum())))
        self.token = np.append(self.token, self.token[-1] + np.cumsum(size))

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes with plain words in lower case, and the edges of all pieces and of the white space between them."""
        words = Words(data, offsets)
        edge = np.zeros(len(data) + 1, bool)
        edge[words.start] = edge[words.end] = edge[offsets] = edge[len(data)] = edge[0] = True
        if not self.cuts:
            return data, np.flatnonzero(edge)
        low, odd = _lowered(data)
        raw = low.tobytes()
        for mark in self.added:
            at = raw.find(mark)
            while at >= 0:
                odd[at] = True
                at = raw.find(mark, at + 1)
        count = np.append(0, np.cumsum(odd, dtype=np.int64))
        whole = count[words.end] > count[words.start]
        kinds = byte_classes(low)
        row = np.zeros(len(data) + 1, bool)
        row[offsets] = True
        starts = runs(kinds, np.concatenate([offsets, words.start, words.end]))
        kind, ends = kinds[starts], np.append(starts, len(data))
        row[words.start] = True  # an ending never lies in another word
        at, length = contractions(low, ends, kind, row)
        inner = np.zeros(len(data) + 1, bool)
        inner[starts] = True
        inner[:-1] |= kinds == NUMBER
        inner[ends[at + 1]] = False
        inner[ends[at + 1] + length] = True
        step = np.zeros(len(data) + 1, np.int8)
        step[words.start[whole]] += 1
        step[words.end[whole]] -= 1
        kept = np.cumsum(step, dtype=np.int8)[:-1].astype(bool)  # bytes of words that stay whole
        inner[:-1] &= ~kept
        return np.where(kept, data, low), np.flatnonzero(edge | inner)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int,
               slice_bytes: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, each text's followed by ``end_id``, and the texts' n + 1 offsets."""
        edges = cut_rows(offsets, slice_bytes, lambda a, b: np.flatnonzero(IS_SPACE[data[a:b]]))
        parts, sizes, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while at < len(edges) - 1:
            upto = max(at + 1, int(np.searchsorted(edges, edges[at] + slice_bytes, side="right")) - 1)
            ids, size = self._encode(data[edges[at]:edges[upto]], edges[at:upto + 1] - edges[at])
            parts.append(ids)
            sizes.append(size)
            at = upto
        before = np.append(0, np.cumsum(np.concatenate(sizes)))[np.searchsorted(edges, offsets)]
        return np.insert(np.concatenate(parts), before[1:], end_id), before + np.arange(len(offsets))

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts or parts of texts, and how many each has."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        shown, cuts = self.pieces(data, offsets)
        found = spans(shown, cuts)
        distinct = found.dictionary
        edge = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1)
        text = np.frombuffer(distinct.buffers()[2], np.uint8, edge[-1])
        keys = span_hashes(text, edge[:-1], edge[1:])
        if self.held() > CACHE_BYTES:
            self.clear()
        slots = self._known(text, edge, keys)
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            slots[fresh] = np.arange(len(fresh)) + len(self.edge) - 1
            self._learn(distinct.take(pa.array(fresh)).to_pylist(), keys[fresh])
        slots = slots[found.indices.to_numpy()]
        start = self.token[slots]
        size = self.token[slots + 1] - start
        before = np.append(0, np.cumsum(size))  # tokens before each piece
        out = self.ids[np.arange(before[-1]) + np.repeat(start - before[:-1], size)]
        return out, np.diff(before[np.searchsorted(cuts, offsets)])


class Packer:
    """Packs documents of given lengths; ``pieces`` are (sequence, document, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.pieces: list[tuple[int, int, int, int]] = []
        self.lengths: list[int] = []
        self.pool: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}

    def _route(self, length: int, doc: int, start: int) -> None:
        if length:
            insort(self.pool[min(t for t in self.tiers if t >= length)], (length, doc, start))

    def _sequence(self, pieces: list[tuple[int, int, int]], size: int) -> None:
        self.pieces += [(len(self.lengths), d, s, n) for n, d, s in pieces]
        self.lengths.append(size)

    def _fill(self, gap: int, below: tuple[int, ...]) -> tuple[int, int, int] | None:
        """The longest document of the tiers that fits, else a cut of one that does not."""
        for t in below:
            at = bisect_right(self.pool[t], (gap, np.inf, 0))
            if at:
                return self.pool[t].pop(at - 1)
        for t in reversed(below):
            if self.pool[t]:
                length, doc, start = self.pool[t].pop()
                self._route(length - gap, doc, start + gap)
                return gap, doc, start
        return None

    def pack(self, sizes: list[int]) -> None:
        top = self.tiers[0]
        for doc, size in enumerate(sizes):
            for k in range(size // top):
                self._sequence([(top, doc, k * top)], top)
            self._route(size % top, doc, size // top * top)
        for i, tier in enumerate(self.tiers):
            while self.pool[tier]:
                window = [self.pool[tier].pop()]
                room = tier - window[0][0]
                while room and (more := self._fill(room, self.tiers[i:])):
                    window.append(more)
                    room -= more[0]
                if room:
                    self._powers(window, tier - room)
                else:
                    self._sequence(window, tier)

    def _powers(self, window: list[tuple[int, int, int]], total: int) -> None:
        """Cut a last, unfilled window into sequences of its binary digits."""
        window = window[::-1]
        for bit in range(total.bit_length() - 1, -1, -1):
            if total >> bit & 1:
                part, room = [], 1 << bit
                while room:
                    length, doc, start = window.pop()
                    if length > room:
                        window.append((length - room, doc, start + room))
                        length = room
                    part.append((length, doc, start))
                    room -= length
                self._sequence(part, 1 << bit)

    def step_groups(self, step_tokens: int) -> list[int]:
        """A group for each sequence: longest first to the group with the fewest tokens."""
        n = max(1, round(sum(self.lengths) / step_tokens))
        load, group = [(0, g) for g in range(n)], [0] * len(self.lengths)
        for s in sorted(range(len(self.lengths)), key=lambda s: -self.lengths[s]):
            tokens, g = heapq.heappop(load)
            group[s] = g
            heapq.heappush(load, (tokens + self.lengths[s], g))
        return group


_ENCODERS: dict[str, PieceEncoder] = {}


def _packed(path: str, end_id: int, tiers: tuple[int, ...], step_tokens: int, run_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, PieceEncoder(path))
        task = TaskContext.get().partitionId() << 40
        sequences = groups = 0
        for whole in batches:
            for batch in row_slices(whole, "text", run_bytes):
                out, more, steps = _packed_run(batch, encoder, end_id, tiers, step_tokens, task + sequences, task + groups)
                yield out
                sequences += more
                groups += steps
        whole = batch = out = None
        give_back()
    return run


def _packed_run(batch: pa.RecordBatch, encoder: PieceEncoder, end_id: int, tiers: tuple[int, ...], step_tokens: int,
                sequence: int, group: int) -> tuple[pa.RecordBatch, int, int]:
    """The pieces of a run of documents, numbered from ``sequence`` and ``group``; how many of these there are."""
    ids, edges = encoder.encode(*utf8(batch.column("text")), end_id)
    packer = Packer(tiers)
    packer.pack(np.diff(edges).tolist())
    step = np.array(packer.step_groups(step_tokens), np.int64)
    table = np.array(packer.pieces, np.int64).reshape(-1, 4)
    seq, doc, start, length = table[np.argsort(table[:, 0], kind="stable")].T
    end = np.cumsum(length)
    first = group_starts(seq)
    begin = end - length
    return pa.RecordBatch.from_pydict({
        "id": batch.column("id").take(pa.array(doc)), "start": pa.array(start), "length": pa.array(length),
        "ids": pa.array([ids[a:a + n].astype("<u4").tobytes() for a, n in
                         zip((edges[doc] + start).tolist(), length.tolist(), strict=True)], pa.binary()),
        "doc_tokens": pa.array(np.diff(edges)[doc]), "sequence_id": pa.array(seq + sequence),
        "offset": pa.array(begin - np.repeat(begin[first], group_sizes(first, len(seq)))),
        "sequence_length": pa.array(np.array(packer.lengths, np.int64)[seq]),
        "step_group": pa.array(step[seq] + group)}), len(packer.lengths), int(step.max()) + 1


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
         tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset, sequence_length, step_group.

    ``tokenizer``: path of the tokenizer file on every machine.  ``tiers``:
    powers of two, longest first, the longest being the window.
    """
    if any(t & (t - 1) or t < 1 for t in tiers) or sorted(tiers, reverse=True) != list(tiers):
        raise ValueError("tiers must be falling powers of two")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_packed(tokenizer, end_id, tuple(tiers), step_tokens, run_bytes),
                           SCHEMA.format(id=kind)).withColumnRenamed("id", id_col)
