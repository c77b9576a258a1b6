"""Token counts with a whole-token shortcut.

A byte-level BPE tokenizer cuts a text into pre-tokens and merges each alone.
Before any text is read, every vocabulary string is given to the model: those
that come back as one token are *proved whole* (a string can be in the
vocabulary and still be merged another way).  A pre-token that equals a proved
string counts one without any merging; only the others are merged, each
distinct one once per worker as long as the cache has room.

Pre-tokens are cut for a whole run of text with numpy, following the
tokenizer's own pattern, and dictionary-encoded with Arrow.  A document is
counted where it lies: no shuffle.  Tokenizers of another layout, and texts of
a run that holds a special string, go through the tokenizer itself, special
strings as its defaults treat them.

Long texts are cut before white space that follows a non-space, where a
pre-token always begins, so memory is bounded by the run and the longest
unbroken span, not by the document.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows
and rows with null ids are counted like any other; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8
from .pretokens import SPACE, byte_classes, contractions, runs, spans

#: Bytes of text in one kernel call.
RUN_BYTES = 1 << 20
#: Bytes of merged pre-tokens that a worker's cache holds before it starts anew; changes no result.
CACHE_BYTES = 96 << 20

#: The parts of a tokenizer file that :func:`pretoken_cuts` follows.
_LAYOUT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


def pretoken_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pre-tokens of all rows, and the length of the data.

    Class runs, where a single space before a run of another class belongs to
    that run, white space before it ends one character earlier, and an
    apostrophe takes the ending that follows it.
    """
    kinds = byte_classes(data)
    starts = runs(kinds, offsets)
    if not len(starts):
        return np.zeros(1, np.int64)
    kind, edge = kinds[starts], np.append(starts, len(data))
    row_edge = np.zeros(len(data) + 1, bool)
    row_edge[offsets] = True
    # the last character of white space that another class follows starts a pre-token of its own or with that run
    gap = np.flatnonzero((kind == SPACE) & ~row_edge[edge[1:]])
    last = edge[gap + 1] - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    joined = data[last] == 0x20
    begins = np.ones(len(starts), bool)
    begins[gap[joined] + 1] = False
    before = np.zeros(len(starts), bool)
    before[gap[joined] + 1] = True
    at, length = contractions(data, edge, kind, row_edge)
    at, length = at[~before[at]], length[~before[at]]
    begins[at + 1] = False
    rest = edge[at + 1] + length
    rest = rest[rest < edge[at + 2]]
    cut = np.zeros(len(data) + 1, bool)
    for place in (starts[begins], last, rest):
        cut[place] = True
    cut[len(data)] = True
    return np.flatnonzero(cut)


class TokenCounter:
    """Token counts of runs of texts for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.known = (spec.get("normalizer") is None and all(before.get(k) == v for k, v in _LAYOUT.items())
                      and model["type"] == "BPE" and not model.get("continuing_subword_prefix")
                      and not model.get("end_of_word_suffix") and not model.get("dropout"))
        self.added = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.letters = byte_letters()
        self.whole = self._prove() if self.known else pa.array([], pa.large_binary())
        self.cache: dict[bytes, int] = {}
        self.cached = 0

    def _prove(self) -> pa.Array:
        """The byte strings of the vocabulary that the model leaves as one token."""
        back = {chr(letter): byte for byte, letter in self.letters.items()}
        tokenize = self.tokenizer.model.tokenize
        return pa.array([bytes(back[c] for c in text) for text in self.tokenizer.get_vocab(with_added_tokens=False)
                         if text and all(c in back for c in text) and len(tokenize(text)) == 1], pa.large_binary())

    def _merge(self, piece: bytes) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = len(self.tokenizer.model.tokenize(piece.decode("latin-1").translate(self.letters)))
            self.cached += len(piece) + 150
            if self.cached > CACHE_BYTES:
                self.cache, self.cached = {}, len(piece) + 150
            self.cache[piece] = n
        return n

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        raw = data.tobytes()
        if not self.known or any(a in raw for a in self.added):
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.array([len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)],
                            np.int64)
        cuts = pretoken_cuts(data, offsets)
        found = spans(data, cuts)
        proved = pc.is_valid(pc.index_in(found.dictionary, value_set=self.whole)).to_numpy(zero_copy_only=False)
        size = np.ones(len(proved), np.int64)
        rest = np.flatnonzero(~proved)
        size[rest] = [self._merge(p) for p in found.dictionary.take(pa.array(rest)).to_pylist()]
        total = np.append(0, np.cumsum(size[found.indices.to_numpy()]))
        return np.diff(total[np.searchsorted(cuts, offsets)])


def text_parts(data: np.ndarray, offsets: np.ndarray, limit: int, keep: list[bytes] = ()) -> np.ndarray:
    """Offsets that also cut rows longer than ``limit`` before white space after a non-space."""
    long = np.flatnonzero(np.diff(offsets) > limit)
    more = []
    for r in long.tolist():
        a, b = int(offsets[r]), int(offsets[r + 1])
        text = data[a:b]
        blank = (text == 0x20) | ((text >= 0x09) & (text <= 0x0D))
        # only between ASCII characters: whether another one is white space is the tokenizer's matter
        good = np.flatnonzero(blank[1:] & ~blank[:-1] & (text[:-1] > 0x20) & (text[:-1] < 0x7F)) + 1
        raw = text.tobytes() if keep else b""
        for mark in keep:  # never inside or right after a special string
            at = raw.find(mark)
            while at >= 0:
                good = good[(good <= at) | (good > at + len(mark))]
                at = raw.find(mark, at + 1)
        last = 0
        while len(text) - last > limit:
            i = int(np.searchsorted(good, last + limit, side="right")) - 1
            if i < 0 or good[i] <= last:  # no place within the limit: the next one after it
                i += 1
                if i >= len(good):
                    break
            last = int(good[i])
            more.append(a + last)
    return np.sort(np.concatenate([offsets, np.array(more, np.int64)])) if more else offsets


_COUNTERS: dict[str, TokenCounter] = {}


def _counted(path: str, run_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, TokenCounter(path))
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            edges = text_parts(data, offsets, run_bytes, counter.added)
            tokens = np.zeros(len(edges) - 1, np.int64)
            at = 0
            while at < len(tokens):
                upto = max(at + 1, int(np.searchsorted(edges, edges[at] + run_bytes, side="right")) - 1)
                upto = min(upto, len(tokens))
                tokens[at:upto] = counter.count(data[edges[at]:edges[upto]], edges[at:upto + 1] - edges[at])
                at = upto
            total = np.append(0, np.cumsum(tokens))
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "n_bytes": pa.array(np.diff(offsets)),
                "n_tokens": pa.array(np.diff(total[_row_parts(edges, offsets)]))})
    return run


def _row_parts(edges: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index in ``edges`` of each row's offset; empty rows repeat an offset, in ``edges`` too."""
    inner = np.setdiff1d(edges, offsets)  # cuts inside rows never equal a row's offset
    return np.arange(len(offsets)) + np.searchsorted(inner, offsets)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
                 run_bytes: int = RUN_BYTES) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row; ``tokenizer``: path of the file on every machine."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_counted(tokenizer, run_bytes), f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)
