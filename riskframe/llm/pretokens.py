"""Cutting UTF-8 texts at character classes, with numpy over whole runs of text.

Byte-level BPE tokenizers cut a text by a regular expression over letters
(``\\p{L}``), numbers (``\\p{N}``), white space and the rest before they merge.
The class of every code point is read from the tokenizer library itself, so the
cuts follow its Unicode version.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE = range(4)
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library's regular expressions see it."""
    if not _CLASSES:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split
        # letters, numbers and white space lie in the first four planes
        points = [c for c in range(0x40000) if not 0xD800 <= c < 0xE000]
        every = "".join(map(chr, points))
        place = np.array(points)
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"[^\p{L}]+"), (NUMBER, r"[^\p{N}]+"), (SPACE, r"\S+")):
            for _, (a, b) in Split(Regex(pattern), "removed").pre_tokenize_str(every):
                table[place[a:b]] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = classes()
    out = table[:128][np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.uint32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07)).astype(np.uint32)
        last = len(data) - 1
        for t in (1, 2, 3):
            more = data[np.minimum(lead + t, last)].astype(np.uint32) & 0x3F
            point = np.where(size > t, point << np.uint32(6) | more, point)
        kind = table[np.minimum(point, 0x10FFFF)]
        for t in (0, 1, 2, 3):
            inside = size > t
            out[lead[inside] + t] = kind[inside]
    return out


#: The lower-case endings that stand alone after an apostrophe.
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def contractions(data: np.ndarray, starts: np.ndarray, kinds: np.ndarray,
                 row_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that are one apostrophe before a listed ending: their indices and the bytes of the ending.

    ``starts``: first bytes of the class runs, and the length of the data;
    ``kinds``: their classes; ``row_start``: whether a row starts at a byte.
    """
    size = np.diff(starts)
    at = np.flatnonzero((kinds == OTHER) & (size == 1))
    at = at[(data[starts[at]] == 0x27) & (at + 1 < len(kinds))]
    at = at[(kinds[at + 1] == LETTER) & ~row_start[starts[at + 1]]]
    room, first = size[at + 1], starts[at + 1]
    length = np.zeros(len(at), np.int64)
    for end in _ENDINGS:
        fits = (length == 0) & (room >= len(end))
        for t, byte in enumerate(end):
            fits &= data[np.minimum(first + t, len(data) - 1)] == byte
        length[fits] = len(end)
    return at[length > 0], length[length > 0]


def runs(kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the runs of one class; a row's first byte always starts one."""
    new = np.zeros(len(kinds) + 1, bool)
    new[1:-1] = kinds[1:] != kinds[:-1]
    new[offsets] = True
    new[len(kinds)] = False
    return np.flatnonzero(new)


def spans(data: np.ndarray, cuts: np.ndarray) -> pa.DictionaryArray:
    """The byte spans between ``cuts`` (0 first, the data's length last), dictionary-encoded."""
    out = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return pc.dictionary_encode(out)


def cut_rows(offsets: np.ndarray, limit: int, places) -> np.ndarray:
    """``offsets`` with cuts inside rows longer than ``limit``, at positions that ``places(start, end)`` allows.

    ``places`` gives ascending positions relative to the row's start; the last
    one within the limit is taken, or else the first one after it.
    """
    more = []
    for r in np.flatnonzero(np.diff(offsets) > limit).tolist():
        a, b = int(offsets[r]), int(offsets[r + 1])
        good, last = places(a, b), 0
        while b - a - last > limit:
            i = int(np.searchsorted(good, last + limit, side="right")) - 1
            if i < 0 or good[i] <= last:
                i += 1
            if i >= len(good):
                break
            last = int(good[i])
            more.append(a + last)
    return np.sort(np.concatenate([offsets, np.array(more, np.int64)])) if more else offsets
