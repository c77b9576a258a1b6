import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from riskframe.llm import packing
from riskframe.llm.common import utf8
from riskframe.llm.packing import Packer, PieceEncoder, pack
from riskframe.llm.queries import tokenizer_path

from . import cases


def encoder():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("run_bytes", [1 << 22, 2000])
def test_round_trip(spark, run_bytes):
    rows = cases.documents()
    out = pack(cases.frame(spark, rows), tokenizer_path(), run_bytes=run_bytes).collect()
    tokenizer = encoder()
    want = sorted((r[0] is None, r[0] or 0, tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]))
                  for r in rows)
    docs, found = {}, []
    for p in out:
        assert len(p.ids) == 4 * p.length
        docs.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for (doc_id, total), pieces in docs.items():
        pieces.sort(key=lambda p: p.start)
        copies = sum(p.start == 0 for p in pieces)
        if copies == 1 and sum(p.length for p in pieces) == total:  # repeated rows are compared by count only
            ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in pieces]).tolist()
            found.append((doc_id is None, doc_id or 0, tuple(ids)))
        assert sum(p.length for p in pieces) == copies * total
    assert set(found) <= set(want) and len(found) >= len(want) - 4
    assert sum(p.length for p in out) == sum(len(w[2]) for w in want)
    by = {}
    for p in out:
        by.setdefault(p.sequence_id, []).append(p)
    for pieces in by.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
        size = sum(p.length for p in pieces)
        assert size <= 2048 and size & (size - 1) == 0 and {p.sequence_length for p in pieces} == {size}


def test_packer_covers_every_token_without_padding():
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in np.concatenate([rng.integers(1, 300, 200), rng.integers(1, 9000, 40), [2048, 1, 4096]])]
    packer = Packer()
    packer.pack(sizes)
    seen = [np.zeros(s, int) for s in sizes]
    for _, doc, start, length in packer.pieces:
        seen[doc][start:start + length] += 1
    assert all((s == 1).all() for s in seen)
    assert sum(packer.lengths) == sum(sizes) and all(n & (n - 1) == 0 for n in packer.lengths)
    load = np.bincount(packer.step_groups(8192), packer.lengths)
    assert load.max() - load.min() <= 2048


def test_empty_table_and_tiers(spark):
    assert pack(cases.empty(spark), tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        pack(cases.empty(spark), tokenizer_path(), tiers=(2000, 1000))


def rare_words(n_bytes, seed=0):
    rng = np.random.default_rng(seed)
    letters = rng.integers(97, 123, n_bytes, dtype=np.uint8)
    letters[rng.random(n_bytes) < 0.15] = 0x20
    return letters.tobytes().decode()


def test_a_run_is_tokenised_in_little_memory():
    found = PieceEncoder(tokenizer_path())
    data, offsets = utf8(pa.array([rare_words(1 << 20), "", rare_words(1 << 20, 1)]))
    found.encode(data[:1000], np.array([0, 1000]), 1)
    tracemalloc.start()
    ids, edges = found.encode(data, offsets, 1)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # ids of 5 bytes a byte of text at most; what is kept of some 300,000 words; arrays of a slice
    assert held < 24 << 20 and peak < 64 << 20
    whole = encoder().encode_batch([data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])],
                                   add_special_tokens=False)
    assert ids.tolist() == [i for e in whole for i in [*e.ids, 1]]
    assert np.diff(edges).tolist() == [len(e.ids) + 1 for e in whole]


@pytest.mark.parametrize("cache_bytes", [1 << 20, 0])
@pytest.mark.parametrize("slice_bytes", [40, 1 << 20])
@pytest.mark.parametrize("equal_hashes", [False, True])
def test_slices_cache_and_equal_hashes_change_no_ids(monkeypatch, cache_bytes, slice_bytes, equal_hashes):
    monkeypatch.setattr(packing, "CACHE_BYTES", cache_bytes)
    if equal_hashes:
        monkeypatch.setattr(packing, "span_hashes", lambda data, start, end: np.full(len(start), 7, np.uint64))
    texts = [r[1] or "" for r in cases.documents()] + [
        "", "  \t ", "it's we'll 'S x's 12ab34", "\u00c9t\u00c9 \u00bd\u00b2 \u00fcber\u2009x\n\ny", "a" * 3000, "\u00e9" * 500 + " z"]
    found, tokenizer = PieceEncoder(tokenizer_path()), encoder()
    texts += [f"a {mark}b {mark} c{mark}" for mark in map(bytes.decode, found.added[:2])]
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    data, offsets = utf8(pa.array(texts))
    for _ in range(2):  # the second time from the cache
        ids, edges = found.encode(data, offsets, 1, slice_bytes)
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == want
