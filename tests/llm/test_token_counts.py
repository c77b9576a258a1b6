import random

import pyarrow as pa
import pytest

from riskframe.llm.common import utf8
from riskframe.llm.queries import op13_token_counts, tokenizer_path
from riskframe.llm.token_counts import TokenCounter, count_tokens, pretoken_cuts

from . import cases

PATH = tokenizer_path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def awkward(n, seed=0):
    r = random.Random(seed)
    pool = list("ab'sstrevmld  \n\t.,!é1２Ⅷ 　 \x85\x1c日本ß’́😀‍१") + [
        "'ll", "'re", " '", "'s", " 's", "it's", "  ", "\r\n", "'ve'd", "'S", "<|endoftext|>", "<|endoftext|> "]
    weight = [4] * (len(pool) - 2) + [1, 1]
    return ["".join(r.choices(pool, weight, k=r.randint(0, 60))) for _ in range(n)]


def test_cuts_are_the_librarys_pretokens():
    tokenizer = library()
    texts = [t.replace("<|endoftext|>", "<>") for t in awkward(3000)]
    data, offsets = utf8(pa.array(texts))
    cuts = set(pretoken_cuts(data, offsets).tolist())
    want = {len(data)}
    for text, start in zip(texts, offsets.tolist()):
        byte = [len(text[:i].encode()) for i in range(len(text) + 1)]
        want |= {start + byte[a] for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text)}
    assert cuts == want


def test_only_strings_that_come_back_alone_are_proved_whole():
    counter, tokenizer = TokenCounter(PATH), library()
    whole = counter.whole.to_pylist()
    assert len(whole) > 50000 and len(set(whole)) == len(whole)
    for piece in whole[::97]:
        text = piece.decode("utf-8", "ignore")
        if text.encode() == piece and len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1:
            assert len(tokenizer.encode(text, add_special_tokens=False).ids) == 1


@pytest.mark.parametrize("run_bytes", [1 << 20, 64])
def test_counts_equal_the_tokenizer(spark, run_bytes):
    rows = cases.documents() + [(1000 + i, t, None, None, 1, "c", 7, "z") for i, t in enumerate(awkward(800, seed=1))]
    rows.append((5000, "".join(awkward(200, seed=2)), None, None, 1, "c", 7, "z"))
    tokenizer = library()
    got = count_tokens(cases.frame(spark, rows), PATH, run_bytes=run_bytes).collect()
    row = lambda i, t: (i is None, i or 0, len((t or "").encode()),
                        n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        row(r[0], r[1]) for r in rows)


def test_other_layouts_use_the_tokenizer(spark):
    from tokenizers import Tokenizer
    path = tokenizer_path()
    rows = cases.documents(10)
    tokenizer = Tokenizer.from_file(path)
    got = count_tokens(cases.frame(spark, rows), path).collect()
    assert sorted(r.n_tokens for r in got) == sorted(
        len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)


def test_empty_table_and_query(spark, tmp_path):
    assert count_tokens(cases.empty(spark), PATH).count() == 0
    cases.frame(spark, cases.documents()).write.parquet(f"{tmp_path}/documents.parquet")
    out = op13_token_counts(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert out.count() == len(cases.documents())
