"""Small documents with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, id long, score string"


def words(text):
    return WORD.findall(text or "")


def documents(n=60, seed=0):
    """(doc_id, text, lang, source, ...) rows; the last three columns clash with names the operators use."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.choice((1, 2, 12, 13, 14, 80, 200)))]
        if i % 5 == 0:
            at = r.randint(0, len(w))
            w[at:at] = passage[: r.choice((12, 13, 30, 60))]
        texts.append(r.choice((" ", "\n", " \t ")).join(w))
    base = [r.choice(vocabulary) for _ in range(120)]
    for i in range(8):  # a family of near copies
        w = list(base)
        w[r.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [" ".join(base), " ".join(base).upper(), "  ".join(base), None, "", " \t\n ", "one", "One", "two words",
              "two\twords", " ".join(passage * 30), "x" * 20000, "ß É é İ ①   　 \x1c <|endoftext|> don't WE'LL 12",
              "same same same same", "the the, THE!! <b>&amp;</b>", "日本語 テキスト", "123 456 --- !!!"]
    rows = [(i * 3, t, ("en", "de", None)[i % 3], ("s1", "s2", "s3", "é", None)[i % 5] if i % 4 else "s1", 1, "c", 7, "z")
            for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, texts[5], "en", "s2", 1, "c", 7, "z"))
    rows.append((None, None, None, None, None, None, None, None))
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LAST = 1 << 63


def order(doc_id):
    return LAST if doc_id is None else doc_id
