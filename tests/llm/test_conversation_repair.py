import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from riskframe.llm.conversation_repair import damage, digests, repair
from riskframe.llm.queries import op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, block string, rid int, audit string"
BLANK = " \t\n\x0b\x0c\r"
STEP = {"0": "u", "s": "u", "u": "a", "a": "u"}


def brute(rows):
    """Faults, cost, audit and repaired lines of one conversation's (turn, role, text) in order."""
    seen, kinds = set(), []
    for _, role, text in rows:
        said = text.rstrip(BLANK)
        kinds.append("blank" if not said else "copy" if (role, text) in seen else "cut" if said[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserted):
        """(cost, audit, lines) of what follows ``i`` messages; state 0, s, u or a."""
        found = []
        if i == len(rows):
            if state in "0a":
                found.append((0, "", ()))
        else:
            _, role, text = rows[i]
            c, a, t = best(i + 1, state, 0)
            found.append((c + 3, "D" + a, t))
            if kinds[i] not in ("blank", "copy"):
                extra = kinds[i] == "cut"
                first = role[:1]
                if first and (first == STEP[state] or first == "s" and state == "0"):
                    c, a, t = best(i + 1, first, 0)
                    found.append((c + extra, "K" + a, (f"{role}:{text}", *t)))
                c, a, t = best(i + 1, STEP[state], 0)
                name = {"u": "user", "a": "assistant"}[STEP[state]]
                found.append((c + 2 + extra, "R" + a, (f"{name}:{text}", *t)))
        if inserted < 3:
            c, a, t = best(i, STEP[state], inserted + 1)
            found.append((c + 2, "I" + a, ({"u": "user:", "a": "assistant:"}[STEP[state]], *t)))
        return min(found, key=lambda x: x[:2], default=(10**9, "", ()))

    turns = [t for t, _, _ in rows if t is not None]
    first = [r[:1] for _, r, _ in rows]
    cost, audit, lines = best(0, "0", 0)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("copy"),
            kinds.count("cut"), sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def in_order(rows):
    key = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), key(r)))


def conversations(n=150, seed=0):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        cid = None if c == 3 else c
        size = r.choice([1, 1, 2, 3, 4, 5, 8, 20, 70])
        for t in range(size):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "u"])
            if r.random() < 0.6:
                role = ("system" if t == 0 and c % 3 == 0 else "user" if (t + (c % 3 == 0)) % 2 == 0 else "assistant")
            text = r.choice(["Yes.", "No", "hm!", " \t\n", "", None, "ok? ", "a.b\n", "é!", "…", "x" * r.randint(1, 9) + "."])
            rows.append((cid, r.choice([t, t, t, t, t + 1, 2 * t, None]), role, text, "b", 1, "z"))
    rows += rows[5:8] + [(None, None, None, None, None, None, None)]
    r.shuffle(rows)
    return rows


def expected(rows, damaged=False):
    by = {}
    for cid, turn, role, text, *_ in rows:
        mine = by.setdefault(cid, [])
        role, text = " " if role is None else role, " " if text is None else text
        if damaged:
            kind = zlib.crc32(f"{' ' if cid is None else cid}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            mine += [(turn, role, text)] * (kind == 3)
        mine.append((turn, role, text))
    return {cid: brute(in_order(mine)) for cid, mine in by.items()}


@pytest.mark.parametrize("bits", [12, 3, 0])
def test_equals_brute_force_however_split(spark, bits):
    rows = conversations()
    faults, edits = repair(spark.createDataFrame(rows, SCHEMA).repartition(5), block_bits=bits)
    found = {r.conv: r for r in faults.collect()}
    said = {r.conv: r for r in digests(edits).collect()}
    want = expected(rows)
    assert found.keys() == said.keys() == want.keys()
    for cid, w in want.items():
        f, s = found[cid], said[cid]
        assert (f.gaps, f.blank, f.duplicate, f.truncated, f.illegal, f.cost, s.audit, s.repaired_sha256) == w, cid


def test_one_long_conversation_crosses_many_blocks(spark):
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b!", f"{t}.", f"{t}", " "]), "", 0, "")
            for t in range(900)]
    faults, edits = repair(spark.createDataFrame(rows, SCHEMA), block_bits=5)
    f, s = faults.first(), digests(edits).first()
    assert (f.gaps, f.blank, f.duplicate, f.truncated, f.illegal, f.cost, s.audit, s.repaired_sha256) == expected(rows)[7]
    assert edits.select("block").distinct().count() >= 28


def test_query_over_damaged_rows(spark, tmp_path):
    rows = conversations(200, seed=2)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == expected(rows, damaged=True)


def test_damage_of_all_kinds(spark):
    rows = [(c, 0, "assistant", "One. Two!", "", 0, "") for c in range(400)]
    got = {}
    for r in damage(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    for c in range(400):
        kind = zlib.crc32(f"{c}:0".encode()) % 20
        want = {0: [], 1: [(0, "assistant", "")], 2: [(0, "assistant", "One Two")], 4: [(0, "user", "One. Two!")],
                3: [(0, "assistant", "One. Two!")] * 2}.get(kind, [(0, "assistant", "One. Two!")])
        assert got.get(c, []) == want


def test_equal_costs_take_the_least_audit(spark):
    # a lone user message: an answer is inserted (KI, 2); an answer alone: a question before it (IK)
    rows = [(1, 0, "user", "a.", "", 0, ""), (2, 0, "assistant", "a.", "", 0, ""), (3, 0, "system", "a.", "", 0, ""),
            (4, 0, "user", "a", "", 0, "")]
    faults, edits = repair(spark.createDataFrame(rows, SCHEMA))
    assert {r.conv: r.audit for r in digests(edits).collect()} == {1: "KI", 2: "IK", 3: "D", 4: "D"}
    assert {r.conv: r.cost for r in faults.collect()} == {1: 2, 2: 2, 3: 3, 4: 3}


def test_empty(spark, tmp_path):
    faults, edits = repair(spark.createDataFrame([], SCHEMA))
    assert faults.count() == 0 and digests(edits).count() == 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op11_conversation_repair(spark, str(tmp_path)).count() == 0
