"""Conversation structure repair: cheapest edits to well-formed turns, least audit among the cheapest.

A conversation's messages, by turn, should have roles ``(s?(ua)+)?``: an
optional system message, then user and assistant in turns.  Each message is
kept (K, cost 0), given the role user or assistant (R, 2) or deleted (D, 3; the
only choice for blank messages and copies); empty user or assistant messages can
be inserted anywhere (I, 2); a message that stays without a final mark costs 1
more.  Of all cheapest repairs the one whose audit (its letters in order) is
least by code is taken.

**Cost DP.**  Nodes are (messages consumed, role state): nothing yet, after
``s``, after ``u``, after ``a``.  Costs to the end are computed backwards, one
step of numpy for all conversations of a block at a time.

**Path ranking by prefix doubling.**  Arcs that keep the optimum make up a
graph; an audit determines its path in it, as every letter leads to one node.
Nodes are ranked by their least audits of 1, 2, 4, ... letters: the rank for
twice the length is the pair of ranks of a node and of the node its pointer
reaches, and pointers double with it.  Arcs are then chosen by letter and rank of
their target, and all letters of a path are read side by side through the
doubled pointers.

**Long conversations are split.**  Messages are sorted by range and numbered;
blocks of consecutive numbers are the unit of work, however many conversations
they hold.  A conversation's part of a block is a 4 x 4 min-plus matrix; its
parts are chained over these small rows, so that the costs at block edges, then
the states in which the best path crosses them, are known to every block.  Texts
never enter a group: edits are joined to them.  No task holds a conversation.

Defined cases: null roles and texts count as one space; a null conversation id
is a conversation; messages of one turn are ordered by role, then by a hash of
role and text (null turns first); repeated rows are copies; roles count by
their first character, as written; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Messages of a block, as a power of two.
BLOCK_BITS = 12
#: Parts of conversations that are chained in one group, besides those of a longer conversation.
CHAINED = 50_000

SYSTEM, USER, ASSISTANT, ELSE = range(4)  # classes of roles by their first character
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_NEXT = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])  # the state after the user or assistant turn that fits
_KEEP = np.full((4, 4), -1)  # state, role class -> state after keeping
_KEEP[START, SYSTEM] = AFTER_S
_KEEP[[START, AFTER_S, AFTER_A], USER] = AFTER_U
_KEEP[AFTER_U, ASSISTANT] = AFTER_A
_FAR = np.int64(1) << 40
#: Cost to close a conversation from each state: a system turn needs two insertions, a user turn one.
_CLOSE = np.array([0, 4, 2, 0], np.int64)
_LETTERS = np.array([b"", b"D", b"I", b"K", b"R"])  # codes 1 to 4 are in ASCII order; 0 ends a path
_D, _I, _K, _R = 1, 2, 3, 4
KEEP_COST, ROLE_COST, DELETE_COST, INSERT_COST, UNFINISHED_COST = 0, 2, 3, 2, 1


class Block:
    """The parts of conversations in one block: a part is a run of messages of one conversation."""

    def __init__(self, starts: np.ndarray, n: int, role: np.ndarray, must_go: np.ndarray, unfinished: np.ndarray):
        self.starts, self.sizes = starts, np.diff(np.append(starts, n))
        self.role, self.must_go = role, must_go
        self.stay = np.where(must_go, _FAR, unfinished * np.int64(UNFINISHED_COST))
        # nodes: for part p and t messages consumed, four states from base[p] + 4 t
        self.base = 4 * (starts + np.arange(len(starts)))
        self.n_nodes = 4 * (n + len(starts))
        self.part = np.repeat(np.arange(len(starts)), self.sizes)

    def costs(self, after: np.ndarray) -> np.ndarray:
        """Cost of each node (rows) to the part's end, given costs there: ``after`` is parts x 4 x variants."""
        cost = np.full((self.n_nodes, after.shape[2]), _FAR)
        ends = self.base + 4 * self.sizes
        for q in range(4):
            cost[ends + q] = after[:, q]
        order = np.argsort(-self.sizes, kind="stable")
        sizes = self.sizes[order]
        for t in range(int(sizes[0]) - 1 if len(sizes) else -1, -1, -1):
            live = order[:np.searchsorted(-sizes, -t, side="left")]
            row = self.starts[live] + t
            node = self.base[live] + 4 * t
            then = np.stack([cost[node + 4 + q] for q in range(4)], axis=1)  # live x 4 x variants
            stay = self.stay[row][:, None, None]
            best = np.minimum(then + DELETE_COST, then[:, _NEXT] + stay + ROLE_COST)
            kept = _KEEP[:, self.role[row]].T  # live x 4
            keep = np.take_along_axis(then, np.maximum(kept, 0)[:, :, None], axis=1) + stay + KEEP_COST
            best = np.minimum(best, np.where(kept[:, :, None] >= 0, keep, _FAR))
            one = best[:, _NEXT] + INSERT_COST
            two = best[:, _NEXT[_NEXT]] + 2 * INSERT_COST
            best = np.minimum(np.minimum(best, np.minimum(one, two)), _FAR)
            for q in range(4):
                cost[node + q] = best[:, q]
        return cost

    def matrices(self) -> np.ndarray:
        """parts x entry state x exit state: least cost of the part."""
        after = np.where(np.eye(4, dtype=bool), 0, _FAR)[None].repeat(len(self.starts), axis=0)
        cost = self.costs(after)
        return np.stack([cost[self.base + q] for q in range(4)], axis=1)

    def paths(self, after: np.ndarray, last: np.ndarray) -> "Paths":
        """The least cheapest paths, given costs at the parts' ends; ``last``: the conversation ends there."""
        cost = self.costs(after[:, :, None])[:, 0]
        node = np.arange(self.n_nodes)
        state = node & 3
        arcs = []  # letter, nodes, targets
        inner = np.ones(self.n_nodes, bool)
        ends = (self.base + 4 * self.sizes)[:, None] + np.arange(4)
        inner[ends] = False
        at = node[inner]  # four for each message, in order
        row = np.repeat(np.arange(len(self.role)), 4)
        stay = self.stay[row]
        q = state[at]
        skip = at - q + 4

        def add(letter, where, frm, to, price):
            good = where & (cost[frm] < _FAR)
            good[good] = cost[to[good]] + price[good] == cost[frm[good]]
            arcs.append((letter, frm[good], to[good]))
        free = np.zeros(len(at), np.int64)
        every = np.ones(len(at), bool)
        add(_D, every, at, skip + q, free + DELETE_COST)
        kept = _KEEP[q, self.role[row]]
        add(_K, kept >= 0, at, skip + np.maximum(kept, 0), stay + KEEP_COST)
        add(_R, every, at, skip + _NEXT[q], stay + ROLE_COST)
        close = ends[last].ravel()
        spot = np.concatenate([at, close])
        add(_I, np.ones(len(spot), bool), spot, spot - state[spot] + _NEXT[state[spot]],
            np.full(len(spot), INSERT_COST))
        return Paths(self.n_nodes, arcs)


class Paths:
    """Least paths in a graph whose arcs carry letters, by prefix doubling."""

    def __init__(self, n: int, arcs: list[tuple[int, np.ndarray, np.ndarray]]):
        letter = np.concatenate([np.full(len(f), a) for a, f, _ in arcs])
        frm, to = np.concatenate([f for _, f, _ in arcs]), np.concatenate([t for _, _, t in arcs])
        rank = self._choose(n, letter, frm, to, np.zeros(n, np.int64))
        pointer = self.pointer
        while True:  # ranks by least audits of 1, 2, 4, ... letters
            pair = rank * (int(rank.max(initial=0)) + 1) + rank[pointer]
            rank = np.unique(pair, return_inverse=True)[1]
            far = pointer[pointer]
            if (far == pointer).all():
                break
            pointer = far
        self._choose(n, letter, frm, to, rank)
        self.jumps, self.size = [self.pointer], (self.letter > 0).astype(np.int64)
        while True:
            p = self.jumps[-1]
            far = p[p]
            self.size = self.size + self.size[p]
            if (far == p).all():
                break
            self.jumps.append(far)

    def _choose(self, n, letter, frm, to, rank) -> np.ndarray:
        """Each node's arc of least letter, ties by its target's rank; a node without arcs points to itself."""
        order = np.lexsort((rank[to], letter, frm))
        first = order[np.append(True, frm[order][1:] != frm[order][:-1])] if len(order) else order
        self.pointer, self.letter = np.arange(n), np.zeros(n, np.int64)
        self.pointer[frm[first]], self.letter[frm[first]] = to[first], letter[first]
        return self.letter.copy()

    def exits(self, nodes: np.ndarray) -> np.ndarray:
        """Where the paths from ``nodes`` end: the longest pointers pass every path."""
        return self.jumps[-1][nodes]

    def read(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Path number, place in the path, and node of every step from ``entries``."""
        size = self.size[entries]
        path = np.repeat(np.arange(len(entries)), size)
        place = np.arange(len(path)) - np.repeat(np.cumsum(size) - size, size)
        node = entries[path]
        for k, p in enumerate(self.jumps):
            step = (place >> k & 1).astype(bool)
            node[step] = p[node[step]]
        return path, place, node


def _block(table: pa.Table) -> tuple[pa.Table, Block]:
    """Messages in order, and their block."""
    table = table.combine_chunks().sort_by("rid")
    conv = pc.dictionary_encode(table["conv"].combine_chunks(), null_encoding="encode")
    conv = (conv.combine_chunks() if isinstance(conv, pa.ChunkedArray) else conv).indices.to_numpy()
    starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
    get = lambda c: table[c].to_numpy()
    gone = get("blank") | get("copy")
    return table, Block(starts, len(conv), get("role"), gone, get("unfinished") & ~gone)


PART_SCHEMA = ("conv {conv}, block long, n_blank long, n_copy long, n_unfinished long, illegal long, first int, last int, "
               "min_turn long, max_turn long, n_turns long, matrix binary")
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[SYSTEM, USER] = _LEGAL[USER, ASSISTANT] = _LEGAL[ASSISTANT, USER] = True


def _parts(table: pa.Table) -> pa.Table:
    table, block = _block(table)
    starts = block.starts
    add = lambda x: pa.array(np.add.reduceat(x.astype(np.int64), starts))
    wrong = np.append(False, ~_LEGAL[block.role[:-1], block.role[1:]])
    wrong[starts] = False
    turn = table["turn"].combine_chunks()
    known = pc.is_valid(turn).to_numpy(zero_copy_only=False)
    value = pc.fill_null(turn, 0).to_numpy()
    # turns ascend, nulls first: a known turn is new unless the message before has it
    new = known & np.append(True, (value[1:] != value[:-1]) | ~known[:-1])
    new[starts] = known[starts]
    last = starts + block.sizes - 1
    low = starts + np.add.reduceat((~known).astype(np.int64), starts)  # the first known turn
    some = low <= last
    return pa.table({
        "conv": table["conv"].take(pa.array(starts)), "block": table["block"].take(pa.array(starts)),
        "n_blank": add(table["blank"].to_numpy()), "n_copy": add(table["copy"].to_numpy()),
        "n_unfinished": add(block.stay == UNFINISHED_COST), "illegal": add(wrong),
        "first": pa.array(block.role[starts], pa.int32()), "last": pa.array(block.role[last], pa.int32()),
        "min_turn": pa.array(value[np.minimum(low, last)], mask=~some),
        "max_turn": pa.array(value[last], mask=~some), "n_turns": add(new),
        "matrix": pa.array([m.tobytes() for m in block.matrices()], pa.binary())})


def _runs_of(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Parts by conversation and block; first rows and sizes of the conversations."""
    conv = pc.dictionary_encode(table["conv"].combine_chunks(), null_encoding="encode")
    conv = (conv.combine_chunks() if isinstance(conv, pa.ChunkedArray) else conv).indices.to_numpy()
    order = np.lexsort((table["block"].to_numpy(), conv))
    table = table.take(pa.array(order)).combine_chunks()
    conv = conv[order]
    starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
    return table, starts, np.diff(np.append(starts, len(conv)))


def _chained(table: pa.Table) -> pa.Table:
    """Costs at the end of each part; on a conversation's first part, its summary."""
    table, starts, sizes = _runs_of(table)
    matrix = np.frombuffer(b"".join(table["matrix"].to_pylist()), np.int64).reshape(-1, 4, 4)
    after = np.broadcast_to(_CLOSE, (len(matrix), 4)).copy()
    cost = np.zeros(len(starts), np.int64)
    for t in range(int(sizes.max()) - 1, -1, -1):
        live = sizes > t
        row = starts[live] + t
        begin = np.minimum((matrix[row] + after[row][:, None, :]).min(axis=2), _FAR)
        if t:
            after[row - 1] = begin
        else:
            cost[live] = begin[:, START]
    add = lambda c: np.add.reduceat(table[c].to_numpy(), starts)
    follows = np.ones(len(matrix), bool)
    follows[starts] = False
    first, last = table["first"].to_numpy(), table["last"].to_numpy()
    wrong = follows & np.append(False, ~_LEGAL[last[:-1], first[1:]])
    known = pc.is_valid(table["min_turn"].combine_chunks()).to_numpy(zero_copy_only=False)
    low, high = (pc.fill_null(table[c], 0).to_numpy() for c in ("min_turn", "max_turn"))
    shared = follows & known & np.append(False, known[:-1] & (high[:-1] == low[1:]))
    big = np.iinfo(np.int64).max
    least = np.minimum.reduceat(np.where(known, low, big), starts)
    most = np.maximum.reduceat(np.where(known, high, -big), starts)
    turns = add("n_turns") - np.add.reduceat(shared.astype(np.int64), starts)
    gaps = np.where(turns > 0, most - least + 1 - turns, 0)
    is_last = np.append(~follows[1:], True)
    put = lambda x: pa.array(np.repeat(x, sizes))
    return pa.table({
        "conv": table["conv"], "block": table["block"], "after": pa.array([a.tobytes() for a in after], pa.binary()),
        "last": pa.array(is_last), "head": pa.array(~follows), "gaps": put(gaps), "blank": put(add("n_blank")),
        "duplicate": put(add("n_copy")), "truncated": put(add("n_unfinished")),
        "illegal": put(add("illegal") + np.add.reduceat(wrong.astype(np.int64), starts)), "cost": put(cost)})


def _matched(messages: pa.Table, parts: pa.Table) -> tuple[pa.Table, Block, pa.Table, "Paths"]:
    """The block of ``messages``, and ``parts`` in the order of its parts."""
    table, block = _block(messages)
    parts = parts.combine_chunks()
    place = {c: i for i, c in enumerate(parts["conv"].to_pylist())}
    at = pa.array([place[c] for c in table["conv"].take(pa.array(block.starts)).to_pylist()])
    parts = parts.take(at)
    after = np.frombuffer(b"".join(parts["after"].to_pylist()), np.int64).reshape(-1, 4)
    return table, block, parts, block.paths(after, np.array(parts["last"].to_pylist(), bool))


def _crossings(messages: pa.Table, parts: pa.Table) -> pa.Table:
    """For each part, the state in which the best path leaves it, by the state in which it enters."""
    if not messages.num_rows:
        return pa.table({"conv": parts["conv"].slice(0, 0), "block": parts["block"].slice(0, 0),
                         "after": parts["after"].slice(0, 0), "last": parts["last"].slice(0, 0),
                         "leaves": pa.array([], pa.binary())})
    _, block, parts, paths = _matched(messages, parts)
    out = paths.exits((block.base[:, None] + np.arange(4)).ravel()) & 3
    return pa.table({"conv": parts["conv"], "block": parts["block"], "after": parts["after"], "last": parts["last"],
                     "leaves": pa.array([x.tobytes() for x in out.astype(np.uint8).reshape(-1, 4)], pa.binary())})


def _entered(table: pa.Table) -> pa.Table:
    """The state in which each part is entered."""
    table, starts, sizes = _runs_of(table)
    leaves = np.frombuffer(b"".join(table["leaves"].to_pylist()), np.uint8).reshape(-1, 4)
    enters = np.zeros(len(leaves), np.int64)
    for t in range(1, int(sizes.max())):
        row = starts[sizes > t] + t
        enters[row] = leaves[row - 1, enters[row - 1]]
    return pa.table({"conv": table["conv"], "block": table["block"], "after": table["after"], "last": table["last"],
                     "enters": pa.array(enters, pa.int32())})


def _edits(messages: pa.Table, parts: pa.Table) -> pa.Table:
    """Every edit of a block's parts, in order."""
    if not messages.num_rows:
        return pa.table({"conv": parts["conv"].slice(0, 0), "block": pa.array([], pa.int64()),
                         "part_place": pa.array([], pa.int64()), "rid": pa.array([], pa.int64()),
                         "edit": pa.array([], pa.string()), "new_role": pa.array([], pa.string())})
    table, block, parts, paths = _matched(messages, parts)
    path, place, node = paths.read(block.base + parts["enters"].to_numpy())
    letter, target = paths.letter[node], paths.pointer[node]
    row = block.starts[path] + (node - block.base[path]) // 4
    rid = table["rid"].to_numpy()
    inserted = letter == _I
    # insertions have no message: negative numbers that no message has
    own = -(parts["block"].to_numpy()[path] << 20) - np.arange(len(path)) - 1
    number = np.where(inserted, own, rid[np.minimum(row, len(rid) - 1)])
    role = np.where(target & 3 == AFTER_U, "user", "assistant")
    return pa.table({
        "conv": parts["conv"].take(pa.array(path)), "block": pa.array(parts["block"].to_numpy()[path]),
        "part_place": pa.array(place), "rid": pa.array(number),
        "edit": pa.array(_LETTERS[letter].astype(str), pa.string()),
        "new_role": pa.array(role.astype(object), pa.string(), mask=~(inserted | (letter == _R)))})


def _plain(role, text):
    """Columns of a message's properties (native)."""
    first = F.substring(role, 1, 1)
    code = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(ELSE)
    said = F.regexp_replace(text, r"[\x20\x09-\x0D]+\z", "")
    last = F.substring(said, -1, 1)
    return code.cast("int"), said == "", ~last.isin(".", "!", "?")


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", block_bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """Summaries and edits of all conversations.

    Summaries, one row per conversation: conv, gaps, blank, duplicate, truncated,
    illegal, cost.  Edits, one row per edit: conv, block, place (ascending within
    a conversation), edit (D, I, K, R), role and text after the edit (of a
    deleted message: its own).
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), space).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), space).alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    placed = written(rows.withColumn("digest", digest).orderBy(*order)
                     .withColumn("rid", F.monotonically_increasing_id()), "messages")
    code, blank, unfinished = _plain(F.col("role"), F.col("text"))
    facts = placed.select("conv", "turn", "rid", "digest", F.shiftright("rid", block_bits).alias("block"),
                          code.alias("role"), blank.alias("blank"), (~blank & unfinished).alias("unfinished"))
    again = facts.where(~F.col("blank")).groupBy("conv", "digest").agg(
        F.min("rid").alias("first_rid"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("conv").alias("other"), F.col("digest").alias("other_digest"), "first_rid")
    copies = facts.join(again, (facts["digest"] == again["other_digest"]) & facts["conv"].eqNullSafe(again["other"]),
                        "left")
    facts = written(copies.select("conv", "turn", "rid", "block", "role", "blank", "unfinished",
                                  F.coalesce(~F.col("blank") & (F.col("rid") > F.col("first_rid")), F.lit(False))
                                  .alias("copy")), "message-facts")
    kind = rows.schema["conv"].dataType.simpleString()
    parts = written(facts.groupBy("block").applyInArrow(_parts, PART_SCHEMA.format(conv=kind)), "conversation-parts")
    groups = max(1, -(-parts.count() // CHAINED))
    chain = lambda df: df.groupBy(F.pmod(F.xxhash64("conv"), F.lit(groups)).alias("group"))
    chained = written(chain(parts).applyInArrow(
        _chained, f"conv {kind}, block long, after binary, last boolean, head boolean, gaps long, blank long, "
                  "duplicate long, truncated long, illegal long, cost long"), "conversation-costs")
    edge = f"conv {kind}, block long, after binary, last boolean"
    ends = chained.select("conv", "block", "after", "last")
    by_block = facts.groupBy("block")
    leaves = by_block.cogroup(ends.groupBy("block")).applyInArrow(_crossings, f"{edge}, leaves binary")
    enters = written(chain(leaves).applyInArrow(_entered, f"{edge}, enters int"), "conversation-entries")
    edits = by_block.cogroup(enters.groupBy("block")).applyInArrow(
        _edits, f"conv {kind}, block long, part_place long, rid long, edit string, new_role string")
    said = placed.select("rid", "role", "text")
    done = edits.join(said, "rid", "left").select(
        "conv", "block", F.col("part_place").alias("place"), "edit", F.coalesce("new_role", "role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    summary = chained.where("head").drop("block", "after", "last", "head")
    return summary, done


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with a fifth damaged, by a hash of id and turn.

    Of twenty kinds, 0 drops the message, 1 empties it, 2 removes its marks, 3
    repeats it, 4 makes the user its author; nulls count as one space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"),
                                kind.alias("kind")).where("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """audit and sha256 of conversations whose sorted edits stream past; a conversation is never held."""
    conv, audit, said, state = None, [], False, None
    out: tuple[list, list, list] = ([], [], [])

    def close():
        if state is not None:
            for column, value in zip(out, (conv, "".join(audit), state.hexdigest()), strict=True):
                column.append(value)

    def batch_of(schema):
        done = pa.RecordBatch.from_arrays([pa.array(out[0], schema.field("conv").type), pa.array(out[1], pa.string()),
                                           pa.array(out[2], pa.string())], names=["conv", "audit", "repaired_sha256"])
        for column in out:
            column.clear()
        return done
    schema = None
    for batch in batches:
        schema = batch.schema
        code = pc.dictionary_encode(batch.column("conv"), null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])).tolist()
        ids = batch.column("conv").take(pa.array(starts)).to_pylist()
        letters, lines = batch.column("edit").to_pylist(), batch.column("line").to_pylist()
        for own, a, b in zip(ids, starts, [*starts[1:], batch.num_rows], strict=True):
            if state is None or own != conv:
                close()
                conv, audit, said, state = own, [], False, hashlib.sha256()
            audit.append("".join(letters[a:b]))
            kept = [x for x in lines[a:b] if x is not None]
            if kept:
                state.update((("\n" if said else "") + "\n".join(kept)).encode())
                said = True
        if len(out[0]) >= 1000:
            yield batch_of(schema)
    close()
    if schema is not None:
        yield batch_of(schema)


def digests(edits: DataFrame) -> DataFrame:
    """conv, audit and repaired_sha256 (of ``role:text`` lines joined by newlines) of every conversation with edits."""
    kind = edits.schema["conv"].dataType.simpleString()
    line = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text"))
    rows = edits.select("conv", "block", "place", "edit", line.alias("line")).repartition("conv")
    return rows.sortWithinPartitions("conv", "block", "place").select("conv", "edit", "line").mapInArrow(
        _digested, f"conv {kind}, audit string, repaired_sha256 string")
