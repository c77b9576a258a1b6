"""Chat formatting by quotation linking.

Messages quote earlier ones with nested ``>`` marks.  Each message is parsed
into its own text and its quoted paragraphs with their levels; paragraphs are
normalised (case, white space, so re-wrapped quotes still match) and hashed; a
quoted paragraph is joined to the latest earlier message of the same scope
whose own text has that paragraph.  The parent of a message is the latest one
quoted at its lowest linked level.  Parents are followed by pointer jumping to
the conversation's root, and the depth below it gives the reply order.

The scope (mailing list, mailbox, channel) bounds what can be quoted, and what
meets in a window; links are always to earlier messages, so there are no
cycles.

Defined cases: null and empty texts have no paragraphs, quote nothing and can
not be quoted; an unlinked quotation is counted and dropped; a message that
links to nothing is a root of depth 0; rows with the same id are one message
for linking (the parent of the row that links best) and keep a row each; a null
order is before all others; a null id makes a row a root of its own; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, row_slices, written

_MARKS = re.compile(r"(?:[ \t]{0,3}>)+")
_ATTRIBUTION = re.compile(r"\s*On .{0,200} wrote:\s*")
_BLANK = " \t\r\n\x0b\x0c"


def parse(text: str | None) -> tuple[str, list[bytes], list[tuple[int, bytes]]]:
    """Own text, hashes of its paragraphs, and (level, hash) of the quoted paragraphs."""
    lines = []
    for line in (text or "").split("\n"):
        marks = _MARKS.match(line)
        level = marks.group().count(">") if marks else 0
        rest = line[marks.end():] if marks else line
        lines.append((level, rest[1:] if marks and rest[:1] == " " else rest))
    said = [(lv, x) for i, (lv, x) in enumerate(lines)
            if not (i + 1 < len(lines) and lines[i + 1][0] > lv and _ATTRIBUTION.fullmatch(x))]
    own = "\n".join(x for lv, x in said if lv == 0).strip(_BLANK)
    paragraphs, run, at = [], [], 0
    for lv, x in [*said, (-1, "")]:
        if lv != at or not x.strip(_BLANK):
            if run:
                paragraphs.append((at, hashlib.md5(" ".join(" ".join(run).lower().split()).encode()).digest()))
            run, at = [], lv
        if x.strip(_BLANK):
            run.append(x)
    return own, [h for lv, h in paragraphs if lv == 0], [(lv, h) for lv, h in paragraphs if lv > 0]


_PARSED = "id string, scope string, place long, own_text string, own array<binary>, quoted array<struct<level:int,hash:binary>>"


def _parser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in row_slices(whole, "text"):
            parsed = [parse(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "scope": batch.column("scope"), "place": batch.column("place"),
                "own_text": pa.array([p[0] for p in parsed], pa.string()),
                "own": pa.array([p[1] for p in parsed], pa.list_(pa.binary())),
                "quoted": pa.array([[{"level": lv, "hash": h} for lv, h in p[2]] for p in parsed],
                                   pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.binary())])))})


def _parents(rows: DataFrame) -> DataFrame:
    """id, parent, linked (distinct quoted paragraphs that have an original) of every message that links."""
    said = rows.where("id is not null").select("scope", F.explode(F.array_distinct("own")).alias("hash"), "place", "id",
                                               F.lit(0).alias("level"))
    cited = rows.where("id is not null").select("scope", F.explode("quoted").alias("q"), "place", "id").select(
        "scope", F.col("q.hash").alias("hash"), "place", "id", F.col("q.level").alias("level"))
    both = said.union(cited.select("scope", "hash", "place", "id", "level"))
    key = F.coalesce("place", F.lit(-(1 << 62)))
    both = both.withColumn("key", key)
    # the latest message that says the paragraph and comes strictly before the quoting one
    before = Window.partitionBy("scope", "hash").orderBy("key").rangeBetween(Window.unboundedPreceding, -1)
    said_at = F.when(F.col("level") == 0, F.struct("key", "id"))
    found = both.withColumn("source", F.max(said_at).over(before)).where("level > 0 and source is not null")
    best = F.max(F.struct(-F.col("level"), F.col("source.key"), F.col("source.id").alias("parent")))
    return found.groupBy("id").agg(best.alias("b"), F.count_distinct("level", "hash").alias("linked")).select(
        "id", F.col("b.parent").alias("parent"), "linked")


def _ancestry(nodes: DataFrame) -> DataFrame:
    """id, root, depth from (id, parent).

    Each round doubles the distance that is known, for the nodes that have not
    reached their root yet; the others only answer.
    """
    first = written(nodes.select("id", F.coalesce("parent", "id").alias("root"),
                                 F.col("parent").isNotNull().cast("long").alias("depth"),
                                 F.col("parent").isNull().alias("done")), "ancestry")
    done, active = first.where("done"), first.where("not done")
    while active.take(1):
        known = done.union(active).select(F.col("id").alias("root"), F.col("root").alias("next"),
                                          F.col("depth").alias("more"), F.col("done").alias("over"))
        step = written(active.select("id", "root", "depth").join(known, "root").select(
            "id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"),
            F.col("over").alias("done")), "ancestry")
        done, active = done.union(step.where("done")), step.where("not done")
    return done.select("id", "root", "depth")


def link_quotations(messages: DataFrame, id_col: str = "id", scope_col: str = "scope", order_col: str = "place",
                    text_col: str = "text") -> DataFrame:
    """id, scope, place, root, depth, parent, own_text, quotes and linked for every message.

    Ordered by (root, depth, place) the rows of a root are its conversation in reply order.
    """
    prepare(messages.sparkSession)
    rows = written(messages.select(
        F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{scope_col}`").cast("string").alias("scope"),
        F.col(f"`{order_col}`").cast("long").alias("place"), F.col(f"`{text_col}`").alias("text"),
    ).mapInArrow(_parser, _PARSED), "messages")
    parents = written(_parents(rows), "parents")
    nodes = rows.where("id is not null").select("id").distinct().join(parents, "id", "left")
    placed = _ancestry(nodes).join(parents, "id", "left")
    out = rows.select("id", "scope", "place", "own_text", F.size("quoted").alias("quotes")).join(placed, "id", "left")
    return out.select("id", "scope", "place", F.coalesce("root", "id").alias("root"),
                      F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "parent", "own_text", "quotes",
                      F.coalesce("linked", F.lit(0).cast("long")).alias("linked"))


def with_quotations(turns: DataFrame, conversation: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """``turns`` as mail: each one quotes the turn before it, and that one's quotation of the turn before."""
    w = Window.partitionBy(conversation).orderBy(order)
    quote = lambda c: F.regexp_replace(c, r"(?m)^", "> ")
    last, older = F.lag(text, 1).over(w), F.lag(text, 2).over(w)
    nested = F.concat(F.when(older.isNotNull(), F.concat(F.lit("On another day someone wrote:\n"), quote(older), F.lit("\n\n")))
                      .otherwise(F.lit("")), F.coalesce(last, F.lit("")))
    head = F.when(F.row_number().over(w) > 1, F.concat(F.lit("On some day somebody wrote:\n"), quote(nested), F.lit("\n\n")))
    return turns.withColumn("mail", F.concat(F.coalesce(head, F.lit("")), F.coalesce(F.col(text), F.lit(""))))
