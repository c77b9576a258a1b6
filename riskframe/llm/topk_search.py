"""Exact top-k inner-product search with multi-resolution segment statistics.

Vectors become integers floor(scale * x).  A vector is cut into 1, 4, 16 and 32
segments; from the segments' means and deviations,
``sum(len * (mean_q * mean_x + dev_q * dev_x))`` bounds the inner product from
above (Cauchy-Schwarz; equivalently a lower bound of the distance).  A query
block meets a candidate block: some exact products give each query a first
threshold, then the bounds are tested coarse to fine, each level only on the
pairs that the level before left, and the pairs that survive get exact products:
one by one where few do, as columns of a matrix product where many do.

Candidates are dealt to blocks by hash, the query blocks are replicated to
them, and the best k of each pair of blocks are merged per query.  The work is
queries x rows (less what the bounds prune), as the task asks; memory is two
blocks of a fixed number of bytes.

Scores are exact at any size.  Products that stay under 2^53 are exact in
floating point.  Beyond, floating products with their error bound select what
can be among the best, and those are computed with whole numbers, as are pairs
too large for floating point.

Defined cases: rows whose id or vector is null, or whose vector is empty or
holds a null or non-finite component, take no part; vectors of different
lengths do not meet; a row never answers a query of its own id; repeated rows
each count; with fewer than k candidates all are returned; ties go to the
smaller id; a score beyond a long is ranked by its true value and given as the
greatest or least long; columns besides id and vector are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (1, 4, 16, 32)
#: Bytes of a candidate block and of a query block (eight a component).
BLOCK_BYTES, QUERY_BYTES = 32 << 20, 2 << 20
_TILE_Q, _TILE_C, _SEED = 256, 4096, 512
#: Share of a tile's pairs under which survivors are multiplied one by one.
_FEW = 0.05
#: Components beyond this are multiplied as whole numbers only; two of them overflow floating point.
_HUGE = 2.0 ** 400
_LONG = 1 << 63


def _pack_block(table: pa.Table) -> pa.Table:
    ids = table["id"].to_numpy().astype(np.int64)
    flat = table["vec"].combine_chunks().flatten().to_numpy().astype(np.float64)
    return pa.table({"dim": table["dim"].slice(0, 1), "block": table["block"].slice(0, 1),
                     "ids": pa.array([ids.tobytes()], pa.binary()), "flat": pa.array([flat.tobytes()], pa.binary())})


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Columns whose inner product with another vector's bounds their inner product from above."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    centred = x - np.repeat(mean, size, axis=1)
    dev = np.sqrt(np.add.reduceat(centred * centred, edges[:-1], axis=1) / size)
    return np.concatenate([mean, dev], axis=1) * np.sqrt(np.concatenate([size, size]))


def whole_numbers(x: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of each component, also where the product overflows floating point."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    return [int(b) if np.isfinite(b) else int(a) * scale for a, b in zip(x.tolist(), y.tolist(), strict=True)]


def _pruned(p_stats: list, s_stats: list, cols: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Which pairs of a tile can reach their query's ``limit``, tested coarse to fine."""
    live = np.ones((len(limit), len(cols)), bool)
    for p, s in zip(p_stats, s_stats, strict=True):
        some = np.flatnonzero(live.any(axis=0))
        if not len(some):
            break
        bound = p @ s[cols[some]].T
        slack = 0.5 + 1e-9 * np.abs(bound)  # scores are whole numbers; floats err far less
        live[:, some] &= bound + slack >= limit[:, None]
    return live


def block_top_k(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int,
                work: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query, id, score) of the best ``k`` candidates of one block for each query.

    For components of whole numbers whose products stay under 2^53.  ``work``
    counts pairs and the pairs whose exact product was needed.
    """
    out_q, out_i, out_s = [], [], []
    c_stats = [segment_statistics(c, n) for n in LEVELS]
    for a in range(0, len(q), _TILE_Q):
        part, own = q[a:a + _TILE_Q], q_ids[a:a + _TILE_Q]
        p_stats = [segment_statistics(part, n) for n in LEVELS]
        seed = part @ c[:_SEED].T
        seed[own[:, None] == c_ids[None, :_SEED]] = -np.inf
        limit = (np.partition(seed, -k, axis=1)[:, -k] if seed.shape[1] >= k else np.full(len(part), -np.inf))
        kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in part]
        for b in range(0, len(c), _TILE_C):
            cols = np.arange(b, min(len(c), b + _TILE_C))
            live = _pruned(p_stats, c_stats, cols, limit)
            if work is not None:
                work["pairs"] = work.get("pairs", 0) + live.size
                work["exact"] = work.get("exact", 0) + int(live.sum())
            if live.mean() < _FEW:
                at_q, at_c = np.nonzero(live)
                scores = np.full(live.shape, -np.inf)
                for s in range(0, len(at_q), 1 << 16):
                    x, y = at_q[s:s + (1 << 16)], at_c[s:s + (1 << 16)]
                    scores[x, y] = np.einsum("ij,ij->i", part[x], c[cols[y]])
            else:
                some = live.any(axis=0)
                cols, live = cols[some], live[:, some]
                scores = np.where(live, part @ c[cols].T, -np.inf)
            for r, row in enumerate(scores):
                at = np.flatnonzero((row >= limit[r]) & (row > -np.inf) & (c_ids[cols] != own[r]))
                if len(at):
                    kept[r].append((row[at], c_ids[cols[at]]))
                    if len(at) >= k:
                        limit[r] = max(limit[r], np.partition(row[at], -k)[-k])
        for r, found in enumerate(kept):
            if found:
                s, i = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                best = np.lexsort((i, -s))[:k]
                out_q.append(np.full(len(best), a + r))
                out_i.append(i[best])
                out_s.append(s[best])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0)
    return cat(out_q).astype(np.int64), cat(out_i).astype(np.int64), cat(out_s).astype(np.int64)


def large_top_k(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int,
                scale: int) -> tuple[list[int], list[int], list[int]]:
    """:func:`block_top_k` for vectors (not yet scaled) of any size: floating products with an error bound,
    then whole numbers for what can be among the best."""
    out: tuple[list, list, list] = ([], [], [])
    with np.errstate(over="ignore"):
        fq, fc = np.floor(scale * q), np.floor(scale * c)
    huge_q, huge_c = (np.abs(fq) > _HUGE).any(axis=1), (np.abs(fc) > _HUGE).any(axis=1)
    fq[huge_q], fc[huge_c] = 0.0, 0.0
    numbers: dict[int, list[int]] = {}
    slack = (q.shape[1] + 4) * 2.0 ** -52
    for r in range(len(q)):
        other = c_ids != q_ids[r]
        sure = np.flatnonzero(other & huge_c) if not huge_q[r] else np.flatnonzero(other)
        at = sure
        if not huge_q[r]:
            near = np.flatnonzero(other & ~huge_c)
            score = fc[near] @ fq[r]
            err = slack * (np.abs(fc[near]) @ np.abs(fq[r]))
            low = score - err
            limit = np.partition(low, -k)[-k] if len(near) >= k else -np.inf
            at = np.concatenate([sure, near[score + err >= limit]])
        mine = whole_numbers(q[r], scale)
        found = []
        for j in at.tolist():
            if j not in numbers:
                numbers[j] = whole_numbers(c[j], scale)
            found.append((-sum(x * y for x, y in zip(mine, numbers[j], strict=True)), int(c_ids[j])))
        for s, i in sorted(found)[:k]:
            for column, value in zip(out, (r, i, -s), strict=True):
                column.append(value)
        if len(numbers) > 4096:
            numbers.clear()
    return out


def _searcher(k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shape = (-1, row["dim"])
                q = np.frombuffer(row["q_flat"], np.float64).reshape(shape)
                c = np.frombuffer(row["flat"], np.float64).reshape(shape)
                q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                with np.errstate(over="ignore"):
                    most = np.abs(np.floor(scale * q)).max(initial=0) * np.abs(np.floor(scale * c)).max(initial=0)
                if row["dim"] * most < 2.0 ** 53:
                    at, i, s = block_top_k(q_ids, np.floor(scale * q), ids, np.floor(scale * c), k)
                    true = s.tolist()
                else:
                    at, i, true = large_top_k(q_ids, q, ids, c, k, scale)
                at = np.array(at, np.int64)
                yield pa.RecordBatch.from_pydict({
                    "query_row": pa.array((row["q_block"] << 32) + at), "query_id": pa.array(q_ids[at]),
                    "vec_id": pa.array(i, pa.int64()),
                    "score": pa.array([min(max(x, -_LONG), _LONG - 1) for x in true], pa.int64()),
                    # orders scores beyond a long: sign, length and digits (of the distance from the least, if negative)
                    "beyond": pa.array([None if -_LONG < x < _LONG - 1 else _ordered(x) for x in true], pa.string()),
                    "dim": pa.array([row["dim"]] * len(true), pa.int32())})
    return run


def _ordered(x: int) -> str:
    """A text that orders whole numbers beyond a long like the numbers."""
    if x >= 0:
        return f"{len(str(x)):08d}{x}"
    digits = str(-x)
    return f"{99999999 - len(digits):08d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vec_col: str = "embedding", block_bytes: int = BLOCK_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest integer inner products of every query row."""
    def usable(df: DataFrame) -> DataFrame:
        vec = F.col(f"`{vec_col}`")
        good = vec.isNotNull() & (F.size(vec) > 0) & F.col(f"`{id_col}`").isNotNull() & F.forall(
            vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(F.coalesce(good, F.lit(False))).select(
            F.col(f"`{id_col}`").cast("long").alias("id"), vec.cast("array<double>").alias("vec"),
            F.size(vec).alias("dim"))

    def bytes_of(df: DataFrame) -> int:
        return 8 * (df.agg(F.sum(F.col("dim").cast("long")).alias("n")).first().n or 0)

    cores = vectors.sparkSession.sparkContext.defaultParallelism
    rows, asked = usable(vectors), usable(queries)
    total = bytes_of(rows)
    blocks = max(1, -(-total // block_bytes), min(3 * cores, total >> 19))
    q_blocks = max(1, -(-bytes_of(asked) // query_bytes))
    packed = "dim int, block int, ids binary, flat binary"
    put = lambda df, size: (df.withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(size)).cast("int"))
                            .groupBy("dim", "block").applyInArrow(_pack_block, packed))
    found = put(rows, blocks)
    ask = put(asked, q_blocks).select(
        "dim", F.col("block").cast("long").alias("q_block"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = found.join(ask.hint("merge"), ["dim", "block"]).select("dim", "ids", "flat", "q_block", "q_ids", "q_flat")
    best = pairs.mapInArrow(_searcher(k, scale),
                            "query_row long, query_id long, vec_id long, score long, beyond string, dim int")
    order = Window.partitionBy("asked").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    return (best.withColumn("asked", F.struct("dim", "query_row", "query_id")).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
