"""Exact nearest neighbours and other all-pairs kernels (J5, B4, R9 building block).

Neighbours are found in metric cells.  Pivots are a hash sample of the right
rows; every row lies in the cell of its nearest pivot, and cells that lie
together make a bin.  A left row first meets its own bin, which gives it a k-th
distance; it then visits only the bins with a cell that the triangle inequality
does not rule out at that distance: cells whose ball or whose side of the
bisecting plane is farther away, or that lie outside the ring around their
pivot, are skipped.  So a row is copied once a bin at most, about 16 times up to
a million rows.  Bins are cut into blocks, so no task holds more than two blocks
however many rows share a cell; nothing is approximated.

Inside a task a matrix product in single precision gives a lower bound of every
squared distance, with its rounding error taken off; only pairs whose bound is
within the row's k-th distance so far are measured.  Where distances say nothing
(many dimensions, no clusters) all pairs are bounded: the search is quadratic
there, at a matrix product's cost a pair.

:func:`pairwise_blocks` is the plain all-pairs form for kernels that need every
pair; :func:`own_pair_blocks` takes the pairs of one table once (exact silhouettes).

Distances are Euclidean, summed over dimensions in order (same arithmetic as a
sequential SQL ``list_distance``); ties are broken by the right-hand key.
"""

from __future__ import annotations

import math
from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import cut_lineage

DEFAULT_BLOCK_ROWS = 0   # 0: sized from the data
#: Right rows of a cell on average, most pivots (their coordinates are in every task).
ROWS_PER_CELL, MAX_PIVOTS = 256, 2048
#: Least and most rows of a bin's block, and bins aimed at between those.
MIN_BIN_ROWS, CELL_BLOCK_ROWS, TARGET_BINS = 1024, 65_536, 16
#: Most tasks that pairs of blocks are dealt to.
MAX_TASKS = 512
MIN_BLOCK_ROWS, MAX_BLOCK_ROWS, TARGET_BLOCKS = 512, 100_000, 16


def _n_blocks(n: int, block_rows: int) -> int:
    """Blocks per side.  Replication (and shuffle) grows with the number of
    blocks on the other side, memory with the block size: aim for at most
    ~16 blocks of 512 to 100k rows."""
    if block_rows <= 0:
        block_rows = min(MAX_BLOCK_ROWS, max(MIN_BLOCK_ROWS, math.ceil(n / TARGET_BLOCKS)))
    return max(1, math.ceil(n / block_rows))


def pairwise_blocks(left: DataFrame, right: DataFrame, left_key: Sequence[str], right_key: Sequence[str],
                    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
                    block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Apply ``kernel(left_block, right_block)`` to every pair of blocks."""
    bl, br = _n_blocks(left.count(), block_rows), _n_blocks(right.count(), block_rows)
    # fresh attribute ids: both sides may derive from one Dataset (self joins)
    left = left.select(*[F.col(f"`{c}`").alias(c) for c in left.columns]).alias("__l")
    right = right.select(*[F.col(f"`{c}`").alias(c) for c in right.columns]).alias("__r")
    # block numbers of one type on both sides: numbers of another type hash to other partitions, and their groups never meet
    pick = lambda keys, n: F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lb = left.withColumn("__lb", pick(left_key, bl)).withColumn("__rb", every(br))
    rb = right.withColumn("__rb", pick(right_key, br)).withColumn("__lb", every(bl))
    lb, rb = (df.repartition(min(MAX_TASKS, bl * br), "__lb", "__rb") for df in (lb, rb))
    return lb.groupBy("__lb", "__rb").cogroup(rb.groupBy("__lb", "__rb")).applyInPandas(kernel, schema)


def own_pair_blocks(df: DataFrame, by: Sequence[str], blocks: int, kernel: Callable[[pd.DataFrame], pd.DataFrame],
                    schema: str) -> DataFrame:
    """Apply ``kernel`` to the rows of every two blocks of ``df``, taken once (and of every block alone).

    Rows are dealt to blocks by a hash of ``by``; the kernel gets them with their block __b and the pair's __lo <= __hi.
    """
    here = F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int")
    rows = df.withColumn("__b", here).withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) \
        .withColumns({"__lo": F.least("__b", "__o"), "__hi": F.greatest("__b", "__o")}).drop("__o")
    # more tasks than pairs, so that few tasks get two of them
    tasks = min(MAX_TASKS, 2 * blocks * (blocks + 1))
    return rows.repartition(tasks, "__lo", "__hi").groupBy("__lo", "__hi").applyInPandas(kernel, schema)


def _matrix(pdf: pd.DataFrame, vec: str) -> np.ndarray:
    if pdf[vec].isna().any():
        raise ValueError("a vector is NULL: drop or impute such rows before a neighbour search")
    x = np.stack([np.asarray(v, dtype="float64") for v in pdf[vec].to_numpy()])
    if not np.isfinite(x).all():
        raise ValueError("a vector holds NULL, NaN or infinity: drop or impute such rows before a neighbour search")
    return x


def distances(Q: np.ndarray, R: np.ndarray) -> np.ndarray:
    """Euclidean distance matrix, summing squared differences dimension by dimension."""
    acc = np.zeros((Q.shape[0], R.shape[0]))
    for j in range(Q.shape[1]):
        d = Q[:, j][:, None] - R[:, j][None, :]
        acc += d * d
    return np.sqrt(acc)


def paired_distances(Q: np.ndarray, R: np.ndarray) -> np.ndarray:
    """Distances of row i of ``Q`` to row i of ``R``, summed like :func:`distances`."""
    acc = np.zeros(len(Q))
    for j in range(Q.shape[1]):
        d = Q[:, j] - R[:, j]
        acc += d * d
    return np.sqrt(acc)


#: Up to so many dimensions distances are summed one by one; beyond, a product gives their squares.  A square below this
#: share of the squared norms has lost digits there: it is measured.
FEW_DIMS, LOST = 4, 2.0 ** -10


class Products:
    """Distances of slices of ``Q`` and ``R`` by a matrix product of rows around their middle.

    A squared distance is wrong by (dimensions + 4) 2^-52 of the squared norms at most, so those that are not below
    ``LOST`` of these keep 10 digits and more; the others are measured.  Where they are many, the slices are
    first moved to the middle of the right one.
    """

    def __init__(self, Q: np.ndarray, R: np.ndarray):
        self.Q, self.R = Q, R
        if Q.shape[1] > FEW_DIMS:
            self.moved = self._around(Q, R, R.mean(axis=0))

    @staticmethod
    def _around(Q: np.ndarray, R: np.ndarray, middle: np.ndarray) -> tuple:
        q, r = Q - middle, R - middle
        qn, rn = (q * q).sum(axis=1), (r * r).sum(axis=1)
        return (np.column_stack([-2 * q, qn, np.ones(len(q))]), np.column_stack([r, np.ones(len(r)), rn]), qn, rn)

    @staticmethod
    def _squares(q: np.ndarray, r: np.ndarray, qn: np.ndarray, rn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances, and the places of those that lost digits."""
        D = q @ r.T
        if D.min() > LOST * (qn.max() + rn.max()):
            return D, np.zeros(0, np.int64)
        return D, np.flatnonzero(~(D > LOST * (qn[:, None] + rn)).reshape(-1))

    def distances(self, s: slice, t: slice) -> np.ndarray:
        Q, R = self.Q[s], self.R[t]
        if Q.shape[1] <= FEW_DIMS:
            return distances(Q, R)
        with np.errstate(over="ignore", invalid="ignore"):
            D, lost = self._squares(*(x[at] for x, at in zip(self.moved, (s, t, s, t))))
            if 64 * len(lost) > D.size:
                D, lost = self._squares(*self._around(Q, R, R.mean(axis=0)))
        D.reshape(-1)[lost] = 0.0
        np.sqrt(D, out=D)
        D.reshape(-1)[lost] = _measure(Q, R, *np.divmod(lost, len(R)))
        return D


def same_key_pairs(lp: pd.DataFrame, rp: pd.DataFrame, lkey: Sequence[str], rkey: Sequence[str]
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of rows with equal keys (a NULL equals nothing)."""
    names = [f"k{i}" for i in range(len(lkey))]
    sides = [pdf[list(key)].set_axis(names, axis=1).reset_index(drop=True).rename_axis(at).reset_index().dropna()
             for pdf, key, at in ((lp, lkey, "i"), (rp, rkey, "j"))]
    both = sides[0].merge(sides[1], on=names)
    return both["i"].to_numpy(), both["j"].to_numpy()


def _key_rank(pdf: pd.DataFrame, key: Sequence[str]) -> np.ndarray:
    """Position of each row in key order (for tie-breaking)."""
    order = np.lexsort([pdf[k].to_numpy() for k in reversed(key)])
    rank = np.empty(len(pdf), dtype="int64")
    rank[order] = np.arange(len(pdf))
    return rank


def _spare_copies(rp: pd.DataFrame, R: np.ndarray, rank: np.ndarray, rkey: Sequence[str], k: int) -> np.ndarray:
    """Positions of the rows that can be among ``k`` nearest: of equal vectors those of the first k + 1 keys."""
    bits = np.ascontiguousarray(R).view(np.dtype((np.void, R.itemsize * R.shape[1]))).reshape(-1)
    _, group, size = np.unique(bits, return_inverse=True, return_counts=True)
    if size.max() <= k + 1:
        return np.arange(len(R))
    order = np.lexsort((rank, group))
    first = np.append(True, np.diff(group[order]) != 0)
    new = first.copy()
    for c in rkey:
        v = rp[c].to_numpy()[order]
        new[1:] |= v[1:] != v[:-1]
    keys = np.cumsum(new)
    nth = keys - np.maximum.accumulate(np.where(first, keys, 0))
    return np.sort(order[nth <= k])


def _chunks(own: np.ndarray, least: int = 128, most: int = 512) -> list[slice]:
    """Slices of rows in cell order: whole cells where they fit."""
    cuts, out, start = [*(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)], [], 0
    for cut in cuts:
        if cut - start >= least or cut == len(own):
            out += [slice(s, min(s + most, cut)) for s in range(start, cut, most)]
            start = cut
    return out


def _measure(Q: np.ndarray, R: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 65_536) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(paired_distances(Q[i[s:s + step]], R[j[s:s + step]])
                                          for s in range(0, len(i), step))])


def _nearest(lp: pd.DataFrame, rp: pd.DataFrame, k: int, lkey, rkey, vec: str, exclude_self: bool, cells: "Cells",
             limit: np.ndarray | None = None, wide: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left positions, right positions and distances of the local top k within ``limit``, by left row and rank.

    A chunk of left rows meets the right cells nearest first, up to ``wide`` rows at a time, until the
    rest lies farther than the k-th distances.  Squared distances are bounded from below by one product:
    |r|^2 - 2 q r, less ``loss`` (|q|^2 + |r|^2), which exceeds what single precision can be wrong by.
    """
    Q, R = _matrix(lp, vec), _matrix(rp, vec)
    rank = _key_rank(rp, rkey)
    keep = _spare_copies(rp, R, rank, rkey, k)
    keep = keep[np.argsort(rp["__cell"].to_numpy()[keep], kind="stable")]
    own, R, rank = rp["__cell"].to_numpy()[keep], R[keep], rank[keep]
    banned, extra = np.zeros(0, np.int64), 0
    if exclude_self:
        i, j = same_key_pairs(lp, rp.iloc[keep], lkey, rkey)
        banned = np.sort(i * len(R) + j)
        extra = int(np.bincount(i).max()) if len(i) else 0
    centre = np.median(R[::max(1, len(R) // 4096)], axis=0)
    span = max(np.abs(Q - centre).max(), np.abs(R - centre).max()) or 1.0
    q, r = (Q - centre) / span, (R - centre) / span
    loss = (Q.shape[1] + 8) * 2.0 ** -23
    qn, rn = (q * q).sum(axis=1) * (1 - loss), (r * r).sum(axis=1) * (1 - loss)
    q = np.column_stack([-2 * q, np.ones(len(q))]).astype("float32")
    r = np.column_stack([r, rn]).astype("float32")
    starts = np.flatnonzero(np.append(True, np.diff(own) != 0))
    pivots, high = cells.pivots[own[starts]], cells.high[own[starts]]
    ends = np.append(starts[1:], len(own))
    limit = np.full(len(Q), np.inf) if limit is None else limit
    order = np.argsort(lp["__cell"].to_numpy(), kind="stable")
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for part in _chunks(lp["__cell"].to_numpy()[order]):
        rows = order[part]
        middle = Q[rows].mean(axis=0)
        away = distances(middle[None], pivots)[0]
        near = away - distances(middle[None], Q[rows]).max() - high
        near -= 1e-9 * (1 + np.abs(away) + high)
        pieces = [(near[c], s, min(s + wide, ends[c])) for c in np.argsort(near, kind="stable")
                  for s in range(starts[c], ends[c], wide)]
        th = limit[rows].copy()
        row, col, dist = out[0]
        at = 0
        while at < len(pieces) and pieces[at][0] <= th.max():
            to, held = at, 0
            while to < len(pieces) and (to == at or held + pieces[to][2] - pieces[to][1] <= wide):
                held += pieces[to][2] - pieces[to][1]
                to += 1
            idx = np.concatenate([np.arange(s, e) for _, s, e in pieces[at:to]])
            at = to
            least = q[rows] @ r[idx].T
            unknown = np.flatnonzero(np.isinf(th))
            if len(unknown) and k + extra < len(idx):  # any k rows give a first distance
                some = np.argpartition(least[unknown], k + extra - 1, axis=1)[:, :k + extra]
                d = _measure(Q, R, np.repeat(rows[unknown], k + extra), idx[some.reshape(-1)])
                d[_among(np.repeat(rows[unknown], k + extra) * len(R) + idx[some.reshape(-1)], banned)] = np.inf
                th[unknown] = np.sort(d.reshape(len(unknown), -1), axis=1)[:, k - 1]
            reach = (th / span) ** 2 * (1 + 1e-9) - qn[rows]
            reach = np.nextafter(reach.astype("float32"), np.float32(np.inf))
            i, j = np.divmod(np.flatnonzero((least <= reach[:, None]).reshape(-1)), len(idx))
            j = idx[j]
            d = _measure(Q, R, rows[i], j)
            ok = (d <= th[i]) & ~_among(rows[i] * len(R) + j, banned)
            row, col, dist = (np.concatenate(x) for x in ((row, i[ok]), (col, j[ok]), (dist, d[ok])))
            best = np.lexsort((rank[col], dist, row))
            row, col, dist = row[best], col[best], dist[best]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            th[row[place == k - 1]] = dist[place == k - 1]
            row, col, dist = row[place < k], col[place < k], dist[place < k]
        out.append((rows[row], keep[col], dist))
    row, col, dist = (np.concatenate(x) for x in zip(*out))
    by_row = np.argsort(row, kind="stable")
    return row[by_row], col[by_row], dist[by_row]


def _among(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether each of ``x`` is in the sorted ``found``."""
    if not len(found):
        return np.zeros(len(x), bool)
    return found[np.minimum(np.searchsorted(found, x), len(found) - 1)] == x


def _candidates(lp, rp, rows, picked, dist, lkey, rkey, out_rkey, payload) -> pd.DataFrame:
    return pd.DataFrame({**{a: lp[a].to_numpy()[rows] for a in lkey},
                         **{ob: rp[b].to_numpy()[picked] for b, ob in zip(rkey, out_rkey)},
                         **{f"__p_{c}": rp[c].to_numpy()[picked] for c in payload}, "dist": dist})


class Cells:
    """Pivots and, per cell of right rows, their number and least and greatest distance to the pivot.

    Pivots are ordered so that those that lie together follow one another; ``bin_of`` deals the cells to bins in that order.
    """

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots[_tree_order(pivots)]
        self.centre = self.pivots.mean(axis=0)
        self.between = np.sqrt(self._squares(self.pivots)[0])
        self.n = np.zeros(len(pivots), np.int64)
        self.low, self.high = np.full(len(pivots), np.inf), np.zeros(len(pivots))
        self.bin_of = np.zeros(len(pivots), np.int64)

    def describe(self, rows, bin_rows: int = CELL_BLOCK_ROWS) -> None:
        for cell, n, low, high in rows:
            self.n[cell], self.low[cell], self.high[cell] = n, low, high
        at = held = 0
        for cell, n in enumerate(self.n.tolist()):
            if held and held + n > bin_rows:
                at, held = at + 1, 0
            self.bin_of[cell], held = at, held + n

    def _squares(self, Q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the pivots by one matrix product, and what rounding can make them wrong by."""
        q, p = Q - self.centre, self.pivots - self.centre
        norms = (q * q).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :]
        return np.maximum(norms - 2 * (q @ p.T), 0.0), (Q.shape[1] + 8) * 2.0 ** -50 * norms

    def nearest(self, Q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot (the first of equal ones) and its distance."""
        D, error = self._squares(Q)
        cell = D.argmin(axis=1)
        rows = np.arange(len(Q))
        close = np.flatnonzero(((D - error) <= (D + error)[rows, cell][:, None]).sum(axis=1) > 1)
        cell[close] = distances(Q[close], self.pivots).argmin(axis=1)
        return cell, paired_distances(Q, self.pivots[cell])

    def reached(self, Q: np.ndarray, own: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row and cell, whether it can hold one of the row's ``k`` nearest, and the distance that bounds those.

        ``limit``: a distance within which the row has ``k`` rows; infinite if none is known.
        """
        squares, error = self._squares(Q)
        D, least_d = np.sqrt(squares + error), np.sqrt(np.maximum(squares - error, 0))
        bound, rows = limit.copy(), np.arange(len(Q))
        if k and np.isinf(bound).any():  # the nearest cells that hold k rows together, counted whole
            far = D + self.high
            order = np.argsort(far, axis=1)
            held = np.cumsum(self.n[order], axis=1) >= k
            at = np.where(held.any(axis=1), held.argmax(axis=1), 0)
            known = np.where(held.any(axis=1), np.take_along_axis(far, order, 1)[rows, at], np.inf)
            bound = np.where(np.isinf(bound), known * (1 + 1e-9), bound)
        gap = 2 * self.between[own]
        ahead = squares - error - (squares + error)[rows, own][:, None]
        plane = np.divide(ahead, gap, out=np.zeros_like(D), where=gap > 0)
        least = np.maximum(np.maximum(least_d - self.high, self.low - D), plane)
        slack = 1e-9 * (1 + D + np.where(np.isinf(bound), 0, bound)[:, None])  # rounding of the bounds
        return (least <= bound[:, None] + slack) & (self.n > 0), bound

    def visits(self, Q: np.ndarray, own: np.ndarray, limit: np.ndarray, k: int) -> tuple[list[list[int]], np.ndarray]:
        """Bins besides its own to visit for each row, and the distance that bounds what counts there."""
        starts = np.flatnonzero(np.append(True, np.diff(self.bin_of) != 0))
        to, bounds = [], [np.zeros(0)]
        for s in range(0, len(Q), 1024):
            mine = own[s:s + 1024]
            go, bound = self.reached(Q[s:s + 1024], mine, limit[s:s + 1024], k)
            bins = np.logical_or.reduceat(go, starts, axis=1)
            bins[np.arange(len(bins)), self.bin_of[mine]] = False
            to += [np.flatnonzero(b).tolist() for b in bins]
            bounds.append(bound)
        return to, np.concatenate(bounds)


def _tree_order(P: np.ndarray) -> np.ndarray:
    """An order of points by halving along the widest dimension, so that near points follow one another."""
    def halve(at: np.ndarray) -> list:
        if len(at) < 2:
            return at.tolist()
        at = at[np.argsort(P[at, np.ptp(P[at], axis=0).argmax()], kind="stable")] if P.shape[1] else at
        return halve(at[:len(at) // 2]) + halve(at[len(at) // 2:])
    return np.array(halve(np.arange(len(P))), dtype=np.int64)


def _assigner(cells, key, vec, carried):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                Q = _matrix(pdf, vec)
                cell, dist = np.empty(len(Q), np.int32), np.empty(len(Q))
                for s in range(0, len(Q), 1024):
                    cell[s:s + 1024], dist[s:s + 1024] = cells.value.nearest(Q[s:s + 1024])
                yield pdf[[*key, vec, *carried]].assign(__cell=cell, __pd=dist)
    return run


def _own_bin_kernel(cells, k, lkey, rkey, out_rkey, vec, exclude_self, payload):
    """Top k of the own bin; besides, a row with distance -1 (its right columns say nothing) that holds
    the left vector, its cell, the bins to visit next and the distance that bounds what counts there."""
    def fn(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        rows, picked, dist = _nearest(lp, rp, k, lkey, rkey, vec, exclude_self, cells.value) if len(lp) and len(rp) \
            else (none, none, np.zeros(0))
        to, state = [None] * len(rows), (np.zeros(len(rows), np.int32), np.zeros(len(rows)))
        vecs = np.full(len(rows), None, dtype=object)
        if len(lp) and len(rp) and not rp["__rb"].iloc[0]:  # a bin's first right block answers for it
            limit, full = np.full(len(lp), np.inf), np.bincount(rows, minlength=len(lp)) >= k
            np.maximum.at(low := np.zeros(len(lp)), rows, dist)
            limit[full] = low[full]
            own = lp["__cell"].to_numpy()
            more, bound = cells.value.visits(_matrix(lp, vec), own, limit, 0 if exclude_self else k)
            rows, picked = np.append(rows, np.arange(len(lp))), np.append(picked, np.zeros(len(lp), np.int64))
            dist, to = np.append(dist, np.full(len(lp), -1.0)), to + more
            state = np.append(state[0], own.astype("int32")), np.append(state[1], bound)
            vecs = np.append(vecs, lp[vec].to_numpy())
        # whole arrays, no pieces put together: text columns of several chunks cannot be handed to Spark
        found = _candidates(lp, rp, rows, picked, dist, lkey, rkey, out_rkey, payload)
        found[vec], found["__cell"] = pd.Series(vecs, dtype=object), state[0]
        found["__to"], found["__th"] = pd.Series(to, dtype=object), state[1]
        return found
    return fn


def _visit_kernel(cells, k, lkey, rkey, out_rkey, vec, exclude_self, payload):
    def fn(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return _candidates(lp, rp, [], [], [], lkey, rkey, out_rkey, payload)
        rows, picked, dist = _nearest(lp, rp, k, lkey, rkey, vec, exclude_self, cells.value, lp["__th"].to_numpy())
        return _candidates(lp, rp, rows, picked, dist, lkey, rkey, out_rkey, payload)
    return fn


def _meet(left: DataFrame, right: DataFrame, kernel, schema: str, lkey, rkey, block_rows: tuple[int, int],
          by: str = "__cell") -> DataFrame:
    """``kernel`` on the rows of each cell or bin (column ``by`` of both sides), in blocks of about ``block_rows`` (left, right)."""
    def blocks(df: DataFrame, rows: int) -> dict:  # one row per cell: bounded by the number of pivots
        return {r[by]: -(-r["n"] // rows) for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}

    nl, nr = blocks(left, block_rows[0]), blocks(right, block_rows[1])
    both = [(c, nl[c], nr[c]) for c in nl.keys() & nr.keys()]
    if max([*nl.values(), *nr.values()], default=1) == 1:
        lb, rb = (df.withColumns({"__lb": F.lit(0), "__rb": F.lit(0)}) for df in (left, right))
    else:
        table = lambda: F.broadcast(left.sparkSession.createDataFrame(
            both, f"{by} int, __lblocks int, __rblocks int"))
        pick = lambda key, n: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        lb = left.join(table(), by).withColumn("__lb", pick(lkey, "__lblocks")).withColumn("__rb", every("__rblocks"))
        rb = right.join(table(), by).withColumn("__rb", pick(rkey, "__rblocks")).withColumn("__lb", every("__lblocks"))
    at = [by, "__lb", "__rb"]
    # a task per pair of blocks, if there are not too many: the work of a pair is more than its bytes tell
    tasks = min(MAX_TASKS, max(1, sum(a * b for _, a, b in both)))
    lb, rb = lb.repartition(tasks, *at), rb.repartition(tasks, *at)
    return lb.groupBy(*at).cogroup(rb.groupBy(*at)).applyInPandas(kernel, schema)


def _ddl(df: DataFrame, cols: Sequence[str], rename: Sequence[str] | None = None) -> str:
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    names = rename or cols
    return ", ".join(f"{n} {types[c].simpleString()}" for c, n in zip(cols, names))


def _bin_rows(n: int) -> int:
    return min(CELL_BLOCK_ROWS, max(MIN_BIN_ROWS, -(-n // TARGET_BINS)))


def _in_cells(right: DataFrame, rkey: Sequence[str], vec: str, payload: Sequence[str],
              rows_per_cell: int, bin_rows: int = 0) -> tuple[Cells | None, DataFrame]:
    """The cells of the right rows (None without rows), and the rows with their cells (written).

    ``bin_rows``: rows of a bin; 0: sized from the data.
    """
    n = right.count()
    if not n:
        return None, right
    m = max(1, min(MAX_PIVOTS, n // rows_per_cell))
    picked = right.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(*rkey), *rkey).limit(m).select(vec).collect()
    pivots = np.unique(np.array([[np.nan if x is None else x for x in r[0]] for r in picked], dtype="float64")
                       .reshape(len(picked), -1), axis=0)
    pivots = pivots[np.isfinite(pivots).all(axis=1)]  # a hole is an error where the rows are read
    cells = Cells(pivots if len(pivots) else np.zeros((1, pivots.shape[1])))
    placed = cut_lineage(_to_cells(right, cells, rkey, vec, payload))
    cells.describe(placed.groupBy("__cell").agg(F.count(F.lit(1)), F.min("__pd"), F.max("__pd")).collect(),
                   bin_rows or _bin_rows(n))
    return cells, placed


def _to_cells(df: DataFrame, cells: Cells, key: Sequence[str], vec: str, payload: Sequence[str]) -> DataFrame:
    schema = f"{_ddl(df, [*key, vec, *payload])}, __cell int, __pd double"
    shared = df.sparkSession.sparkContext.broadcast(cells)
    return df.select(*key, vec, *payload).mapInPandas(_assigner(shared, key, vec, payload), schema)


def cell_join(left: DataFrame, right: DataFrame, k: int, left_key: Sequence[str], right_key: Sequence[str],
              vec: str = "vec", exclude_self: bool = False, prefix: str = "nn_", block_rows: int = 0,
              payload: Sequence[str] = (), rows_per_cell: int = ROWS_PER_CELL) -> tuple[DataFrame, DataFrame]:
    """Candidates (those of the own bin and of the visited bins), and the visits.

    Visits, one row per left row: left key..., vec, __cell, __to (bins visited besides the own one), __th.
    """
    lkey, rkey = list(left_key), list(right_key)
    out_rkey = [f"{prefix}{c}" for c in rkey]
    carried = f", {_ddl(right, payload, [f'__p_{c}' for c in payload])}" if payload else ""
    schema = f"{_ddl(left, lkey)}, {_ddl(right, rkey, out_rkey)}{carried}, dist double"
    # fresh attribute ids: both sides may derive from one Dataset (self joins)
    fresh = lambda df, cols: df.select(*[F.col(f"`{c}`").alias(c) for c in cols])
    cells, placed = _in_cells(fresh(right, [*rkey, vec, *payload]), rkey, vec, payload, rows_per_cell, block_rows)
    if cells is None:
        nowhere = left.select(*lkey, vec, F.lit(0).alias("__cell"), F.expr("CAST(array() AS array<int>)").alias("__to"),
                              F.lit(0.0).alias("__th"))
        return left.sparkSession.createDataFrame([], schema), nowhere
    asked = cut_lineage(_to_cells(fresh(left, [*lkey, vec]), cells, lkey, vec, ()))
    shared = left.sparkSession.sparkContext.broadcast(cells)
    rows = tuple(block_rows or _bin_rows(n) for n in (asked.count(), int(cells.n.sum())))
    bins = lambda: F.broadcast(left.sparkSession.createDataFrame(  # noqa: E731  (one row per cell)
        list(enumerate(cells.bin_of.tolist())), "__cell int, __bin int"))
    asked, placed = asked.join(bins(), "__cell"), placed.join(bins(), "__cell")
    args = (shared, k, lkey, rkey, out_rkey, vec, exclude_self, tuple(payload))
    first = cut_lineage(_meet(asked, placed, _own_bin_kernel(*args),
                              f"{schema}, {_ddl(left, [vec])}, __cell int, __to array<int>, __th double",
                              lkey, rkey, rows, "__bin"))
    own = first.where("dist >= 0").drop(vec, "__cell", "__to", "__th")
    visits = first.where("dist < 0").select(*lkey, vec, "__cell", "__to", "__th")
    if not cells.bin_of.any():  # one bin: every row has met all rows
        return own, visits
    others = visits.select(*lkey, vec, "__cell", "__th", F.explode("__to").alias("__bin"))
    return own.unionByName(_meet(others, placed, _visit_kernel(*args), schema, lkey, rkey, rows, "__bin")), visits


def knn_join(left: DataFrame, right: DataFrame, k: int, left_key: Sequence[str],
             right_key: Sequence[str] | None = None, vec: str = "vec", exclude_self: bool = False,
             prefix: str = "nn_", block_rows: int = DEFAULT_BLOCK_ROWS, payload: Sequence[str] = (),
             rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """For each left row its k nearest right rows: (left key..., nn_<right key>..., rank, dist).

    ``payload`` columns of the right rows come along as ``__p_<name>``, so
    repeated right keys need no join back.

    Each visited bin gives at most k candidates (per block); a final window over
    each left key keeps the global top k.
    """
    lkey, rkey = list(left_key), list(right_key or left_key)
    found, _ = cell_join(left, right, k, lkey, rkey, vec, exclude_self, prefix, block_rows, payload, rows_per_cell)
    w = Window.partitionBy(*lkey).orderBy("dist", *[f"{prefix}{c}" for c in rkey])
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_classify(train: DataFrame, test: DataFrame, key: Sequence[str], k: int = 5, vec: str = "vec",
                 label: str = "label", pred: str = "pred") -> DataFrame:
    """Majority vote of the k nearest training rows (ties -> smallest label).

    The label rides with its training row through the search: resampled rows
    that share a key each cast one vote.
    """
    nn = knn_join(test, train.select(*key, vec, F.col(label).alias("__nl")), k, key, key, vec, payload=["__nl"])
    votes = nn.groupBy(*key, F.col("__p___nl").alias("__nl")).agg(F.count(F.lit(1)).alias("__v"))
    best = votes.groupBy(*key).agg(
        F.max_by(F.col("__nl"), F.struct(F.col("__v"), -F.col("__nl"))).alias(pred))
    return test.join(best, list(key), "left")


def vec_from_columns(df: DataFrame, features: Sequence[str], vec: str = "vec") -> DataFrame:
    return df.withColumn(vec, F.array(*[F.col(f).cast("double") for f in features]))


__all__ = ["pairwise_blocks", "own_pair_blocks", "knn_join", "cell_join", "knn_classify", "distances", "vec_from_columns"]
