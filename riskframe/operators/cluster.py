"""Clustering steps (R3, R7-R11): silhouette, KMeans splits, guided under-sampling, centroids, medoids.

Silhouette is exact Euclidean: one pass emits, per row, the sum of distances to
every cluster (all pairs of blocks, each once, by matrix products; of one
dimension, running sums over the sorted rows); everything after that is small
grouped aggregation.  Spark's ClusteringEvaluator only offers squared Euclidean or
cosine, so it is kept as the approximate ``mode='squared'``.

Where the number of centres grows with the data (R3), centres are a table:
rows meet their nearest centre in the metric cells of :mod:`knn`.  Medoids
(R11) are PAM over all rows; candidates are bounded by the cells' means and
spreads, and those that can be best weighed pair by pair.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.knn import (MIN_BLOCK_ROWS, Products, _ddl, _in_cells, _matrix, _n_blocks, distances, knn_join,
                                     own_pair_blocks, pairwise_blocks, same_key_pairs)
from riskframe.operators.resample import roles
from riskframe.operators.splits import exact_rank
from riskframe.session import cut_lineage


#: Rows of a side of a tile (its distances stay in the processor's cache), clusters whose sums share a row of partial
#: sums, sums that a block of rows may hold, rows of a part of a line.
TILE, WIDTH, BLOCK_SUMS, LINE_ROWS = 512, 16, 2 ** 24, 100_000


def _slice_sums(D: np.ndarray, starts: np.ndarray, axis: int) -> np.ndarray:
    """Sums along ``axis`` of the slices that begin at ``starts``."""
    if len(starts) > 16:
        return np.add.reduceat(D, starts, axis=axis)
    cut = [slice(a, b) for a, b in zip(starts, [*starts[1:], D.shape[axis]])]
    return np.stack([(D[:, c] if axis else D[c]).sum(axis=axis) for c in cut], axis=axis)


def _sums_out(pdf: pd.DataFrame, key, total: np.ndarray) -> pd.DataFrame:
    """Partial sums (row, cluster) as rows of ``WIDTH`` clusters."""
    width = min(WIDTH, max(1, total.shape[1]))
    n = -(-total.shape[1] // width)
    wide = np.zeros((len(pdf), n * width))
    wide[:, :total.shape[1]] = total
    wide = wide.reshape(-1, width)
    # whole arrays, no pieces put together: text columns of several chunks cannot be handed to Spark
    return pd.DataFrame({**{c: np.repeat(pdf[c].to_numpy(), n) for c in [*key, "__lc"]},
                         "__j": np.tile(np.arange(n, dtype="int32"), len(pdf)),
                         **{f"__s{i}": wide[:, i] for i in range(width)}})


def _cluster_sum_kernel(key, clusters: int, vec):
    """Distance sums of the rows of two blocks to each other's clusters: every pair is measured once, for both rows."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort(pdf["__code"].to_numpy(), kind="stable")]  # a cluster's rows lie together
        block, one = pdf["__b"].to_numpy(), pdf["__lo"].iloc[0] == pdf["__hi"].iloc[0]
        at = [np.flatnonzero(block == pdf[c].iloc[0]) for c in (("__lo",) if one else ("__lo", "__hi"))]
        total = np.zeros((len(pdf), clusters + 1))  # the last: rows without a cluster
        if not all(len(x) for x in at):
            return _sums_out(pdf, key, total[:, :clusters])
        left, right = pdf.iloc[at[0]], pdf.iloc[at[-1]]
        X, codes = [_matrix(pdf.iloc[x], vec) for x in at], [pdf["__code"].to_numpy()[x] for x in at]
        pairs = Products(X[0], X[-1])
        sums = [np.zeros((len(x), clusters + 1)) for x in at]
        tall, wide = -(-len(left) // TILE), -(-len(right) // TILE)
        i, j = same_key_pairs(left, right, key, key)  # rows of one key have no distance
        i, j = (i[i != j], j[i != j]) if one else (i, j)
        tile = i // TILE * wide + j // TILE
        order = np.argsort(tile, kind="stable")
        i, j, tile = i[order], j[order], tile[order]
        cut = lambda code, x: np.flatnonzero(np.diff(code[x], prepend=code[x][0] - 1))
        for a in range(tall):
            s = slice(a * TILE, (a + 1) * TILE)
            for b in range(a if one else 0, wide):
                t = slice(b * TILE, (b + 1) * TILE)
                D = pairs.distances(s, t)
                same = slice(*np.searchsorted(tile, [a * wide + b, a * wide + b + 1]))
                D[i[same] - s.start, j[same] - t.start] = 0.0
                starts = cut(codes[-1], t)
                sums[0][s, codes[-1][t][starts]] += _slice_sums(D, starts, 1)
                if not one or a != b:
                    starts = cut(codes[0], s)
                    sums[-1][t, codes[0][s][starts]] += _slice_sums(D, starts, 0).T
        for x, found in zip(at, sums):
            total[x] = found
        return _sums_out(pdf, key, total[:, :clusters])
    return fn


def _line(x: np.ndarray, code: np.ndarray, middle: np.ndarray, n: np.ndarray, total: np.ndarray, n_before: np.ndarray,
          before: np.ndarray) -> np.ndarray:
    """Distance sums of ascending ``x`` to clusters of ``n`` rows that sum to ``total`` around their ``middle``.

    ``n_before`` and ``before``: number and sum of the rows below ``x``; they are moved past it.
    """
    out = np.empty((len(x), len(n)))
    for c in range(len(n)):
        y, own = x - middle[c], code == c
        k, s = n_before[c] + np.cumsum(own), before[c] + np.cumsum(np.where(own, y, 0.0))
        out[:, c] = y * (2 * k - n[c]) - 2 * s + total[c]
        n_before[c], before[c] = k[-1], s[-1]
    return np.maximum(out, 0.0)


def _line_sums(rows: DataFrame, key: list, clusters: int, n: int, vec: str, ddl: str, schema: str) -> DataFrame:
    """Partial distance sums of rows of one dimension: sorted, what lies below and above a row is known from running sums.

    Rows are dealt to ranges; the ranges' counts and sums (ranges x clusters) are all that tasks share.
    """
    def flat(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf[[*key, "__lc", "__code"]].assign(__v=_matrix(pdf, vec)[:, 0])

    line = rows.mapInPandas(flat, f"{ddl}, __code int, __v double")
    line = cut_lineage(line.repartitionByRange(max(1, -(-n // LINE_ROWS)), "__v").sortWithinPartitions("__v")
                       .withColumn("__p", F.spark_partition_id()))
    spark, real = rows.sparkSession, line.where("__code >= 0")
    # a row's value, so that sums over equal rows are exactly 0
    middles = real.groupBy("__code").agg(F.percentile_approx("__v", 0.5).alias("__m")).collect()
    middle = np.zeros(clusters)
    for r in middles:
        middle[r["__code"]] = r["__m"]
    table = F.broadcast(spark.createDataFrame([(r["__code"], r["__m"]) for r in middles], "__code int, __m double"))
    parts = real.join(table, "__code").groupBy("__p", "__code").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("__v") - F.col("__m")).alias("s")).collect()
    ranges = 1 + max((r["__p"] for r in parts), default=0)
    counts, sums = np.zeros((ranges + 1, clusters), np.int64), np.zeros((ranges + 1, clusters))
    for r in parts:
        counts[r["__p"] + 1, r["__code"]], sums[r["__p"] + 1, r["__code"]] = r["n"], r["s"]
    shared = spark.sparkContext.broadcast((middle, counts.cumsum(axis=0), sums.cumsum(axis=0)))

    def run(batches):
        middle, counts, sums = shared.value
        at = None
        for pdf in batches:
            if len(pdf):
                if at is None:  # a task reads one range
                    p = min(int(pdf["__p"].iloc[0]), len(counts) - 1)
                    at = counts[p].copy(), sums[p].copy()
                yield _sums_out(pdf, key, _line(pdf["__v"].to_numpy(), pdf["__code"].to_numpy(), middle, counts[-1],
                                                sums[-1], *at))

    def of_one_key(pdf):
        middle = shared.value[0]
        pdf = pdf.sort_values("__v")
        x, code = pdf["__v"].to_numpy(), pdf["__code"].to_numpy()
        n = np.array([(code == c).sum() for c in range(clusters)], dtype="int64")
        total = np.array([(x[code == c] - middle[c]).sum() for c in range(clusters)])
        return _sums_out(pdf, key, -_line(x, code, middle, n, total, np.zeros(clusters, np.int64), np.zeros(clusters)))

    out = line.mapInPandas(run, schema)
    repeated = line.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").dropna(subset=key)
    if repeated.isEmpty():
        return out
    # rows of one key have no distance
    return out.unionByName(line.join(repeated.drop("__n"), key).groupBy(*key).applyInPandas(of_one_key, schema))


def cluster_distance_sums(df: DataFrame, key: Sequence[str], cluster: str, vec: str = "vec",
                          block_rows: int = 0) -> DataFrame:
    """(key..., own cluster, other cluster, sum of distances from the row to that cluster).

    Rows of one dimension are sorted; else all pairs are measured, each once, block by block.
    """
    key = list(key)
    kind = df.schema[cluster].dataType.simpleString()
    # one row per cluster, as the sums have for each row
    found = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("dims")).orderBy(cluster).collect()
    names = [r[cluster] for r in found if r[cluster] is not None]
    n, dims, clusters = sum(r["n"] for r in found), max((r["dims"] or 0 for r in found), default=0), len(names)
    table = lambda name: F.broadcast(df.sparkSession.createDataFrame(list(enumerate(names)), f"__code int, {name} {kind}"))
    rows = df.select(*key, F.col(cluster).alias("__lc"), vec).join(table("__lc"), "__lc", "left") \
        .withColumn("__code", F.coalesce("__code", F.lit(-1)))
    ddl, width = _ddl(rows, [*key, "__lc"]), min(WIDTH, max(1, clusters))
    parts = [f"__s{i}" for i in range(width)]
    schema = f"{ddl}, __j int, " + ", ".join(f"{c} double" for c in parts)
    if dims == 1:
        sums = _line_sums(rows, key, clusters, n, vec, ddl, schema)
    else:
        if block_rows <= 0 and clusters:
            block_rows = min(max(MIN_BLOCK_ROWS, BLOCK_SUMS // clusters), -(-n // _n_blocks(n, 0)))
        # by key and vector: rows of one key need not be in one block
        sums = own_pair_blocks(rows, [*key, vec], _n_blocks(n, block_rows), _cluster_sum_kernel(key, clusters, vec), schema)
    sums = sums.groupBy(*key, "__lc", "__j").agg(*[F.sum(c).alias(c) for c in parts])
    return sums.select(*key, "__lc", (F.col("__j") * width).alias("__first"), F.posexplode(F.array(*parts)).alias("__i", "__sd")) \
        .withColumn("__code", F.col("__first") + F.col("__i")).join(table("__rc"), "__code") \
        .select(*key, "__lc", "__rc", F.greatest("__sd", F.lit(0.0)).alias("__sd"))


def silhouette_per_row(df: DataFrame, key: Sequence[str], cluster: str, vec: str = "vec") -> DataFrame:
    """(key..., s) with s = (b - a) / max(a, b); 0 for a singleton cluster."""
    key = list(key)
    sizes = df.groupBy(F.col(cluster).alias("__rc")).agg(F.count(F.lit(1)).alias("__n"))
    sums = cluster_distance_sums(df, key, cluster, vec).join(F.broadcast(sizes), "__rc")
    own = F.col("__lc") == F.col("__rc")
    per = sums.groupBy(*key).agg(
        F.max(F.when(own, F.col("__n"))).alias("__own_n"),
        F.max(F.when(own & (F.col("__n") > 1), F.col("__sd") / (F.col("__n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("__sd") / F.col("__n"))).alias("b"))
    s = F.when((F.col("__own_n") <= 1) | F.col("b").isNull(), F.lit(0.0)).otherwise(
        F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return per.select(*key, s.alias("s"))


def silhouette(df: DataFrame, key: Sequence[str], cluster: str, vec: str = "vec", mode: str = "exact") -> DataFrame:
    """Mean silhouette as a one-row table ``(silhouette)``."""
    if mode == "squared":
        va = df.select(F.col(cluster).cast("double").alias("prediction"),
                       F.col(vec).alias("__v"))
        from pyspark.ml.functions import array_to_vector
        data = va.select("prediction", array_to_vector("__v").alias("features"))
        val = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(data)
        return df.sparkSession.createDataFrame([(float(val),)], "silhouette double")
    return silhouette_per_row(df, key, cluster, vec).agg(F.avg("s").alias("silhouette"))


# ---------------------------------------------------------------- KMeans

def kmeans_assign(df: DataFrame, features: Sequence[str], k: int, seed: int = 42,
                  out: str = "cluster", max_iter: int = 20) -> DataFrame:
    """R8 helper: KMeans fit + assignment; clusters renumbered by size (0 = largest)."""
    va = VectorAssembler(inputCols=list(features), outputCol="__fv")
    data = va.transform(df)
    model = KMeans(k=k, seed=seed, featuresCol="__fv", predictionCol="__p", maxIter=max_iter).fit(data)
    pred = model.transform(data).drop("__fv")
    sizes = pred.groupBy("__p").agg(F.count(F.lit(1)).alias("__size"))
    # at most k rows: rank clusters by size, ties by cluster id
    order = sizes.withColumn(out, (F.row_number().over(Window.orderBy(F.col("__size").desc(), "__p")) - 1)
                             .cast("int"))
    return pred.join(F.broadcast(order.select("__p", out)), "__p").drop("__p")


def by_size(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters renumbered by size (0 = largest; ties by their old number)."""
    sizes = assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("__size"))
    # at most k rows
    order = sizes.withColumn("__new", (F.row_number().over(Window.orderBy(F.col("__size").desc(), cluster)) - 1)
                             .cast("int")).select(cluster, "__new")
    return assigned.join(order, cluster).drop(cluster).withColumnRenamed("__new", cluster)


def medoid_assign(df: DataFrame, features: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Clusters of :func:`medoids`, renumbered by size; rows are told apart by a written number."""
    numbered = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))
    return by_size(medoids(numbered, ["__row"], features, k)[0]).drop("__row")


#: Cluster functions (rows, features, k, seed) -> rows with ``cluster``, 0 the largest.
METHODS: dict[str, Callable] = {"kmeans": kmeans_assign, "medoids": medoid_assign}
PICKS = ("highest", "lowest", "mean", "median")


def cluster_sizes(df: DataFrame, features: Sequence[str], k: int, seed: int = 42,
                  method: str | Callable = "kmeans") -> DataFrame:
    """(cluster, size), cluster 0 the largest."""
    assign = METHODS[method] if isinstance(method, str) else method
    return assign(df, features, k, seed).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def under_cluster_guided(df: DataFrame, key: Sequence[str], features: Sequence[str], label: str = "label",
                         k: int = 2, pick: str = "highest", seed: int = 42,
                         method: str | Callable = "kmeans") -> tuple[DataFrame, DataFrame]:
    """Cluster minority and majority into k each; score every (minority cluster,
    majority cluster) pair by the silhouette of its union with the class as label;
    keep all minority rows plus the majority cluster of the picked pair.

    ``pick``: one of ``PICKS`` (highest or lowest silhouette, or the one closest
    to their mean or median).  ``method``: a name of ``METHODS`` or a function
    (rows, features, k, seed) -> rows with a column ``cluster``.

    Returns (sampled rows, pair scores (pair, min_cluster, maj_cluster, silhouette)).
    All k x k silhouettes come from one distance-sum pass over all rows.
    """
    if pick not in PICKS:
        raise ValueError(f"unknown pick {pick!r}")
    key = list(key)
    assign = METHODS[method] if isinstance(method, str) else method
    maj, n_maj, mino, n_min = roles(df, label)
    parts = []
    for lab, role in ((mino, "min"), (maj, "maj")):
        part = assign(df.where(F.col(label) == lab), features, k, seed)
        parts.append(part.withColumn("__role", F.lit(role)))
    tagged = cut_lineage(parts[0].unionByName(parts[1]))  # the pairs are scored and picked from the same fit
    tagged = tagged.withColumn("__grp", F.col("cluster") + F.when(F.col("__role") == "min", 0).otherwise(k)) \
        .withColumn("__vec", F.array(*[F.col(f).cast("double") for f in features]))
    sums = cut_lineage(cluster_distance_sums(tagged, key, "__grp", "__vec"))  # read as own and as other cluster's
    sizes = tagged.groupBy(F.col("__grp").alias("__rc")).agg(F.count(F.lit(1)).alias("__n"))
    s = sums.join(F.broadcast(sizes), "__rc")
    own = s.where(F.col("__lc") == F.col("__rc")).select(
        *key, "__lc", F.when(F.col("__n") > 1, F.col("__sd") / (F.col("__n") - 1)).alias("a"),
        F.col("__n").alias("__own_n"))
    other = s.where((F.col("__lc") < k) != (F.col("__rc") < k)).select(
        *key, "__rc", (F.col("__sd") / F.col("__n")).alias("b"))
    j = own.join(other, key)
    sil = F.when(F.col("__own_n") <= 1, F.lit(0.0)).otherwise(
        F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    min_c, maj_c = F.least("__lc", "__rc"), F.greatest("__lc", "__rc") - k
    scores = j.select(min_c.alias("min_cluster"), maj_c.alias("maj_cluster"), sil.alias("s")) \
        .groupBy("min_cluster", "maj_cluster").agg(F.avg("s").alias("silhouette")) \
        .withColumn("pair", F.col("min_cluster") * k + F.col("maj_cluster"))
    from riskframe.operators.evaluate import argmax_first, closest_to_center
    if pick in ("highest", "lowest"):
        best = argmax_first(scores, "silhouette", "pair", highest=(pick == "highest"))
    else:
        best = closest_to_center(scores, "silhouette", "pair", "median" if pick == "median" else "mean")
    chosen = best.select(F.col("maj_cluster").alias("cluster"))
    keep_maj = tagged.where(F.col("__role") == "maj").join(F.broadcast(chosen), "cluster", "left_semi")
    out = tagged.where(F.col("__role") == "min").unionByName(keep_maj).drop("__role", "__grp", "__vec")
    return out, scores


def centroids(df: DataFrame, features: Sequence[str], k: int, seed: int = 42, max_iter: int = 10,
              tol: float = 1e-3) -> DataFrame:
    """k-means whose centres are a table (cid, features...), exactly ``k`` rows whatever ``k`` is.

    Equal rows are one point with a weight.  The first centres are the first k
    points in hash order; a round joins every point to its nearest centre (metric
    cells), averages per centre by ``groupBy`` and writes the new centres; it is
    the last when the cost falls by less than ``tol``.  A centre that no point is
    nearest to stays where it is.  With fewer points than ``k`` every point is a
    centre, and they repeat in order.
    """
    feats = list(features)
    vec = F.array(*feats)
    points = cut_lineage(df.groupBy(*[F.col(f).cast("double").alias(f) for f in feats])
                         .agg(F.count(F.lit(1)).alias("__w")).withColumn("__v", vec))
    n = points.count()
    ranked = exact_rank(points, feats, [], seed, "centre", rank_col="__r")
    if n <= k:
        copies = F.floor((F.lit(k) - F.col("__r")) / F.lit(max(n, 1))) + 1
        return ranked.withColumn("__c", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(
            (F.col("__r") - 1 + (F.col("__c") - 1) * n).alias("cid"), *feats)
    centres, before = cut_lineage(ranked.where(F.col("__r") <= k).select((F.col("__r") - 1).alias("cid"), *feats)), None
    for _ in range(max_iter):
        near = knn_join(points, centres.withColumn("__v", vec), 1, [*feats, "__w"], ["cid"], "__v")
        means = cut_lineage(near.groupBy(F.col("nn_cid").alias("cid")).agg(
            *[(F.sum(F.col(f) * F.col("__w")) / F.sum("__w")).alias(f"__{f}") for f in feats],
            F.sum(F.col("dist") * F.col("dist") * F.col("__w")).alias("__cost")))
        cost = means.agg(F.sum("__cost")).first()[0]
        centres = cut_lineage(centres.join(means, "cid", "left").select(
            "cid", *[F.coalesce(f"__{f}", f).alias(f) for f in feats]))
        if before is not None and before - cost <= tol * before:
            break
        before = cost
    return centres


def under_centroids(df: DataFrame, features: Sequence[str], label: str = "label", seed: int = 42,
                    max_iter: int = 10) -> DataFrame:
    """Majority replaced by exactly n_minority :func:`centroids`; minority kept.

    Returns (label, features...).  One algorithm at any size; the centres are
    never in one place.  A NULL or NaN feature is an error: impute before
    clustering.
    """
    maj, n_maj, mino, n_min = roles(df, label)
    feats = list(features)
    minority = df.where(F.col(label) == mino).select(label, *feats)
    majority = df.where(F.col(label) == maj)
    if n_min >= n_maj or n_min == 0:
        return minority.unionByName(majority.select(label, *feats))
    whole = majority.select(*[F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")), F.raise_error(
        F.lit(f"under_centroids: NULL or NaN in {f}")).cast("double")).otherwise(F.col(f).cast("double")).alias(f)
        for f in feats])
    cent = centroids(whole, feats, n_min, seed, max_iter)
    kind = df.schema[label].dataType
    return minority.select(label, *[F.col(f).cast("double").alias(f) for f in feats]).unionByName(
        cent.select(F.lit(maj).cast(kind).alias(label), *feats))


# ---------------------------------------------------------------- medoids

#: Rows of a cell on average, for the bounds of medoid sums: cells are as many as the pivots may be from 32,768 rows on.
MEDOID_CELL_ROWS = 16


def _tiles(n: int, m: int, tall: int = 256, wide: int = 1024):
    """Slices of left and right rows whose distances stay in the processor's cache."""
    return ((slice(s, s + tall), slice(t, t + wide)) for t in range(0, m, wide) for s in range(0, n, tall))


def _sum_kernel(key, vec):
    """Distance sums of the right rows to a left block."""
    def fn(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame({**{k: [] for k in key}, "__g": []})
        Q, R = _matrix(lp, vec), _matrix(rp, vec)
        total = np.zeros(len(R))
        for s, t in _tiles(len(Q), len(R)):
            total[t] += distances(Q[s], R[t]).sum(axis=0)
        return pd.DataFrame({**{k: rp[k].to_numpy() for k in key}, "__g": total})
    return fn


def _swap_kernel(key, k: int, vec):
    """What each candidate (right row) gains as a further medoid (__g), and besides if medoid i goes (__b<i>)."""
    def fn(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        cols = ["__g", *(f"__b{i}" for i in range(k))]
        if lp.empty or rp.empty:
            return pd.DataFrame({c: [] for c in [*key, *cols]})
        Q, R = _matrix(lp, vec), _matrix(rp, vec)
        d1, d2, own = (lp[c].to_numpy() for c in ("__d1", "__d2", "__own"))
        out = np.zeros((1 + k, len(R)))
        for s, t in _tiles(len(Q), len(R)):
            D = distances(Q[s], R[t])
            near = np.minimum(D - d1[s, None], 0.0)
            out[0, t] += near.sum(axis=0)
            if k > 1:
                other = np.minimum(D - d2[s, None], 0.0) - near
                for i in range(k):
                    out[1 + i, t] += other[own[s] == i].sum(axis=0)
        return pd.DataFrame({**{c: rp[c].to_numpy() for c in key}, **{c: out[j] for j, c in enumerate(cols)}})
    return fn


def _stater(meds: np.ndarray, vec):
    """Nearest medoid of each row, and the distances to it and to the second nearest."""
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            D = distances(_matrix(pdf, vec), meds)
            own = D.argmin(axis=1)
            d1 = D[np.arange(len(D)), own]
            D[np.arange(len(D)), own] = np.inf
            d2 = D.min(axis=1) if D.shape[1] > 1 else np.full(len(D), np.inf)
            yield pdf.assign(__d1=d1, __d2=d2, __own=own.astype("int32"))
    return run


class _Spread:
    """Per cell (and nearest medoid) of rows: number, mean, mean square around it, ring around the pivot;
    sum, least and greatest distance to the nearest and second nearest medoid.  Bounded by pivots x medoids.

    Distance is convex and its square's mean known, so n |x - mean| <= sum of distances <= n sqrt(|x - mean|^2 + var).
    """

    def __init__(self, cells, rows: DataFrame, dims: int, vec: str, own: bool):
        limits = [f(c) for c in ("__d1", "__d2") for f in (F.sum, F.min, F.max)] if own else []
        found = rows.groupBy("__cell", *(["__own"] if own else [])).agg(
            F.count(F.lit(1)), F.avg(F.col("__pd") * F.col("__pd")), F.min("__pd"), F.max("__pd"),
            *[F.avg(F.col(vec)[j]) for j in range(dims)], *limits).collect()
        table = np.array([tuple(r) for r in found], dtype="float64")
        self.pivot = cells.pivots[table[:, 0].astype(int)]
        self.own, table = table[:, 1].astype(int), table[:, 1 + own:]
        self.n, square, self.low, self.high = table[:, :4].T
        self.mean = np.ascontiguousarray(table[:, 4:4 + dims])
        self.limits = table[:, 4 + dims:].T.reshape(-1, 3, len(table))
        off = self.mean - self.pivot
        self.var = np.maximum(square - (off * off).sum(axis=1), 0) + 1e-9 * square

    def sums(self, Q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest sum of each group's distances to each row of ``Q``."""
        D = distances(Q, self.mean)
        return self.n * D, self.n * np.sqrt(D * D + self.var)

    def total(self, Q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest sum of all distances."""
        low, high = (x.sum(axis=1) for x in self.sums(Q))
        return low * (1 - 1e-9), high * (1 + 1e-9)

    def gains(self, Q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest gain (row, i) of each row of ``Q`` in place of medoid i; i = k: as a further one."""
        low, high = self.sums(Q)
        P = distances(Q, self.pivot)
        near, far = np.maximum(np.maximum(P - self.high, self.low - P), 0), P + self.high
        out = np.zeros((2, len(Q), k + 1))
        for j, (total, least, most) in enumerate(self.limits if k > 1 else self.limits[:1]):
            every, none = far * (1 + 1e-9) <= least, near * (1 - 1e-9) >= most
            under = np.maximum(self.n * np.minimum(near - most, 0), low - total - self.n * np.maximum(far - least, 0))
            slack = 1e-10 * (high + total)
            under = np.where(every, low - total, np.where(none, 0.0, under)) - slack
            over = np.where(every, high - total, np.where(none, 0.0, np.minimum(high - total, 0))) + slack
            for i in range(k + 1):
                use = (self.own == i) if j else (self.own != i)
                out[0, :, i] += under[:, use].sum(axis=1)
                out[1, :, i] += over[:, use].sum(axis=1)
        return out[0], out[1]


def _bounder(spread, vec, bounds: Callable, chunk: int = 128):
    """Rows with the least and greatest value (__lo, __hi) that ``bounds`` finds for them."""
    def run(batches):
        for pdf in batches:
            Q = _matrix(pdf, vec) if len(pdf) else np.zeros((0, 1))
            found = [bounds(spread.value, Q[s:s + chunk]) for s in range(0, len(Q), chunk)]
            if found:
                yield pdf.assign(__lo=np.concatenate([x[0] for x in found]), __hi=np.concatenate([x[1] for x in found]))
    return run


def medoids(df: DataFrame, key: Sequence[str], features: Sequence[str], k: int, max_swaps: int = 100,
            rows_per_cell: int = MEDOID_CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """K-medoids by PAM over all rows, no sample.

    Build: the row with the least sum of distances, then k - 1 times the row that
    lowers the cost most.  Swap: the best exchange of a medoid for any row, as
    long as it lowers the cost.  Each step first bounds what every row would give,
    from the means and spreads of metric cells (at most pivots x medoids of them);
    only rows whose bounds reach the best are then weighed against all rows, pair
    by pair, so the choice is exact.  Work is rows x cells, and all pairs only
    where cells say nothing (many dimensions, no clusters).  Ties go to the
    smaller key.  Medoids (k rows, a parameter) and the cells' table are all that
    the driver holds.

    Returns (rows with ``cluster``, medoids (cluster, key..., features...)).
    """
    key, feats = list(key), list(features)
    if df.count() < k:
        raise ValueError(f"{k} medoids need at least {k} rows; there are {df.count()}")
    vec = "__v"
    points = df.select(*key, F.array(*[F.col(f).cast("double") for f in feats]).alias(vec))
    cells, placed = _in_cells(points, key, vec, (), rows_per_cell)
    share = df.sparkSession.sparkContext.broadcast
    n = int(cells.n.sum())
    ddl = _ddl(placed, key)
    fields = f"{ddl}, {_ddl(placed, [vec])}, __cell int, __pd double"

    def once(rows: DataFrame) -> DataFrame:
        """A row a key: candidates are weighed by key, and a repeated one counts once."""
        return rows.groupBy(*key).agg(F.min(vec).alias(vec))

    def take(rows: DataFrame) -> tuple:
        """A medoid: its row and its vector (the least one if rows share the key)."""
        found = once(rows.select(*key).join(placed, key)).first()
        return found, np.array(found[vec], dtype="float64")

    def hopeful(rows: DataFrame, spread: _Spread, bounds: Callable, but: list) -> DataFrame:
        """The rows (key, vector) whose least value is not above the least greatest value."""
        bounded = rows.select(*key, vec).mapInPandas(_bounder(share(spread), vec, bounds),
                                                     f"{ddl}, {_ddl(placed, [vec])}, __lo double, __hi double")
        if but:
            bounded = bounded.where(~reduce(lambda a, b: a | b, [
                reduce(lambda a, b: a & b, [F.col(c) == F.lit(m[0][c]) for c in key]) for m in but]))
        bounded = cut_lineage(bounded)
        least = bounded.agg(F.min("__hi")).first()[0]
        return once(bounded.where(F.col("__lo") <= F.lit(least)))

    def near(meds: list) -> tuple[DataFrame, _Spread]:
        """Rows with their state (written), and its spread over the cells."""
        at = np.stack([v for _, v in meds])
        state = cut_lineage(placed.mapInPandas(_stater(at, vec), f"{fields}, __d1 double, __d2 double, __own int"))
        return state, _Spread(cells, state, len(feats), vec, True)

    def weigh(state: DataFrame, candidates: DataFrame, m: int) -> DataFrame:
        """The gains of the candidates."""
        own = ", ".join(f"__b{i} double" for i in range(m))
        gains = pairwise_blocks(state.select(*key, vec, "__d1", "__d2", "__own"), candidates, key, key,
                                _swap_kernel(key, m, vec), f"{ddl}, __g double, {own}")
        return gains.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("__g", *(f"__b{i}" for i in range(m)))])

    first = hopeful(placed, _Spread(cells, placed, len(feats), vec, False), _Spread.total, [])
    best = pairwise_blocks(placed.select(*key, vec), first, key, key, _sum_kernel(key, vec), f"{ddl}, __g double") \
        .groupBy(*key).agg(F.sum("__g").alias("__g")).agg(F.min(F.struct("__g", *key)).alias("b")).select("b.*")
    meds = [take(best)]
    while len(meds) < k:
        m = len(meds)
        state, spread = near(meds)
        candidates = hopeful(state, spread, lambda s, Q, m=m: [x[:, m] for x in s.gains(Q, m)], meds)
        meds.append(take(weigh(state, candidates, m).agg(F.min(F.struct("__g", *key)).alias("b")).select("b.*")))
    for _ in range(max_swaps if 1 < k < n else 0):
        state, spread = near(meds)
        whole = state.groupBy("__own").agg(F.sum(F.col("__d2") - F.col("__d1")).alias("lost"),
                                           F.sum("__d1").alias("cost")).collect()  # k rows
        cost = sum(r["cost"] for r in whole)
        lost = {r["__own"]: r["lost"] for r in whole}
        loss = np.array([lost.get(i, 0.0) for i in range(k)])
        candidates = hopeful(state, spread, lambda s, Q, loss=loss: [
            (x[:, :-1] + loss).min(axis=1) + sign * 1e-9 * cost for x, sign in zip(s.gains(Q, k), (-1, 1))], [])
        gains = weigh(state, candidates, k)
        options = F.array(*[F.struct((F.col("__g") + F.col(f"__b{i}") + F.lit(float(lost.get(i, 0.0)))).alias("d"),
                                     *key, F.lit(i).alias("i")) for i in range(k)])
        swap = gains.agg(F.min(F.array_min(options)).alias("b")).select("b.*").first()
        if swap["d"] >= -1e-9 * max(cost, 1e-300):
            break
        meds[swap["i"]] = take(df.sparkSession.createDataFrame([tuple(swap[c] for c in key)], ddl))
    x = [F.col(f).cast("double") for f in feats]
    d = [F.sqrt(reduce(lambda a, b: a + b, [(xi - F.lit(float(mi))) * (xi - F.lit(float(mi))) for xi, mi in zip(x, v)]))
         for _, v in meds]
    near = F.least(*d) if k > 1 else d[0]
    cluster = reduce(lambda acc, ci: acc.when(d[ci] == near, F.lit(ci)), range(1, k), F.when(d[0] == near, F.lit(0)))
    rows = [(c, *[m[0][f] for f in key], *[float(y) for y in m[1]]) for c, m in enumerate(meds)]
    schema = f"cluster int, {ddl}, " + ", ".join(f"`{f}` double" for f in feats)
    return df.withColumn("cluster", cluster.cast("int")), df.sparkSession.createDataFrame(rows, schema)
