"""Cells seen by several modalities: how far each is to be trusted, and neighbours by all of them. Embeddings are (cell, v)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.functions.numeric import euclidean
from cellweave.operators.graph import shared_neighbours
from cellweave.operators.neighbors import nearest, nearest_by_vectors
from cellweave.sources.shared import materialised

MOST_SCORE = 200.0


def unit_vectors(points: DataFrame) -> DataFrame:
    """(cell, v) with vectors of length 1; a vector of zeros stays."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return points.withColumn("length", length).select("cell", F.when(F.col("length") > 0, F.transform("v", lambda x: x / F.col("length"))).otherwise(F.col("v")).alias("v"))


def neighbour_means(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(cell, mean): the mean vector of each source's neighbours. edges: (src, dst), a bounded number of each source."""
    rows = edges.select("src", "dst").join(points.select(F.col("cell").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("cell")).agg(F.collect_list("v").alias("vs"))
    total = F.aggregate(F.slice("vs", 2, F.size("vs")), F.col("vs")[0], lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return rows.select("cell", F.transform(total, lambda x: x / F.size("vs")).alias("mean"))


def _prediction_errors(units: dict[str, DataFrame], lists: dict[str, DataFrame]) -> DataFrame:
    """(cell, target, source, error): distance of a cell's vector in `target` from the mean of its neighbours in `source`."""
    parts = []
    for target, points in units.items():
        for source, edges in lists.items():
            joined = points.join(neighbour_means(edges, points), "cell")
            parts.append(joined.select("cell", F.lit(target).alias("target"), F.lit(source).alias("source"), euclidean(F.col("v"), F.col("mean")).alias("error")))
    return reduce(DataFrame.union, parts)


def _softmax(score: Column, by: str) -> Column:
    w = W.partitionBy(by)
    return F.exp(score - F.max(score).over(w)) / F.sum(F.exp(score - F.max(score).over(w))).over(w)


def reliability_weights(embeddings: dict[str, DataFrame], k: int = 30, temperature: float = 1.0) -> DataFrame:
    """GRF23: (cell, modality, weight): how well a modality's own neighbours predict it, among all modalities' neighbours.

    Vectors are scaled to length 1. The error of predicting a modality by the mean over k neighbours in each modality turns
    into exp(-error / temperature), its own share of their sum is the score, and scores go through a softmax by cell.
    """
    units = {m: materialised(unit_vectors(p)) for m, p in embeddings.items()}
    errors = _prediction_errors(units, {m: nearest(p, k=k).select("src", "dst") for m, p in units.items()})
    affinity = F.exp(-F.col("error") / temperature)
    scores = errors.groupBy("cell", "target").agg((F.sum(F.when(F.col("source") == F.col("target"), affinity)) / F.sum(affinity)).alias("score"))
    return scores.select("cell", F.col("target").alias("modality"), _softmax(F.col("score"), "cell").alias("weight"))


def far_bandwidths(edges: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """GRF02: (cell, sigma): mean distance to the n cells of smallest positive Jaccard index of neighbour lists that include
    the cell itself, ties by cell. edges: (src, dst)."""
    lists = edges.select("src", "dst").union(points.select("cell", F.col("cell").alias("dst")))
    pairs = shared_neighbours(lists, 1e-12)
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "jaccard").union(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "jaccard"))
    far = both.withColumn("k", F.row_number().over(W.partitionBy("src").orderBy(F.round("jaccard", 9), "dst"))).where(F.col("k") <= n)
    return nearest_by_vectors(far.select("src", "dst"), points).groupBy(F.col("src").alias("cell")).agg(F.avg("distance").alias("sigma"))


def _kernel(distance: Column, first: Column, sigma: Column) -> Column:
    """exp(-max(d - first, 0) / (sigma - first)); where sigma does not exceed first, 1 up to first and 0 beyond."""
    over = F.greatest(distance - first, F.lit(0.0))
    return F.when(sigma > first, F.exp(-over / (sigma - first))).otherwise(F.when(over > 0, 0.0).otherwise(1.0))


def _scales(units: dict[str, DataFrame], k: int, n_far: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Neighbour lists (src, dst, distance, rank) of each modality, and (cell, modality, first, sigma)."""
    lists = {m: materialised(nearest(p, k=k).select("src", "dst", "distance", "rank")) for m, p in units.items()}
    parts = []
    for m, edges in lists.items():
        first = edges.where("rank = 1").select(F.col("src").alias("cell"), F.col("distance").alias("first"))
        parts.append(first.join(far_bandwidths(edges, units[m], n_far), "cell").select("cell", F.lit(m).alias("modality"), "first", "sigma"))
    return lists, materialised(reduce(DataFrame.union, parts))


def _weights(units: dict[str, DataFrame], lists: dict[str, DataFrame], scales: DataFrame, floor: float) -> DataFrame:
    errors = _prediction_errors(units, lists).join(scales.withColumnRenamed("modality", "target"), ["cell", "target"])
    errors = errors.withColumn("affinity", _kernel(F.col("error"), F.col("first"), F.col("sigma")))
    own = F.col("source") == F.col("target")
    scores = errors.groupBy("cell", "target").agg(F.sum(F.when(own, F.col("affinity"))).alias("own"), F.avg(F.when(~own, F.col("affinity"))).alias("cross"))
    score = F.least(F.col("own") / (F.col("cross") + floor), F.lit(MOST_SCORE))
    return scores.select("cell", F.col("target").alias("modality"), _softmax(score, "cell").alias("weight"))


def modality_weights(embeddings: dict[str, DataFrame], k: int = 20, n_far: int = 20, floor: float = 1e-4) -> DataFrame:
    """MDL10: (cell, modality, weight) of weighted nearest neighbours (Hao et al., 2021), two modalities or more.

    Vectors are scaled to length 1. Within-modality affinity is the kernel of the distance between a cell and the mean of its
    k neighbours in that modality, cross-modality affinity that of the mean of its neighbours in the others (their average
    where there are several); the kernel starts at the nearest neighbour's distance and has the bandwidth of far_bandwidths().
    The score, within / (cross + floor) and at most 200, goes through a softmax over the cell's modalities.
    """
    if len(embeddings) < 2:
        raise ValueError("weights need two modalities at least")
    units = {m: materialised(unit_vectors(p)) for m, p in embeddings.items()}
    lists, scales = _scales(units, k, n_far)
    return _weights(units, lists, scales, floor)


def weighted_neighbours(embeddings: dict[str, DataFrame], k: int = 20, knn_range: int = 200, n_far: int = 20, floor: float = 1e-4, grow: bool = False) -> DataFrame:
    """MDL10: (src, dst, affinity, distance, rank): the k neighbours of largest joint affinity, the sum over modalities of
    weight times kernel; distance is sqrt((1 - affinity) / 2). Ties go by dst.

    Candidates are the knn_range nearest in any modality, fewer where there are fewer cells. With grow the range doubles for
    the cells for which a cell outside all ranges could still have a larger affinity than the k-th found, so that the result
    is exact. Up to three cells are all neighbours of each other with affinity 1.
    """
    if len(embeddings) < 2:
        raise ValueError("neighbours need two modalities at least")
    units = {m: materialised(unit_vectors(p)) for m, p in embeddings.items()}
    cells = next(iter(units.values())).select("cell")
    n = cells.count()
    if n <= 3:
        one = cells.select(F.col("cell").alias("src")).join(cells.select(F.col("cell").alias("dst")), F.col("src") != F.col("dst"))
        return one.select("src", "dst", F.lit(1.0).alias("affinity"), F.lit(0.0).alias("distance"), F.row_number().over(W.partitionBy("src").orderBy("dst")).alias("rank"))
    k, reach = min(k, n - 1), min(knn_range, n - 1)
    lists, scales = _scales(units, k, n_far)
    scales = materialised(scales.join(_weights(units, lists, scales, floor), ["cell", "modality"]))
    asked, done = None, None
    while True:
        near = {}
        for m, p in units.items():
            if asked is None:
                near[m] = nearest(p, k=reach)
            else:  # one more, since a point that asks by itself is its own neighbour
                near[m] = nearest(p, p.join(asked, "cell", "left_semi"), k=reach + 1).where("src <> dst").withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy("distance", "dst")))
            near[m] = materialised(near[m].select("src", "dst", "distance", "rank"))
        pairs = reduce(DataFrame.union, [e.select("src", "dst") for e in near.values()]).distinct()
        parts = [nearest_by_vectors(pairs, units[m]).select("src", "dst", F.lit(m).alias("modality"), "distance") for m in units]
        own = scales.withColumnRenamed("cell", "src")
        kernel = F.col("weight") * _kernel(F.col("distance"), F.col("first"), F.col("sigma"))
        joint = reduce(DataFrame.union, parts).join(own, ["src", "modality"]).groupBy("src", "dst").agg(F.sum(kernel).alias("affinity"))
        best = joint.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.desc(F.round("affinity", 12)), "dst"))).where(F.col("rank") <= k)
        best = materialised(best.select("src", "dst", "affinity", F.sqrt(F.greatest((1 - F.col("affinity")) / 2, F.lit(0.0))).alias("distance"), "rank"))
        if not grow or reach >= n - 1:
            return best if done is None else done.union(best)
        edge = reduce(DataFrame.union, [e.where(F.col("rank") == reach).select("src", F.lit(m).alias("modality"), "distance") for m, e in near.items()])
        bound = edge.join(own, ["src", "modality"]).groupBy("src").agg(F.sum(kernel).alias("bound"))
        short = best.where(F.col("rank") == k).join(bound, "src").where(F.col("affinity") <= F.col("bound")).select(F.col("src").alias("cell"))
        asked = materialised(short)
        settled = best.join(asked.select(F.col("cell").alias("src")), "src", "left_anti")
        done = settled if done is None else done.union(settled)
        if asked.isEmpty():
            return done
        reach = min(2 * reach, n - 1)
