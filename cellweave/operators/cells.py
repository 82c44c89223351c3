"""Cells, reads and clusters: counts, summaries, purity, stitching of fields of view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def majority_labels(members: DataFrame, key: str, label: str) -> DataFrame:
    """AGG20, AGG21: (key, majority, purity, size): the most frequent label, the least on ties, over non-missing labels."""
    counts = members.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(label).alias("majority"))).alias("b"), F.sum("n").alias("labelled"))
    out = best.select(key, F.col("b.majority").alias("majority"), (-F.col("b.k") / F.col("labelled")).alias("purity"))
    return sizes.join(out, key, "left")


def weighted_median(df: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """AGG18: the least value at which the running weight reaches half of the total."""
    w = W.partitionBy(*keys)
    per_value = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    running = per_value.withColumn("_run", F.sum("_w").over(w.orderBy(value))).withColumn("_all", F.sum("_w").over(w))
    return running.where("_run >= _all / 2").groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def adjusted_rand_index(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """AGG29: one row (ari) for two labellings of the same rows."""
    pair = lambda n: n * (n - 1) / 2
    table = pairs.groupBy(first, second).agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = table.agg(F.sum(pair(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    side = lambda c, out: table.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pair(F.col("n"))).alias(out))
    joined = both.join(side(first, "a")).join(side(second, "b"))  # one row each
    expected = F.col("a") * F.col("b") / pair(F.col("total"))
    return joined.select(F.try_divide(F.col("both") - expected, (F.col("a") + F.col("b")) / 2 - expected).alias("ari"))


def stitched_ids(cells: DataFrame, fov: str = "fov", cell: str = "cell") -> DataFrame:
    """WIN09: global ids: each field of view starts behind the largest id of those before it; -1 (no cell) stays.

    The prefix sum runs over one row per field of view.
    """
    spans = cells.groupBy(fov).agg(F.coalesce(F.max(F.when(F.col(cell) >= 0, F.col(cell))) + 1, F.lit(0)).alias("_span"))
    before = W.orderBy(fov).rowsBetween(W.unboundedPreceding, -1)
    starts = spans.select(fov, F.coalesce(F.sum("_span").over(before), F.lit(0)).alias("_offset"))
    joined = cells.join(starts, fov)
    return joined.withColumn("global_id", F.when(F.col(cell) >= 0, F.col(cell) + F.col("_offset")).otherwise(F.lit(-1))).drop("_offset")


def nearest_owner(points: DataFrame, centres: DataFrame, pitch: float) -> DataFrame:
    """JON13: points (fov, x, y) that lie nearest to their own field's centre (fov, cx, cy) on a grid of `pitch`; the
    least fov wins ties.

    A point can only be nearer to a centre that lies within 1.5 pitches of it, so it is compared with the centres of its
    own and the eight adjoining grid bins by an equi-join on the bin.
    """
    bin_of = lambda c: F.floor(c / pitch)
    around = F.array(*[F.struct((bin_of(F.col("cx")) + i).alias("bx"), (bin_of(F.col("cy")) + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = centres.select(F.col("fov").alias("near_fov"), "cx", "cy", F.explode(around).alias("b")).select("near_fov", "cx", "cy", "b.*")
    placed = points.withColumn("bx", bin_of(F.col("x"))).withColumn("by", bin_of(F.col("y")))
    keys = [c for c in points.columns]
    d = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))
    best = placed.join(near, ["bx", "by"]).groupBy(*keys).agg(F.min(F.struct(d.alias("d"), F.col("near_fov"))).alias("best"))
    return best.where(F.col("best.near_fov") == F.col("fov")).select(*keys)


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """WIN08: the first row of each key in the given order, which must be total."""
    ranked = df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")
