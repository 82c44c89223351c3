"""Aligned matrices and graphs: common keys, edge look-ups, consistency, bandwidths by shared neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.operators.graph import shared_neighbours
from cellweave.operators.neighbors import nearest


def aligned(matrices: list[DataFrame]) -> list[DataFrame]:
    """JON22: expression tables cut to the cells and genes that all of them have."""
    out = matrices
    for key in ("cell", "gene"):
        common = reduce(lambda a, b: a.intersect(b), [m.select(key) for m in matrices])
        out = [m.join(common, key, "left_semi") for m in out]
    return out


def joined_by_position(left: DataFrame, right: DataFrame, key: str | list[str] = "spot_id") -> DataFrame:
    """JON16: rows of two tables that belong together by an explicit position (one column or several); ValueError if their
    counts differ."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows against {m}")
    return left.join(right, key)


def edge_weights(edges: DataFrame, graph: DataFrame) -> DataFrame:
    """JON19: edges (src, dst) with other_weight = max(w_ij, w_ji) of another graph, 0 where it has neither."""
    there = graph.select("src", "dst", F.col("weight").alias("w1"))
    back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("w2"))
    joined = edges.join(there, ["src", "dst"], "left").join(back, ["src", "dst"], "left")
    zero = F.lit(0.0)
    return joined.withColumn("other_weight", F.greatest(F.coalesce("w1", zero), F.coalesce("w2", zero))).drop("w1", "w2")


def inconsistent_cells(first: DataFrame, second: DataFrame) -> DataFrame:
    """GRF30: (cell, missing_in) of cells that only one of two graphs has; no rows if they agree."""
    nodes = [g.select(F.col("src").alias("cell")).union(g.select("dst")).distinct() for g in (first, second)]
    only = [nodes[i].join(nodes[1 - i], "cell", "left_anti").withColumn("missing_in", F.lit(name)) for i, name in ((0, "second"), (1, "first"))]
    return only[0].union(only[1])


def complete_graphs(cells: DataFrame, most: int = 150) -> DataFrame:
    """GRF26: (grp, a, b) of all pairs within groups (cell, grp) of at most `most` cells, which bounds the pairs of a cell."""
    small = cells.join(cells.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("grp"), "grp", "left_semi")
    return small.select("grp", F.col("cell").alias("a")).join(small.select("grp", F.col("cell").alias("b")), "grp").where("a < b")


def label_graph(cells: DataFrame, most: int = 150, k: int = 10) -> DataFrame:
    """GRF27: (grp, a, b, weight) within the groups of cells (cell, grp, v): a complete graph in groups of at most `most`
    cells, the k nearest neighbours of each cell in larger ones; weight is the number of directions, 1 or 2."""
    large = cells.join(cells.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("grp"), "grp", "left_semi")
    edges = nearest(large, k=k).join(cells.select(F.col("cell").alias("src"), "grp"), "src")
    both = edges.groupBy("grp", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("weight"))
    return complete_graphs(cells, most).select("grp", "a", "b", F.lit(2).cast("long").alias("weight")).union(both)


def jaccard_bandwidth(edges: DataFrame, n: int, largest: bool = True) -> DataFrame:
    """GRF02: (cell, sigma): the mean distance over the n neighbours with the largest (or smallest non-zero) Jaccard
    index of their neighbour lists, ties by dst. edges: (src, dst, distance)."""
    pairs = shared_neighbours(edges.select("src", "dst"), 1e-12)
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "jaccard").union(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "jaccard"))
    order = F.desc(F.round("jaccard", 9)) if largest else F.asc(F.round("jaccard", 9))
    ranked = edges.join(both, ["src", "dst"]).withColumn("k", F.row_number().over(W.partitionBy("src").orderBy(order, "dst")))
    return ranked.where(F.col("k") <= n).groupBy(F.col("src").alias("cell")).agg(F.avg("distance").alias("sigma"))


def stop_step(changes: DataFrame, threshold: float, nth: int = 2) -> DataFrame:
    """WIN12: (step): the nth step whose change lies below the threshold; no row if there are fewer. One row per step."""
    below = changes.where(F.col("change") < threshold).withColumn("k", F.row_number().over(W.orderBy("step")))
    return below.where(F.col("k") == nth).select("step")
