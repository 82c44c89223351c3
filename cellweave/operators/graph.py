"""Weighted graphs as edge lists (src, dst, weight): kernels, symmetry, transitions, diffusion, energies, attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def symmetrised(edges: DataFrame, how: str = "max") -> DataFrame:
    """SET05, GRF01: w_ij and w_ji become their maximum, or their mean with an absent edge as 0; self loops go."""
    pairs = both_ways(edges.where("src <> dst")).groupBy("src", "dst")
    value = {"max": F.max("weight"), "mean": F.sum("weight") / 2, "sum": F.sum("weight")}
    if how not in value:
        raise ValueError(f"how is one of {sorted(value)}")
    return pairs.agg(value[how].alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """AGG24, SRT09: parallel edges summed over (least, greatest)."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def strongest(edges: DataFrame, k: int) -> DataFrame:
    """WIN04: the k heaviest edges of each source, ties by dst."""
    ranked = edges.withColumn("_k", F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst")))
    return ranked.where(F.col("_k") <= k).drop("_k")


def row_normalised(edges: DataFrame) -> DataFrame:
    """WIN05: weights of each source sum to 1."""
    return edges.withColumn("weight", F.try_divide("weight", F.sum("weight").over(W.partitionBy("src"))))


def with_diagonal(edges: DataFrame, value: Column | None = None) -> DataFrame:
    """GRF25: (i, i) with weight 1, or `value` aggregated over a source's edges, for every node."""
    nodes = both_ways(edges).groupBy("src").agg((F.lit(1.0) if value is None else value).alias("weight"))
    return edges.select("src", "dst", "weight").union(nodes.select("src", F.col("src").alias("dst"), "weight"))


def transition(edges: DataFrame, k: int) -> DataFrame:
    """GRF12: symmetrise by maximum, keep the k heaviest, A + A^T, diagonal = the row's maximum, normalise rows."""
    kept = strongest(symmetrised(edges), k)
    summed = both_ways(kept).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return row_normalised(with_diagonal(summed, F.max("weight")))


def gaussian(edges: DataFrame, sigma: DataFrame, floor: float = 1e-8) -> DataFrame:
    """NUM11: edges (src, dst, distance) weighted by exp(-d^2 / (s_i s_j)); sigma: (cell, sigma)."""
    own = sigma.select("cell", F.greatest("sigma", F.lit(floor)).alias("sigma"))
    joined = edges.join(own.select(F.col("cell").alias("src"), F.col("sigma").alias("s1")), "src").join(own.select(F.col("cell").alias("dst"), F.col("sigma").alias("s2")), "dst")
    return joined.select("src", "dst", F.exp(-F.col("distance") * F.col("distance") / (F.col("s1") * F.col("s2"))).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """AGG32: (cell, degree, strength)."""
    return edges.groupBy(F.col("src").alias("cell")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def smoothed(edges: DataFrame, values: DataFrame, alpha: float) -> DataFrame:
    """GRF09: alpha x + (1 - alpha) D^-1 W x over (cell, gene, value); alpha = 0 means neighbours only; degree 0 counts as 1."""
    degree = edges.groupBy("src").agg(F.sum("weight").alias("degree"))
    mean = edges.join(values.withColumnRenamed("cell", "dst"), "dst").groupBy("src", "gene").agg(F.sum(F.col("weight") * F.col("value")).alias("s"))
    mean = mean.join(degree, "src").select(F.col("src").alias("cell"), "gene", ((1 - alpha) * F.col("s") / F.when(F.col("degree") == 0, 1.0).otherwise(F.col("degree"))).alias("value"))
    return values.select("cell", "gene", (alpha * F.col("value")).alias("value")).union(mean).groupBy("cell", "gene").agg(F.sum("value").alias("value"))


def diffused(transitions: DataFrame, values: DataFrame, steps: int) -> DataFrame:
    """GRF14: M^t x over (cell, gene, value), one join and one aggregate a step; M^t itself is never made."""
    moves = transitions.select("src", "dst", "weight")
    for _ in range(steps):
        values = moves.join(values.withColumnRenamed("cell", "dst"), "dst").groupBy(F.col("src").alias("cell"), "gene").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    return values


def dirichlet_energy(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """GRF19, GRF20: (cell, energy) = half of sum w |z_i - z_j|^2 over the degree; vectors: (cell, v)."""
    ends = [vectors.select(F.col("cell").alias(c), F.col("v").alias(f"v_{c}")) for c in ("src", "dst")]
    gap = F.aggregate(F.zip_with("v_src", "v_dst", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    joined = edges.join(ends[0], "src").join(ends[1], "dst")
    return joined.groupBy(F.col("src").alias("cell")).agg(F.try_divide(0.5 * F.sum(F.col("weight") * gap), F.sum("weight")).alias("energy"))


def laplacian(edges: DataFrame, kind: str = "symmetric") -> DataFrame:
    """LIN06, LIN07: I - D^-1/2 W D^-1/2 ("symmetric") or I - D^-1 W ("random_walk") as an edge list with diagonal."""
    degree = edges.groupBy("src").agg(F.sum("weight").alias("d"))
    joined = edges.join(degree.withColumnRenamed("d", "d1"), "src")
    if kind == "symmetric":
        joined = joined.join(degree.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
        value = -F.col("weight") / F.sqrt(F.col("d1") * F.col("d2"))
    elif kind == "random_walk":
        value = -F.col("weight") / F.col("d1")
    else:
        raise ValueError("kind is symmetric or random_walk")
    off = joined.select("src", "dst", value.alias("weight"))
    return off.union(degree.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("weight"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def roughness(edges: DataFrame, values: DataFrame) -> DataFrame:
    """LIN14: (gene, roughness) = x^T L x / |x|^2 with L = D - W, as sums over edges; edges must be symmetric."""
    x = values.select(F.col("cell").alias("src"), "gene", F.col("value").alias("x1"))
    degree = edges.groupBy("src").agg(F.sum("weight").alias("d"))
    diagonal = x.join(degree, "src").groupBy("gene").agg(F.sum(F.col("d") * F.col("x1") * F.col("x1")).alias("diagonal"))
    cross = edges.join(x, "src").join(values.select(F.col("cell").alias("dst"), "gene", F.col("value").alias("x2")), ["dst", "gene"])
    cross = cross.groupBy("gene").agg(F.sum(F.col("weight") * F.col("x1") * F.col("x2")).alias("cross"))
    size = values.groupBy("gene").agg(F.sum(F.col("value") * F.col("value")).alias("size"))
    joined = size.join(diagonal, "gene", "left").join(cross, "gene", "left").fillna(0.0, ["diagonal", "cross"])
    return joined.select("gene", F.try_divide(F.col("diagonal") - F.col("cross"), F.col("size")).alias("roughness"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """MDL09: one row (modularity) of a labelling (cell, label) on symmetric edges."""
    joined = edges.join(labels.select(F.col("cell").alias("src"), F.col("label").alias("l1")), "src").join(labels.select(F.col("cell").alias("dst"), F.col("label").alias("l2")), "dst")
    parts = joined.groupBy("l1").agg(F.sum(F.when(F.col("l1") == F.col("l2"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("strength"))
    total = parts.agg(F.sum("strength").alias("m2"))
    return parts.join(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("strength") / F.col("m2"), 2)).alias("modularity"))


def attention(edges: DataFrame, features: DataFrame, self_weights: list[float], other_weights: list[float]) -> DataFrame:
    """MDL04: softmax over each source's edges of sigmoid(v0 . h_i + v1 . h_j); features: (cell, v)."""

    def part(weights, c, out):
        score = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return features.select(F.col("cell").alias(c), score.alias(out))

    joined = edges.join(part(self_weights, "src", "a"), "src").join(part(other_weights, "dst", "b"), "dst")
    logit = F.exp(1 / (1 + F.exp(-(F.col("a") + F.col("b")))))
    return joined.select("src", "dst", (logit / F.sum(logit).over(W.partitionBy("src"))).alias("weight"))


def blended_attention(full: DataFrame, pruned: DataFrame, alpha: float) -> DataFrame:
    """MDL05: (1 - alpha) full + alpha pruned; an absent edge has weight 0."""
    rows = full.select("src", "dst", ((1 - alpha) * F.col("weight")).alias("weight")).union(pruned.select("src", "dst", (alpha * F.col("weight")).alias("weight")))
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def attention_summary(edges: DataFrame) -> DataFrame:
    """AGG13: (cell, n, effective, largest): edges, 1 / sum w^2, and the largest weight of each source."""
    return edges.groupBy(F.col("src").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.lit(1.0), F.sum(F.col("weight") * F.col("weight"))).alias("effective"), F.max("weight").alias("largest"))


def shared_neighbours(edges: DataFrame, least: float, most: int = 2000) -> DataFrame:
    """GRF03: Jaccard index of the neighbour lists (src, dst) of pairs that share one, at least `least`.

    Pairs meet over a common neighbour; one that is in over `most` lists makes many pairs, which are dealt in tiles: each pair
    of tiles of its lists meets by itself.
    """
    n = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    tiles = edges.groupBy("dst").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("tiles"))
    dealt = edges.select("src", "dst").join(tiles, "dst").withColumn("tile", F.pmod(F.xxhash64("src"), F.col("tiles")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    a = dealt.select(F.col("src").alias("a"), F.col("dst").alias("common"), F.col("tile").alias("t1"), every.alias("t2"))
    b = dealt.select(F.col("src").alias("b"), F.col("dst").alias("common"), every.alias("t1"), F.col("tile").alias("t2"))
    both = a.join(b, ["common", "t1", "t2"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("inter"))
    sized = both.join(n.select(F.col("src").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("src").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("jaccard")).where(F.col("jaccard") >= least)
