"""Affinities and layer weights built on neighbour edges; communities; propagated knock-outs; rank-sum markers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.operators.expression import group_grid
from cellweave.operators.graph import both_ways, row_normalised, with_diagonal
from cellweave.operators.spectral import gram
from cellweave.sources.shared import materialised


def magic_affinity(edges: DataFrame, k_sigma: int) -> DataFrame:
    """GRF13: exp(-(d / s_i)^2) with s_i the k_sigma-th distance, A + A^T, diagonal = the row's maximum, rows normalised.

    edges: (src, dst, distance, rank)."""
    sigma = edges.where(F.col("rank") == k_sigma).select("src", F.col("distance").alias("sigma"))
    weighted = edges.join(sigma, "src").select("src", "dst", F.exp(-F.pow(F.col("distance") / F.greatest("sigma", F.lit(1e-12)), 2)).alias("weight"))
    summed = both_ways(weighted).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return row_normalised(with_diagonal(summed, F.max("weight")))


def prior_edges(edges: DataFrame, cells: DataFrame, top: int, penalty: float, same: float = 8.0, cross: float = 12.0) -> DataFrame:
    """GRF10: neighbour edges (src, dst, distance) scored by 8 for the same type, -12 for another, less penalty x distance;
    the `top` best of each source, their scores clamped to +-30 and turned into a softmax (NUM16). cells: (cell, type)."""
    ends = [cells.select(F.col("cell").alias(c), F.col("type").alias(f"t_{c}")) for c in ("src", "dst")]
    scored = edges.join(ends[0], "src").join(ends[1], "dst")
    score = F.when(F.col("t_src") == F.col("t_dst"), F.lit(same)).otherwise(F.lit(-cross)) - penalty * F.col("distance")
    scored = scored.withColumn("score", score).withColumn("k", F.row_number().over(W.partitionBy("src").orderBy(F.desc(F.round("score", 9)), "dst"))).where(F.col("k") <= top)
    mass = F.exp(F.least(F.greatest("score", F.lit(-30.0)), F.lit(30.0)))
    return scored.withColumn("weight", mass / F.sum(mass).over(W.partitionBy("src"))).select("src", "dst", "score", "weight")


def layer_weights(energies: DataFrame, temperature: float = 1.0, floor: float = 1e-4) -> DataFrame:
    """GRF22: (cell, layer, weight): softmax over each cell's layers of -energy / temperature, at least `floor`, renormalised."""
    w = W.partitionBy("cell")
    low = F.min("energy").over(w)
    soft = energies.withColumn("weight", F.exp(-(F.col("energy") - low) / temperature))
    soft = soft.withColumn("weight", F.greatest(F.col("weight") / F.sum("weight").over(w), F.lit(floor)))
    return soft.withColumn("weight", F.col("weight") / F.sum("weight").over(w)).select("cell", "layer", "weight")


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """MDL07: (cell, label) by synchronous label propagation on symmetric edges: each node takes the label of the largest
    weight among its neighbours and itself, the least on ties; stops when no label changes, or after `rounds`, since two
    labels can alternate for ever."""
    moves = materialised(edges.select("src", "dst", "weight").union(edges.select("src", F.col("src").alias("dst"), F.lit(0.0)).distinct()))
    labels = materialised(moves.select(F.col("src").alias("cell")).distinct().withColumn("label", F.col("cell")))
    for _ in range(rounds):
        votes = moves.join(labels.withColumnRenamed("cell", "dst"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("src").agg(F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("label")).alias("label"))).alias("b"))
        after = materialised(best.select(F.col("src").alias("cell"), (-F.col("b.label")).alias("label")))
        changed = after.join(labels.withColumnRenamed("label", "before"), "cell").where("label <> before").isEmpty()
        labels = after
        if changed:
            break
    return labels


def propagated(network: DataFrame, start: DataFrame, clamped: DataFrame, steps: int = 3) -> DataFrame:
    """MDL14: (cell, gene, delta): a change of expression carried along (regulator, target, weight) for `steps` rounds;
    clamped (gene, delta) keeps its change in every round. start: (cell, gene, delta)."""
    now = start
    held = start.select("cell").distinct().join(F.broadcast(clamped), how="cross")  # a knock-out clamps a few given genes
    for _ in range(steps):
        moved = network.join(now.withColumnRenamed("gene", "regulator"), "regulator").groupBy("cell", F.col("target").alias("gene")).agg(F.sum(F.col("weight") * F.col("delta")).alias("delta"))
        now = moved.join(F.broadcast(clamped.select("gene")), "gene", "left_anti").select("cell", "gene", "delta").union(held.select("cell", "gene", "delta"))
    return now


def rank_sum_markers(expr: DataFrame, groups: DataFrame, least_share: float = 0.25, least_difference: float | None = None) -> DataFrame:
    """AGG36: (grp, gene, z, difference, pct): normal approximation of the Wilcoxon rank-sum of each group against the
    rest, over all cells of `groups` (cell, grp), with average ranks and the variance corrected for ties.

    Absent rows are zeros: of each gene they are one block of ties, put in its place by its count, and no row is made for
    them. Groups with every cell are left out; pct is the share of a group's cells with a positive value, difference the
    difference of means, and rows below least_share or least_difference are left out.
    """
    zero, sizes = F.lit(0.0), group_grid(expr, groups)
    rows = expr.join(groups, "cell").select("grp", "gene", F.col("value").cast("double").alias("value"))
    n = groups.agg(F.count(F.lit(1)).alias("n_all"))
    stored = rows.groupBy("gene").agg(F.count(F.lit(1)).alias("k"))
    absent = sizes.select("gene").distinct().join(stored, "gene", "left").join(F.broadcast(n)).select("gene", zero.alias("value"), (F.col("n_all") - F.coalesce("k", F.lit(0))).alias("c"))
    per_value = rows.groupBy("gene", "value").agg(F.count(F.lit(1)).alias("c")).union(absent).groupBy("gene", "value").agg(F.sum("c").alias("c")).where("c > 0")
    below = F.coalesce(F.sum("c").over(W.partitionBy("gene").orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = per_value.select("gene", "value", "c", (below + (F.col("c") + 1) / 2).alias("rank"))
    c = F.col("c").cast("double")
    ties = ranks.groupBy("gene").agg(F.sum(c * c * c - c).alias("ties"), F.max(F.when(F.col("value") == 0, F.col("rank"))).alias("zero_rank"))
    whole = rows.groupBy("gene").agg(F.sum("value").alias("s"))
    own = rows.join(ranks.select("gene", "value", "rank"), ["gene", "value"]).groupBy("grp", "gene").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("stored"), F.sum("value").alias("s1"), F.count_if(F.col("value") > 0).alias("k"))
    joined = sizes.withColumnRenamed("n", "n1").join(F.broadcast(n.withColumnRenamed("n_all", "n"))).join(own, ["grp", "gene"], "left").join(ties, "gene").join(whole, "gene", "left").where("n > n1")
    joined = joined.fillna(0, ["r", "stored", "s1", "k", "s", "zero_rank"])
    n1, n2, n = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    u = F.col("r") + (n1 - F.col("stored")) * F.col("zero_rank") - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    z = F.coalesce(F.try_divide(u - n1 * n2 / 2, F.sqrt(variance)), zero)
    out = joined.select("grp", "gene", z.alias("z"), (F.col("s1") / n1 - (F.col("s") - F.col("s1")) / n2).alias("difference"), (F.col("k") / n1).alias("pct"))
    out = out.where(F.col("pct") >= least_share)
    return out if least_difference is None else out.where(F.col("difference") >= least_difference)


def shared_covariance_mixture(points: DataFrame, k: int, rounds: int = 30, tolerance: float = 1e-6, ridge: float = 1e-6) -> DataFrame:
    """MDL06: (cell, cluster, probability): a mixture of k Gaussians of one covariance of any shape (EEE) over (cell, v).

    Expectation maximisation: a round is one pass over the rows that sums responsibilities and weighted vectors; k means
    and one covariance of columns x columns are what the driver holds. The means start at k rows far from each other,
    chosen among about 2,000 rows by a hash of the cell. It ends when the log-likelihood of a row gains less than
    `tolerance`, or after `rounds`. Clusters are numbered by rising first coordinate of their means.
    """
    n = points.count()
    some = points.where(F.pmod(F.xxhash64("cell"), F.lit(1_000_000)) < int(min(1.0, 2000 / max(n, 1)) * 1_000_000)) if n > 2000 else points
    x = np.array([r["v"] for r in some.orderBy("cell").limit(4000).collect()])
    means = [x.mean(0)]
    gaps = np.full(len(x), np.inf)
    for _ in range(k):
        gaps = np.minimum(gaps, ((x - means[-1]) ** 2).sum(1)) if len(means) > 1 else ((x - means[0]) ** 2).sum(1)
        means.append(x[gaps.argmax()])
    means = np.array(means[1:])
    ones = points.select(F.concat(F.array(F.lit(1.0)), "v").alias("x"))
    moments = gram(ones)
    second, mean = moments[1:, 1:] / n, moments[0, 1:] / n
    covariance, share, before = second - np.outer(mean, mean), np.full(k, 1 / k), -np.inf
    for _ in range(rounds):
        model = (means, covariance + ridge * np.trace(covariance) / len(mean) * np.eye(len(mean)), share)
        total = _responsibilities(points, model).groupBy("cluster").agg(F.sum("mass").alias("mass"), F.sum("loglik").alias("loglik"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(len(mean))]).toPandas().sort_values("cluster")
        mass = np.maximum(total.mass.to_numpy(), 1e-12)
        means = total[[f"s{j}" for j in range(len(mean))]].to_numpy() / mass[:, None]
        share = mass / mass.sum()
        covariance = second - (means.T * share) @ means
        now = total.loglik.sum() / n
        if now - before < tolerance:
            break
        before = now
    order = np.argsort(means[:, 0])
    return _assigned(points, (means[order], covariance + ridge * np.trace(covariance) / len(mean) * np.eye(len(mean)), share[order]))


def _log_densities(x: np.ndarray, model) -> np.ndarray:
    means, covariance, share = model
    root = np.linalg.cholesky(covariance)
    white, centres = np.linalg.solve(root, x.T).T, np.linalg.solve(root, means.T).T
    d = (white**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * white @ centres.T
    return np.log(share) - 0.5 * d - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)


def _responsibilities(points: DataFrame, model) -> DataFrame:
    given = points.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        k, width = given.value[0].shape
        mass, sums, loglik = np.zeros(k), np.zeros((k, width)), np.zeros(k)
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy())
                logs = _log_densities(x, given.value)
                top = logs.max(1, keepdims=True)
                whole = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
                r = np.exp(logs - whole)
                mass, sums = mass + r.sum(0), sums + r.T @ x
                loglik[0] += whole.sum()
        yield pd.DataFrame({"cluster": np.arange(k), "mass": mass, "sums": list(sums), "loglik": loglik})

    return points.select("v").mapInPandas(run, "cluster long, mass double, sums array<double>, loglik double")


def _assigned(points: DataFrame, model) -> DataFrame:
    given = points.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if len(batch):
                logs = _log_densities(np.stack(batch["v"].to_numpy()), given.value)
                p = np.exp(logs - logs.max(1, keepdims=True))
                yield pd.DataFrame({"cell": batch["cell"], "cluster": p.argmax(1), "probability": p.max(1) / p.sum(1)})

    schema = points.select("cell", F.lit(0).cast("long").alias("cluster"), F.lit(0.0).alias("probability")).schema
    return points.select("cell", "v").mapInPandas(run, schema)
