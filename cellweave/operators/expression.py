"""Long expression tables (cell, gene, value): normalisation, per-gene statistics with implicit zeros, rescaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.operators.ranks import quantiles, running_by


def library_sizes(expr: DataFrame) -> DataFrame:
    """AGG01: (cell, library)."""
    return expr.groupBy("cell").agg(F.sum("value").alias("library"))


def detected_genes(expr: DataFrame, least_cells: int) -> DataFrame:
    """FLT02: rows of genes with a positive value in at least least_cells cells."""
    kept = expr.groupBy("gene").agg(F.count_if(F.col("value") > 0).alias("n")).where(F.col("n") >= least_cells).select("gene")
    return expr.join(kept, "gene", "left_semi")


def median_normalised(expr: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """NUM04, NUM07: value x median library / own library; with `library` (cell, library) by that of another assay."""
    sizes = library_sizes(expr) if library is None else library
    median = quantiles(sizes, "library", [0.5]).select(F.col("q")[0].alias("scale"))
    return expr.join(sizes, "cell").join(F.broadcast(median)).withColumn("value", F.try_divide(F.col("value") * F.col("scale"), F.col("library"))).drop("scale")


def densified(expr: DataFrame) -> DataFrame:
    """JON15: every (cell, gene) with zero where no row is. The grid is what is asked for, so its size is the result's."""
    grid = expr.select("cell").distinct().join(expr.select("gene").distinct(), how="cross")
    return grid.join(expr.select("cell", "gene", "value"), ["cell", "gene"], "left").fillna(0.0, ["value"])


def gene_moments(expr: DataFrame) -> DataFrame:
    """AGG25, AGG26: (gene, n_cells, detected, mean, variance, nonzero_mean, nonzero_sd); absent rows count as zeros.

    Sums are taken over the rows that exist and divided by the number of cells, so nothing is densified.
    """
    n = expr.select("cell").distinct().agg(F.count(F.lit(1)).alias("n_cells"))
    v, some = F.col("value"), F.col("value") != 0
    sums = expr.groupBy("gene").agg(F.count_if(some).alias("detected"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.avg(F.when(some, v)).alias("nonzero_mean"), F.stddev_samp(F.when(some, v)).alias("nonzero_sd"))
    mean = F.col("s") / F.col("n_cells")
    return sums.join(F.broadcast(n)).select("gene", "n_cells", "detected", mean.alias("mean"), (F.col("ss") / F.col("n_cells") - mean * mean).alias("variance"), "nonzero_mean", "nonzero_sd")


def gene_quantile(expr: DataFrame, q: float, out: str) -> DataFrame:
    """GRF17: the linear q-quantile of each gene over all cells, absent rows being zeros (values are not negative).

    Zeros sort first, so the position of the quantile among all cells is one among the rows that exist after a shift by
    the number of zeros; two values per gene decide, and nothing is densified. Equal values are counted first, and a gene's
    values are placed by ranges.
    """
    n = expr.select("cell").distinct().agg(F.count(F.lit(1)).alias("n"))
    counts = expr.where("value > 0").groupBy("gene", "value").agg(F.count(F.lit(1)).alias("c"))
    ranked = running_by(counts, "gene", "c", F.desc("value"), name="upto")  # so many cells have this value or more
    at = (F.col("n") - 1) * q
    low, high = F.floor(at), F.ceil(at)
    within = lambda place: (F.col("n") - F.col("upto") <= place) & (place < F.col("n") - F.col("upto") + F.col("c"))
    picked = ranked.join(F.broadcast(n)).groupBy("gene").agg(
        F.max(at).alias("at"), F.coalesce(F.max(F.when(within(low), F.col("value"))), F.lit(0.0)).alias("low"), F.coalesce(F.max(F.when(within(high), F.col("value"))), F.lit(0.0)).alias("high")
    )
    found = picked.select("gene", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias(out))
    return expr.select("gene").distinct().join(found, "gene", "left").fillna(0.0, [out])


def variable_genes(expr: DataFrame, top: int) -> DataFrame:
    """SRT07: the genes of the largest positive population variance."""
    rows = gene_moments(expr).where("variance > 0")
    return rows.orderBy(F.desc(F.round("variance", 6)), "gene").limit(top).select("gene", "variance")


def rescaled_to_reference(imputed: DataFrame, reference: DataFrame, q: float = 0.99, eps: float = 1e-8) -> DataFrame:
    """GRF16, GRF17: imputed values x (q-quantile of the reference gene) / (q-quantile of the imputed gene + eps).

    A gene without positive values has quantile 0, as has one that the reference lacks; its rows stay, with 0."""
    factors = gene_quantile(imputed, q, "own").join(gene_quantile(reference, q, "target"), "gene", "left")
    joined = imputed.join(factors.select("gene", (F.coalesce("target", F.lit(0.0)) / (F.col("own") + eps)).alias("factor")), "gene")
    return joined.withColumn("value", F.col("value") * F.col("factor")).drop("factor")


def group_grid(expr: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, gene, n): every group (its number of cells n) with every gene; groups: (cell, grp). Groups are few: one row
    that lists them is what each gene is combined with."""
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("grp", "n")).alias("g"))
    return expr.select("gene").distinct().join(F.broadcast(sizes)).select("gene", F.explode("g").alias("g")).select("g.grp", "gene", "g.n")


def marker_profile(expr: DataFrame, groups: DataFrame) -> DataFrame:
    """AGG12: (grp, gene, mean, pct) of every group and gene: mean expression and share of expressing cells, zeros
    included, and the mean's z-score across all groups, clipped to +-2. groups: (cell, grp)."""
    sums = expr.join(groups, "cell").groupBy("grp", "gene").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("k"))
    joined = group_grid(expr, groups).join(sums, ["grp", "gene"], "left")
    means = joined.select("grp", "gene", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"), (F.coalesce("k", F.lit(0)) / F.col("n")).alias("pct"))
    w = W.partitionBy("gene")
    z = F.coalesce(F.try_divide(F.col("mean") - F.avg("mean").over(w), F.stddev_samp("mean").over(w)), F.lit(0.0))
    return means.withColumn("z", F.least(F.greatest(z, F.lit(-2.0)), F.lit(2.0)))


def restored_low_rank(low_rank: DataFrame, original: DataFrame, q: float = 0.001) -> DataFrame:
    """LIN05 after the factorisation: of (cell, gene, value) completed by low rank, per gene values up to the size of the
    q-quantile become 0, the rest is moved to the mean and deviation of the original's non-zeros, negatives become 0, and
    original non-zeros that were lost come back."""
    cut = low_rank.groupBy("gene").agg(F.abs(F.percentile("value", q)).alias("cut"))
    kept = low_rank.join(cut, "gene").withColumn("kept", F.when(F.col("value") > F.col("cut"), F.col("value")))
    w = W.partitionBy("gene")
    own = kept.withColumn("m", F.avg("kept").over(w)).withColumn("s", F.stddev_samp("kept").over(w))
    target = original.where("value <> 0").groupBy("gene").agg(F.avg("value").alias("m0"), F.stddev_samp("value").alias("s0"))
    moved = own.join(target, "gene", "left").withColumn(
        "moved", F.when(F.col("s").isNull() | (F.col("s") == 0) | F.col("s0").isNull(), F.col("kept")).otherwise((F.col("kept") - F.col("m")) * F.col("s0") / F.col("s") + F.col("m0"))
    )
    joined = moved.join(original.select("cell", "gene", F.col("value").alias("v0")), ["cell", "gene"], "left")
    value = F.greatest(F.coalesce("moved", F.lit(0.0)), F.lit(0.0))
    return joined.select("cell", "gene", F.when((value == 0) & (F.coalesce("v0", F.lit(0.0)) > 0), F.col("v0")).otherwise(value).alias("value"))
