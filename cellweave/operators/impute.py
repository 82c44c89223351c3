"""Imputation by neighbours: k-nearest-neighbour smoothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.numeric import freeman_tukey
from cellweave.operators.expression import median_normalised, restored_low_rank
from cellweave.operators.neighbors import balanced, nearest
from cellweave.operators.spectral import chosen_rank, low_rank, principal_components, singular_values
from cellweave.sources.shared import materialised


def gene_vectors(expr: DataFrame, genes: list) -> DataFrame:
    """(cell, v): one array per cell over the given genes (sorted), 0 where nothing was measured.

    A cell's values are gathered with their genes' places, from a table of genes of which there are some ten thousands at
    most, and scattered into its array in an Arrow task.
    """
    spark, size = expr.sparkSession, len(genes)
    kind = expr.schema["gene"].dataType.simpleString()
    places = F.broadcast(spark.createDataFrame(list(zip(genes, range(size), strict=True)), f"gene {kind}, at int"))
    wide = expr.join(places, "gene").groupBy("cell").agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("v"))

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = np.zeros((len(batch), size))
            for row, at, v in zip(rows, batch["at"], batch["v"], strict=True):
                row[at] = v
            yield pd.DataFrame({"cell": batch["cell"], "v": list(rows)})

    return wide.mapInPandas(run, wide.select("cell", F.col("v").cast("array<double>").alias("v")).schema)


def knn_smoothed(expr: DataFrame, k: int, d: int = 10, dither: float = 0.0) -> DataFrame:
    """LIN02: (cell, gene, value): raw counts summed over each cell and its k - 1 nearest cells.

    In steps k_t = min(2^t, k): the smoothed counts are median-normalised, Freeman-Tukey transformed and projected on d
    components; the k_t nearest cells, the cell itself included, are found there, and *raw* counts are summed over them.
    Zeros become 1 under the transform, so vectors are dense over the genes. dither shifts coordinates by up to that share
    of the largest range, by a hash of the cell. k may be as large as the number of cells.
    """
    genes = [r["gene"] for r in expr.select("gene").distinct().orderBy("gene").collect()]
    smooth = materialised(expr.select("cell", "gene", "value"))
    raw = smooth
    for t in range(1, int(np.ceil(np.log2(max(k, 1)))) + 1):
        now = min(2**t, k)
        rows = median_normalised(smooth).select("cell", "gene", "value")
        vectors = gene_vectors(rows, genes).select("cell", F.transform("v", lambda x: freeman_tukey(x)).alias("v"))
        reduced, _ = principal_components(materialised(vectors), d)
        reduced = reduced.withColumnRenamed("x", "v")
        if dither:
            span = reduced.select(F.posexplode("v").alias("j", "x")).groupBy("j").agg((F.max("x") - F.min("x")).alias("r")).agg(F.max("r").alias("r")).first()["r"]
            noise = lambda x, i: x + (F.pmod(F.xxhash64("cell", i), F.lit(1001)) / 1000 - 0.5) * 2 * dither * span
            reduced = reduced.select("cell", F.transform("v", noise).alias("v"))
        edges = nearest(materialised(reduced), k=now - 1).select("src", "dst").union(raw.select(F.col("cell").alias("src"), F.col("cell").alias("dst")).distinct())
        smooth = materialised(edges.join(raw.withColumnRenamed("cell", "dst"), "dst").groupBy(F.col("src").alias("cell"), "gene").agg(F.sum("value").alias("value")))
    return smooth


def alra(expr: DataFrame, rank: int | None = None, most: int = 100, noise_start: int = 80) -> DataFrame:
    """LIN04, LIN05: (cell, gene, value): expression completed by its approximation of the given rank or, without one, of
    the rank that its singular values show; see restored_low_rank() for what follows the factorisation."""
    genes = [r["gene"] for r in expr.select("gene").distinct().orderBy("gene").collect()]
    vectors = materialised(gene_vectors(expr, genes))
    values, vec = singular_values(vectors, most)
    rank = chosen_rank(values, noise_start) if rank is None else rank
    return restored_low_rank(materialised(low_rank(vectors, vec[:, :rank], genes)), expr)


def balanced_imputed(expr: DataFrame, points: DataFrame, k: int, sight: int, most: int) -> DataFrame:
    """MDL14: (cell, gene, value): the mean of a cell and its balanced neighbours, k of the `sight` nearest in points (cell, v), none
    of which more than `most` cells share; absent rows of expr are zeros."""
    edges = balanced(nearest(points, k=sight).select("src", "dst", "distance"), k, most)
    own = points.select(F.col("cell").alias("src"), F.col("cell").alias("dst"))
    links = materialised(edges.select("src", "dst").union(own))
    size = links.groupBy(F.col("src").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    sums = links.join(expr.withColumnRenamed("cell", "dst"), "dst").groupBy(F.col("src").alias("cell"), "gene").agg(F.sum("value").alias("s"))
    return sums.join(size, "cell").select("cell", "gene", (F.col("s") / F.col("n")).alias("value"))
