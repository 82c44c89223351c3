"""Queries on spectra, smoothing and clustering, which SQL can't express; tests hold them against dense algebra."""

import numpy as np
from pyspark.sql import functions as F

from cellweave.operators import impute, spectral
from cellweave.operators.graph import laplacian, symmetrised
from cellweave.operators.graph import strongest as strongest_edges
from cellweave.plans.graphs import symmetric, values
from cellweave.plans.registry import query
from cellweave.sources import bindings as B
from cellweave.sources.shared import materialised


@query()
def spectral_basis(spark, sf_dir):
    """LIN06, LIN08, LIN11: the eight smoothest vectors of the similarity graph, with their eigenvalues."""
    value, basis = spectral.smallest_laplacian(materialised(symmetric(spark, sf_dir)), 8)
    return basis.select("cell", F.posexplode("u").alias("k", "v")).withColumn("lam", F.array(*[F.lit(float(x)) for x in value])[F.col("k")])


@query()
def denoised_values(spark, sf_dir):
    """LIN12, LIN13, NUM21: values on a graph under a heat filter over its spectrum."""
    value, basis = spectral.smallest_laplacian(materialised(symmetric(spark, sf_dir)), 8)
    gains = np.exp(-2.0 * value)
    return spectral.denoised(basis, gains / gains.max(), values(spark, sf_dir))


@query()
def knn_smoothing(spark, sf_dir):
    """LIN01, LIN02, NUM05: k-nearest-neighbour smoothing, k = 8."""
    return impute.knn_smoothed(B.expression(spark, sf_dir), 8)


@query()
def principal_components(spark, sf_dir):
    """LIN01, LIN18: the first five components of all vectors."""
    rows, share = spectral.principal_components(B.embedding(spark, sf_dir).select("cell", "v"), 5)
    return rows.select("cell", F.posexplode("x").alias("k", "x")).withColumn("share", F.array(*[F.lit(float(s)) for s in share])[F.col("k")])


@query()
def gene_filtered_values(spark, sf_dir):
    """LIN13, LIN14, LIN15: every gene under a heat filter of its own, by its roughness on the graph."""
    edges = materialised(symmetric(spark, sf_dir))
    value, basis = spectral.smallest_laplacian(edges, 8)
    return spectral.gene_filtered(laplacian(edges), basis, value, values(spark, sf_dir))


@query()
def fused_basis_by_cell(spark, sf_dir):
    """LIN09, LIN10: the four smoothest vectors over two graphs, less their own bases; the first with a strength for each cell."""
    edges = materialised(symmetric(spark, sf_dir))
    strongest = materialised(symmetrised(strongest_edges(edges, 5).select("src", "dst", "weight")))
    strengths = B.embedding(spark, sf_dir).select("cell", ((F.col("label") % 3 + 1) / 4.0).alias("alpha"))
    value, basis = spectral.fused_basis([edges, strongest], [1.0, 0.5], [strengths, 0.25], 4, tolerance=5e-3)
    return basis.select("cell", F.posexplode("u").alias("k", "v")).withColumn("lam", F.array(*[F.lit(float(x)) for x in value])[F.col("k")])
