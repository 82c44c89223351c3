"""Several layers of one set of cells: parameters, block-diagonal graphs, normalised energies and what follows from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.operators import ranks


def layer_parameters(given, layers: Sequence[str], default=None) -> dict:
    """GRF31: a parameter of each layer from one value for all, one value a layer in order, or values by name.

    Layers that names leave out have the default. ValueError for a layer that is not known, for a sequence of another
    length, and for a layer without value or default.
    """
    if isinstance(given, Mapping):
        if unknown := sorted(set(given) - set(layers)):
            raise ValueError(f"unknown layers: {unknown}")
        out = {name: given.get(name, default) for name in layers}
    elif isinstance(given, Sequence) and not isinstance(given, str):
        if len(given) != len(layers):
            raise ValueError(f"{len(given)} values for {len(layers)} layers")
        out = dict(zip(layers, given, strict=True))
    else:
        out = dict.fromkeys(layers, default if given is None else given)
    if missing := [name for name, value in out.items() if value is None]:
        raise ValueError(f"no value for layers: {missing}")
    return out


def block_diagonal(graphs: Mapping[str, DataFrame]) -> DataFrame:
    """SET06: (sample, src, dst, weight): graphs of several samples as one, in which the sample is a part of a node's key."""
    parts = [g.select(F.lit(name).alias("sample"), "src", "dst", "weight") for name, g in graphs.items()]
    return reduce(DataFrame.unionAll, parts)


def normalised_energies(energies: DataFrame, method: str = "zscore") -> DataFrame:
    """GRF24: (cell, layer, energy) normalised within each layer: "zscore" (sample deviation), "median" (over the median)
    or "rank" (average rank over the number of cells)."""
    w = W.partitionBy("layer")
    if method == "rank":
        counts = energies.groupBy("layer", "energy").agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(w.orderBy("energy").rowsBetween(W.unboundedPreceding, W.currentRow))
        placed = counts.select("layer", "energy", (upto - (F.col("c") - 1) / 2).alias("r"), F.sum("c").over(w).alias("n"))
        return energies.join(placed, ["layer", "energy"]).select("cell", "layer", (F.col("r") / F.col("n")).alias("energy"))
    if method == "median":
        middle = energies.groupBy("layer").agg(F.median("energy").alias("m"))
        return energies.join(F.broadcast(middle), "layer").select("cell", "layer", F.try_divide("energy", "m").alias("energy"))  # one row per layer
    if method != "zscore":
        raise ValueError(f"unknown method: {method}")
    moments = energies.groupBy("layer").agg(F.avg("energy").alias("m"), F.stddev_samp("energy").alias("s"))
    return energies.join(F.broadcast(moments), "layer").select("cell", "layer", F.try_divide(F.col("energy") - F.col("m"), F.col("s")).alias("energy"))


def dominant_layer(energies: DataFrame, layers: Sequence[str]) -> DataFrame:
    """GRF24: (cell, layer): the layer of the largest energy, the first in the given order on ties."""
    order = F.coalesce(*[F.when(F.col("layer") == name, -k) for k, name in enumerate(layers)])
    best = energies.groupBy("cell").agg(F.max(F.struct("energy", order.alias("o"), "layer")).alias("b"))
    return best.select("cell", F.col("b.layer").alias("layer"))


def energy_alphas(energies: DataFrame, low: float = 0.1, high: float = 2.0, remove: Sequence[str] = ()) -> DataFrame:
    """GRF24: (cell, layer, alpha): low + (high - low) x the layer's share of the cell's energy; removed layers have none."""
    energy = F.when(F.col("layer").isin(list(remove)), 0.0).otherwise(F.col("energy")) if remove else F.col("energy")
    rows = energies.withColumn("energy", energy)
    share = F.col("energy") / (F.sum("energy").over(W.partitionBy("cell")) + 1e-10)
    return rows.select("cell", "layer", (low + (high - low) * share).alias("alpha"))


def spectrum_correlation(first: DataFrame, second: DataFrame) -> DataFrame:
    """LIN19: (correlation): Pearson correlation of two spectra (value), both falling; those of the longer are cut."""
    a, b = (ranks.numbered(s.select("value"), F.desc("value"), name="k").withColumnRenamed("value", x) for s, x in ((first, "a"), (second, "b")))
    return a.join(b, "k").agg(F.corr("a", "b").alias("correlation"))
