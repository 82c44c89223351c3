"""Regulatory networks: tree importances, ridge coefficients within clusters, transition probabilities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def adaptive_k(n: Column) -> Column:
    """NUM22: 2.5 per cent of n, cut down to a whole number, at least 20 and at most 100."""
    return F.least(F.greatest(F.floor(n * 0.025), F.lit(20)), F.lit(100)).cast("long")


def _gain_of_trees(bins: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float, columns: int, rng, bagged: bool) -> np.ndarray:
    """Squared error removed by each column of binned features, over boosted trees or, bagged, over a forest."""
    importance, residual, n_bins = np.zeros(bins.shape[1]), y - y.mean(), int(bins.max()) + 1 if bins.size else 1
    for _ in range(rounds):
        rows = rng.integers(0, len(y), len(y)) if bagged else np.arange(len(y))
        target, fitted = (y - y.mean() if bagged else residual), np.zeros(len(y))
        level = [rows]
        for _ in range(depth):
            after = []
            for own in level:
                chosen = rng.choice(bins.shape[1], columns, replace=False)
                t, best = target[own], (1e-12, -1, 0)
                for c in chosen:
                    count = np.bincount(bins[own, c], minlength=n_bins)[:-1].cumsum()
                    left = np.bincount(bins[own, c], t, n_bins)[:-1].cumsum()
                    right, m = t.sum() - left, len(own) - count
                    gain = np.where((count > 0) & (m > 0), left**2 / np.maximum(count, 1) + right**2 / np.maximum(m, 1), -np.inf) - t.sum() ** 2 / len(own)
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), int(c), int(gain.argmax()))
                if best[1] < 0:
                    fitted[own] = t.mean()
                    continue
                importance[best[1]] += best[0]
                for side in (own[bins[own, best[1]] <= best[2]], own[bins[own, best[1]] > best[2]]):
                    fitted[side] = target[side].mean()
                    if len(side) > 3:
                        after.append(side)
            level = after
        if not bagged:
            residual = residual - rate * fitted
    return importance / max(rounds, 1)


def inferred_network(expr: DataFrame, regulators: list, method: str = "boosting", rounds: int = 60, depth: int = 3, rate: float = 0.05, n_bins: int = 32, most_cells: int = 20_000, seed: int = 777) -> DataFrame:
    """MDL01: (regulator, target, importance): how much squared error of each gene of (cell, gene, value) the regulators
    remove in regression trees, boosted ("boosting") or as a forest ("forest"); zero importances are left out.

    Each target is a group of its own, so targets are spread over the cluster. A target's trees see the regulators'
    values, binned by rank, of at most about most_cells cells, chosen by a hash of the cell: a bounded sample, which is
    broadcast (most_cells x regulators bytes). A gene does not regulate itself. ValueError without regulators or for
    another method; regulators that are not measured are ignored.
    """
    if not regulators:
        raise ValueError("no candidate regulators")
    if method not in ("boosting", "forest"):
        raise ValueError("method must be 'boosting' or 'forest'")
    cells = expr.select("cell").distinct()
    n = cells.count()
    if n > most_cells:
        cells = cells.where(F.pmod(F.xxhash64("cell"), F.lit(1_000_000)) < int(1_000_000 * most_cells / n))
    order = [r["cell"] for r in cells.orderBy("cell").collect()]  # about most_cells
    place = {c: i for i, c in enumerate(order)}
    known = expr.join(F.broadcast(cells), "cell")
    measured = known.where(F.col("gene").isin(list(regulators))).select("cell", "gene", "value").toPandas()  # the bounded sample
    names = sorted(measured.gene.unique().tolist())
    x = np.zeros((len(order), len(names)))
    x[measured.cell.map(place), measured.gene.map({g: i for i, g in enumerate(names)})] = measured.value
    bins = np.zeros(x.shape, np.uint8)
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else x[:, j]
        bins[:, j] = np.searchsorted(cuts, x[:, j], "left")
    given = expr.sparkSession.sparkContext.broadcast((bins, names, place))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        binned, own, at = given.value
        y, gene = np.zeros(len(binned)), rows.gene.iloc[0]
        y[rows.cell.map(at)] = rows.value
        use = [k for k, g in enumerate(own) if g != gene]
        rng = np.random.default_rng([seed, abs(hash(gene)) % 2**32 if not isinstance(gene, str) else sum(gene.encode())])
        columns = max(1, len(use) // 3) if method == "forest" else max(1, round(len(use) * 0.8))
        gains = _gain_of_trees(binned[:, use], y, rounds, depth, rate, columns, rng, method == "forest") if use and len(y) else np.zeros(len(use))
        keep = gains > 0
        return pd.DataFrame({"regulator": [own[k] for k, ok in zip(use, keep, strict=True) if ok], "target": [gene] * int(keep.sum()), "importance": gains[keep]})

    kind = expr.schema["gene"].dataType.simpleString()
    return known.select("gene", "cell", F.col("value").cast("double").alias("value")).groupBy("gene").applyInPandas(fit, f"regulator {kind}, target {kind}, importance double")


def ridge_network(vectors: DataFrame, regulators: list[int], alpha: float = 10.0) -> DataFrame:
    """MDL14: (grp, regulator, target, weight): ridge coefficients of each column of vectors (cell, grp, v) on the columns
    `regulators`, with intercept, within each group; a column is not its own regulator.

    Products of columns are summed in each partition and added up line by line, so that no task sees a group's rows
    together; the equations of a group, columns x columns, are solved in one task.
    """

    def sums(batches):
        total: dict = {}
        for batch in batches:
            for grp, rows in batch.groupby("grp"):
                x = np.stack(rows.v.to_numpy())
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                total[grp] = total.get(grp, 0) + x.T @ x
        for grp, m in total.items():
            yield pd.DataFrame({"grp": grp, "i": np.arange(len(m)), "row": list(m)})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"grp": rows.grp.iloc[:1], "i": rows.i.iloc[:1], "row": [np.sum(np.stack(rows.row.to_numpy()), axis=0)]})

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(rows.sort_values("i").row.to_numpy())
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        products = m[1:, 1:] - n * np.outer(mean, mean)
        out = []
        for t in range(len(mean)):
            use = [r for r in regulators if r != t]
            w = np.linalg.solve(products[np.ix_(use, use)] + alpha * np.eye(len(use)), products[use, t])
            out.append(pd.DataFrame({"grp": rows.grp.iloc[0], "regulator": use, "target": t, "weight": w}))
        return pd.concat(out, ignore_index=True)

    kind = vectors.schema["grp"].dataType.simpleString()
    lines = vectors.select("grp", "v").mapInPandas(sums, f"grp {kind}, i long, row array<double>").groupBy("grp", "i").applyInPandas(add, f"grp {kind}, i long, row array<double>")
    return lines.groupBy("grp").applyInPandas(solve, f"grp {kind}, regulator long, target long, weight double")


def transitions(edges: DataFrame, vectors: DataFrame, shifts: DataFrame, temperature: float = 0.05) -> DataFrame:
    """MDL14: (src, dst, probability): of each cell's neighbours (src, dst) a softmax of the correlation between its
    simulated shift (cell, d) and the way to the neighbour, over the columns of vectors (cell, v)."""
    a = vectors.select(F.col("cell").alias("src"), F.col("v").alias("v0")).join(shifts.select(F.col("cell").alias("src"), "d"), "src")
    way = edges.select("src", "dst").join(a, "src").join(vectors.select(F.col("cell").alias("dst"), F.col("v").alias("v1")), "dst")
    way = way.select("src", "dst", "d", F.zip_with("v1", "v0", lambda p, q: p - q).alias("w"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    n = F.size("d")
    dot = lambda p, q: total(F.zip_with(p, q, lambda x, y: x * y)) - total(F.col(p)) * total(F.col(q)) / n
    r = F.coalesce(F.try_divide(dot("d", "w"), F.sqrt(F.abs(dot("d", "d")) * F.abs(dot("w", "w")))), F.lit(0.0))
    mass = F.exp((F.col("r") - 1) / temperature)
    return way.select("src", "dst", r.alias("r")).select("src", "dst", (mass / F.sum(mass).over(W.partitionBy("src"))).alias("probability"))
