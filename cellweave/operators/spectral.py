"""Spectra and low-rank structure of large graphs and matrices.

Vectors of a graph are tables (cell, x array<double>), one array entry per column of a block. A product with the graph is
a join with the edges and a sum; only matrices of the block's width (tens) reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.graph import laplacian
from cellweave.sources.shared import materialised, released


def gram(rows: DataFrame, a: str = "x", b: str | None = None) -> np.ndarray:
    """Sum over rows of a b^T, for array columns a and b: a partial sum per partition, packed in one row for each line of
    the matrix, is added up line by line, so that a task of the sum holds one line at a time."""

    def part(batches):
        total = None
        for batch in batches:
            if len(batch):
                x = np.stack(batch["a"].to_numpy())
                y = np.stack(batch["b"].to_numpy()) if "b" in batch else x
                total = x.T @ y if total is None else total + x.T @ y
        if total is not None:
            import pandas as pd

            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    def add(lines):
        import pandas as pd

        return pd.DataFrame({"i": lines.i.iloc[:1], "row": [np.sum(np.stack(lines.row.to_numpy()), axis=0)]})

    chosen = rows.select(F.col(a).alias("a"), *([F.col(b).alias("b")] if b else []))
    parts = chosen.mapInPandas(part, "i long, row array<double>")
    found = parts.groupBy("i").applyInPandas(add, "i long, row array<double>").toPandas().sort_values("i")  # width lines
    return np.stack(found.row.to_numpy()) if len(found) else np.zeros((0, 0))


def times(column: Column | str, matrix: np.ndarray) -> Column:
    """An array column times a matrix of a block's width (tens): its entries are literals of the plan."""
    cols = F.array(*[F.array(*[F.lit(float(v)) for v in col]) for col in matrix.T])
    return F.transform(cols, lambda m: F.aggregate(F.zip_with(F.col(column) if isinstance(column, str) else column, m, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v))


def projected(rows: DataFrame, matrix: np.ndarray, offset: np.ndarray) -> DataFrame:
    """(cell, x): rows (cell, v) less offset, times a matrix of any height, which goes to the tasks as a broadcast."""
    given = rows.sparkSession.sparkContext.broadcast((matrix, offset))

    def run(batches):
        import pandas as pd

        m, o = given.value
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"cell": batch["cell"], "x": list((np.stack(batch["v"].to_numpy()) - o) @ m)})

    schema = rows.select("cell", F.lit(None).cast("array<double>").alias("x")).schema
    return rows.select("cell", "v").mapInPandas(run, schema)


def product(edges: DataFrame, block: DataFrame, shift: float = 0.0, factor: float = 1.0, low_rank: list[tuple[float, DataFrame]] = (), width: int | None = None) -> DataFrame:
    """shift x + factor (A - sum alpha U U^T) x for edges A (src, dst, weight) and (alpha, U) pairs, U being (cell, u).

    The width of the block is a number of sums in one aggregation, so a product is one join and one combined shuffle."""
    width = width or len(block.select("x").first()["x"])
    entries = lambda scale: [(F.col("x")[j] * scale).alias(f"x{j}") for j in range(width)]
    total = block.select("cell", *entries(shift)).union(edges.join(block.withColumnRenamed("cell", "dst"), "dst").select(F.col("src").alias("cell"), *entries(F.col("weight") * factor)))
    for alpha, basis in low_rank:
        small = gram(basis.join(block, "cell"), "u", "x")
        total = total.union(basis.select("cell", times("u", -factor * alpha * small).alias("x")).select("cell", *entries(1.0)))
    summed = total.groupBy("cell").agg(*[F.sum(f"x{j}").alias(f"x{j}") for j in range(width)])
    return summed.select("cell", F.array(*[f"x{j}" for j in range(width)]).alias("x"))


def _orthonormal(block: DataFrame) -> DataFrame:
    g = gram(block)
    lam, v = np.linalg.eigh(g)
    return materialised(block.select("cell", times("x", v / np.sqrt(np.maximum(lam, 1e-300))).alias("x")))


def extreme_eigenpairs(edges: DataFrame, nodes: DataFrame, k: int, shift: float, factor: float, span: tuple[float, float] = (0.0, 2.0), steps: int = 8, extra: int = 8, low_rank=(), tolerance: float = 1e-3, most_rounds: int = 20) -> tuple[np.ndarray, DataFrame]:
    """LIN08, LIN09: the k largest eigenvalues of M = shift + factor (A - sum alpha U U^T), whose spectrum lies in `span`,
    and their vectors (cell, u).

    Block Krylov with restarts: from an orthonormal block of k + extra columns, started from hashes of the node ids, the
    Chebyshev polynomials of M times the block are made up to degree `steps`, each by one join with the edges; they stay
    bounded, so that one Gram matrix at the end is enough for the Rayleigh-Ritz problem over all of them. The best
    k + extra vectors start the next round. It ends when every residual |M u - value u| is at most `tolerance` times the
    largest end of the span, by which the values are off at most that much; RuntimeError after most_rounds.
    """
    width, centre, half = k + extra, (span[0] + span[1]) / 2, (span[1] - span[0]) / 2
    start = nodes.select("cell", F.array(*[(F.pmod(F.xxhash64("cell", F.lit(j)), F.lit(2_000_003)) / 1_000_001.5 - 1) for j in range(width)]).alias("x"))
    n, block = steps * width, np.eye(width)
    # M' T_0 = T_1 and M' T_j = (T_{j+1} + T_{j-1}) / 2 for M' = (M - centre) / half
    image = np.zeros((n + width, n))
    for j in range(steps):
        own = slice(j * width, (j + 1) * width)
        image[(j + 1) * width : (j + 2) * width, own] = block / (2 if j else 1)
        if j:
            image[(j - 1) * width : j * width, own] = block / 2
    for _ in range(most_rounds):
        tables = [_orthonormal(start)]
        for j in range(steps):
            scale = (2.0 if j else 1.0) / half
            moved = product(edges, tables[-1], (shift - centre) * scale, factor * scale, low_rank, width)
            if j:
                moved = moved.withColumnRenamed("x", "y").join(tables[-2], "cell").select("cell", F.zip_with("y", "x", lambda p, q: p - q).alias("x"))
            tables.append(materialised(moved))
        # every polynomial is written once, and all are joined once
        joined = tables[0].select("cell", F.col("x").alias("x0"))
        for j, t in enumerate(tables[1:], 1):
            joined = joined.join(t.select("cell", F.col("x").alias(f"x{j}")), "cell")
        table = materialised(joined.select("cell", F.concat(*[f"x{j}" for j in range(steps + 1)]).alias("x")))
        used = tables
        m = gram(table)
        g, h, yy = m[:n, :n], m[:n] @ image, image.T @ m @ image
        lam, v = np.linalg.eigh(g)
        keep = lam > 1e-8 * lam.max()
        base = v[:, keep] / np.sqrt(lam[keep])
        value, vector = np.linalg.eigh(base.T @ ((h + h.T) / 2) @ base)
        order = np.argsort(-value)
        value, vector = value[order], base @ vector[:, order]
        c, top = vector[:, :k], value[:k]
        residual = np.einsum("ij,ij->j", c, yy @ c) - 2 * top * np.einsum("ij,ij->j", c, h @ c) + top**2
        done = half * np.sqrt(np.maximum(residual, 0)).max() <= tolerance * max(map(abs, span))
        best = projected(table.select("cell", F.slice("x", 1, n).alias("v")), c if done else vector[:, :width], np.zeros(n))
        best = materialised(best.withColumnRenamed("x", "u") if done else best)
        for gone in (*used, table):
            released(gone)
        if done:
            return centre + half * top, best
        start = best
    raise RuntimeError(f"residuals up to {half * float(np.sqrt(max(residual.max(), 0))):.2g} after {most_rounds} rounds")


def smallest_laplacian(edges: DataFrame, k: int, **options) -> tuple[np.ndarray, DataFrame]:
    """LIN08, LIN11: the k smallest eigenvalues of the symmetric normalised Laplacian, rising, and their vectors.

    Its eigenvalues lie in [0, 2], so 2 - L turns the smallest into the largest. ValueError for a node without edges
    can't occur: nodes are the edges' ends.
    """
    lap = materialised(laplacian(edges))
    nodes = lap.select(F.col("src").alias("cell")).distinct()
    value, basis = extreme_eigenpairs(lap, nodes, k, 2.0, -1.0, (0.0, 2.0), **options)
    return 2.0 - value, basis


def _strengthened(basis: DataFrame, strengths: DataFrame) -> tuple[float, DataFrame]:
    """(greatest strength, D^1/2 U) for strengths (cell, alpha) on the diagonal of D; a cell without a strength has 0."""
    ends = strengths.agg(F.min("alpha").alias("lo"), F.max("alpha").alias("hi")).first()
    if ends["lo"] is not None and not (ends["lo"] >= 0 and ends["hi"] < float("inf")):
        raise ValueError("strengths are finite and not negative")
    root = F.sqrt(F.coalesce("alpha", F.lit(0.0)))
    scaled = basis.join(strengths.select("cell", "alpha"), "cell", "left").select("cell", F.transform("u", lambda v: v * root).alias("u"))
    return ends["hi"] or 0.0, materialised(scaled)


def fused_basis(graphs: list[DataFrame], weights: list[float], alphas: list[float | DataFrame], k: int, **options) -> tuple[np.ndarray, DataFrame]:
    """LIN09, LIN10: the k smallest (algebraic) eigenpairs of sum w L - sum P; U is each graph's own basis and P its projection
    alpha U U^T, or D^1/2 U U^T D^1/2 for a strength of each cell, given as a table (cell, alpha) of one row a cell.

    The sum of projections stays factored, so nothing dense of the graph's size is made: strengths of cells scale the rows of
    U, and P's norm is at most the greatest of them. The matrix is indefinite; a shift by the bound 2 sum w turns its smallest
    eigenvalues into the largest ones.
    """
    bases = [smallest_laplacian(g, k, **options)[1] for g in graphs]
    by_cell = [_strengthened(u, a) if isinstance(a, DataFrame) else None for u, a in zip(bases, alphas, strict=True)]
    reach = sum(a if s is None else s[0] for a, s in zip(alphas, by_cell, strict=True))
    parts = [(a, u) if s is None else (1.0, s[1]) for a, u, s in zip(alphas, bases, by_cell, strict=True)]
    total = None
    for g, w in zip(graphs, weights, strict=True):
        part = laplacian(g).select("src", "dst", (F.col("weight") * w).alias("weight"))
        total = part if total is None else total.union(part)
    total = materialised(total.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    nodes = total.select(F.col("src").alias("cell")).distinct()
    top = 2.0 * sum(weights)
    value, basis = extreme_eigenpairs(total, nodes, k, top, -1.0, (0.0, top + reach), low_rank=parts, **options)
    return top - value, basis


def denoised(basis: DataFrame, gains: np.ndarray, values: DataFrame) -> DataFrame:
    """LIN12: V g V^T X over (cell, gene, value), negatives become 0: two join-aggregates over (cell, k, v)."""
    long = basis.select("cell", F.posexplode("u").alias("k", "v"))
    gain = F.array(*[F.lit(float(g)) for g in gains])
    coefficients = long.join(values, "cell").groupBy("k", "gene").agg(F.sum(F.col("v") * F.col("value")).alias("c"))
    coefficients = coefficients.select("k", "gene", (F.col("c") * gain[F.col("k")]).alias("c"))
    back = long.join(coefficients, "k").groupBy("cell", "gene").agg(F.sum(F.col("v") * F.col("c")).alias("value"))
    return back.withColumn("value", F.greatest("value", F.lit(0.0)))


def filtered(basis: DataFrame, gains: DataFrame, values: DataFrame, remove_constant: bool = True, add_constant: bool = False) -> DataFrame:
    """LIN13, LIN15: V (g * V^T X) over (cell, gene, value) with the gains (k, gain) of a filter or, with a column gene,
    of one filter for each gene. The basis is in order of rising eigenvalues; its first vector is the constant part,
    which remove_constant takes out before the filter and add_constant puts back after it. k without a gain gives 0."""
    long = basis.select("cell", F.posexplode("u").alias("k", "v"))
    coefficients = long.join(values, "cell").groupBy("k", "gene").agg(F.sum(F.col("v") * F.col("value")).alias("c"))
    kept = coefficients.where("k > 0") if remove_constant else coefficients
    kept = kept.join(gains, ["k", "gene"] if "gene" in gains.columns else "k").select("k", "gene", (F.col("c") * F.col("gain")).alias("c"))
    if remove_constant and add_constant:
        kept = kept.union(coefficients.where("k = 0").select("k", "gene", "c"))
    return long.join(kept, "k").groupBy("cell", "gene").agg(F.sum(F.col("v") * F.col("c")).alias("value"))


def gene_filtered(lap: DataFrame, basis: DataFrame, lam: np.ndarray, values: DataFrame, beta_min: float = 1.0, beta_max: float = 10.0) -> DataFrame:
    """LIN15: (cell, gene, value): each gene filtered by exp(-beta lambda / largest lambda), the smoother the gene the more.

    lap: (src, dst, weight) of the Laplacian, diagonal included; basis: (cell, u) and lam its eigenvalues, rising; values: (cell,
    gene, value), absent rows being zeros. The constant part, along the first vector, is taken out and stays out. A gene's
    roughness is x^T L x / (|x|^2 + 1e-8) of what is left; beta falls from beta_max for the smoothest gene to beta_min for
    the roughest. The result has a row for every cell and gene, as has the part that is left.
    """
    first = basis.select("cell", F.col("u")[0].alias("v"))
    along = first.join(values, "cell").groupBy("gene").agg(F.sum(F.col("v") * F.col("value")).alias("c"))
    grid = first.crossJoin(F.broadcast(along)).join(values, ["cell", "gene"], "left")  # a row of along is a gene
    left = materialised(grid.select("cell", "gene", (F.coalesce("value", F.lit(0.0)) - F.col("v") * F.col("c")).alias("value")))
    ends = [left.select(F.col("cell").alias(c), "gene", F.col("value").alias(x)) for c, x in (("src", "a"), ("dst", "b"))]
    form = lap.join(ends[0], "src").join(ends[1], ["dst", "gene"]).groupBy("gene").agg(F.sum(F.col("weight") * F.col("a") * F.col("b")).alias("form"))
    size = left.groupBy("gene").agg(F.sum(F.col("value") * F.col("value")).alias("size"))
    rough = materialised(size.join(form, "gene", "left").select("gene", (F.coalesce("form", F.lit(0.0)) / (F.col("size") + 1e-8)).alias("r")))
    ends = F.broadcast(rough.agg(F.min("r").alias("low"), F.max("r").alias("high")))
    beta = rough.join(ends).select("gene", (beta_max - (F.col("r") - F.col("low")) / (F.col("high") - F.col("low") + 1e-8) * (beta_max - beta_min)).alias("beta"))
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(x / max(lam.max(), 1e-300))).alias("l")) for k, x in enumerate(lam) if k]))
    gains = beta.select("gene", "beta", steps.alias("s")).select("gene", "s.k", F.exp(-F.col("s.l") * F.col("beta")).alias("gain"))
    return filtered(basis, gains, values)


def singular_values(vectors: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(falling singular values, right singular vectors as columns) of rows (cell, v), at most `most` of them, from the
    products of columns; columns are genes, some thousands, whose products the driver holds."""
    lam, vec = np.linalg.eigh(gram(vectors, "v"))
    order = np.argsort(-lam)[:most]
    return np.sqrt(np.maximum(lam[order], 0)), vec[:, order]


def chosen_rank(values: np.ndarray, noise_start: int = 80, deviations: float = 6.0) -> int:
    """LIN04: the last place where the gap to the next singular value lies more than `deviations` above the gaps of the
    noise, which begins at the noise_start-th value. ValueError with fewer than five values of noise or no such place."""
    if noise_start > len(values) - 5:
        raise ValueError("at least five singular values have to be noise")
    gaps = values[:-1] - values[1:]
    noise = gaps[noise_start - 2 :]
    above = np.flatnonzero((gaps - noise.mean()) / noise.std(ddof=1) > deviations)
    if not len(above):
        raise ValueError("no gap stands out from the noise")
    return int(above[-1]) + 1


def low_rank(vectors: DataFrame, vec: np.ndarray, genes: list) -> DataFrame:
    """LIN05: (cell, gene, value): rows (cell, v) projected on the columns of vec, for every gene."""
    spark, kind = vectors.sparkSession, "string" if genes and isinstance(genes[0], str) else "long"
    places = F.broadcast(spark.createDataFrame(list(enumerate(genes)), f"at int, gene {kind}"))
    rows = projected(vectors, vec @ vec.T, np.zeros(len(vec)))
    return rows.select("cell", F.posexplode("x").alias("at", "value")).join(places, "at").select("cell", "gene", "value")


def subspace_distance(first: DataFrame, second: DataFrame) -> float:
    """LIN17: projection distance sqrt(k - |U1^T U2|^2) of two orthonormal bases (cell, u)."""
    small = gram(first.select("cell", F.col("u").alias("a")).join(second.select("cell", F.col("u").alias("b")), "cell"), "a", "b")
    return float(np.sqrt(max(len(small) - (small**2).sum(), 0.0)))


def principal_components(vectors: DataFrame, d: int, oversample: int = 20, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """LIN01, LIN03, LIN18: (cell, x): vectors (cell, v) projected on their first d components, and the share of the
    variance each explains. Each component's largest entry is positive.

    Up to 256 columns the covariance is a sum over rows. Beyond, a randomised range finder (Halko et al., 2011) multiplies
    it `rounds` times with a block of d + oversample columns; nothing of columns x columns is made, and what is broadcast
    or collected has columns x (d + oversample) numbers.
    """
    width = len(vectors.select("v").first()["v"])
    sums = gram(vectors.select(F.concat(F.array(F.lit(1.0)), "v").alias("v"), F.array(F.lit(1.0)).alias("one")), "v", "one")[:, 0]
    n, mean = sums[0], sums[1:] / sums[0]
    if width <= 256:
        lam, vec = np.linalg.eigh(gram(vectors, "v") / n - np.outer(mean, mean))
        spread = lam.sum()
    else:
        vec = np.linalg.qr(np.random.default_rng(0).normal(size=(width, min(d + oversample, width))))[0]
        for _ in range(rounds):
            moved = _covariance_times(vectors, vec, mean) / n
            vec = np.linalg.qr(moved)[0]
        small = vec.T @ (_covariance_times(vectors, vec, mean) / n)
        lam, inner = np.linalg.eigh((small + small.T) / 2)
        vec = vec @ inner
        squares = vectors.select(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("s")).agg(F.sum("s")).first()[0]
        spread = squares / n - mean @ mean
    order = np.argsort(-lam)[: min(d, width)]
    vec = vec[:, order]
    vec = vec * np.sign(vec[np.abs(vec).argmax(0), np.arange(vec.shape[1])])
    return projected(vectors, vec, mean), np.maximum(lam[order], 0) / max(spread, 1e-300)


def _covariance_times(vectors: DataFrame, block: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Sum over rows of (v - mean) ((v - mean)^T block): partial sums of columns x block width per partition."""
    given = vectors.sparkSession.sparkContext.broadcast((block, mean))

    def run(batches):
        import pandas as pd

        m, o = given.value
        total = np.zeros_like(m)
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()) - o
                total += x.T @ (x @ m)
        yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    width = block.shape[1]
    parts = vectors.select("v").mapInPandas(run, "i long, row array<double>")
    found = parts.groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"s{j}") for j in range(width)]).toPandas().sort_values("i")
    return found[[f"s{j}" for j in range(width)]].to_numpy()
