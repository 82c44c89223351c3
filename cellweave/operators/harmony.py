"""Batch correction by soft clusters that mix batches (Harmony, Korsunsky et al. 2019) over (cell, batch, v)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.sources.shared import materialised, released

SAMPLE_ROWS = 4000


@dataclass
class Clusters:
    """Unit centres (k x width), what each cluster holds of each batch (k x batches), the batches' shares, and the constants."""

    centres: np.ndarray
    held: np.ndarray | None
    shares: np.ndarray
    theta: float
    sigma: float


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-300)


def memberships(z: np.ndarray, batch: np.ndarray, model: Clusters) -> np.ndarray:
    """Soft clusters of each row: exp(-2 (1 - cosine) / sigma), times ((expected + 1) / (held + 1))^theta of the row's batch in the
    cluster where that is known, made to sum to 1."""
    log = -2 * (1 - _units(z) @ model.centres.T) / model.sigma
    if model.held is not None:
        expected = model.held.sum(1)[:, None] * model.shares[None]
        log = log + model.theta * np.log((expected + 1) / (model.held + 1)).T[batch]
    r = np.exp(log - log.max(1, keepdims=True))
    return r / r.sum(1, keepdims=True)


def shifts(mass: np.ndarray, sums: np.ndarray, ridge: float) -> np.ndarray:
    """What to take off: (k, batches, width), by a ridge regression of each cluster on an intercept and the batches, of which the
    intercept stays. mass: k x batches; sums: k x batches x width, of the uncorrected vectors."""
    out = np.zeros_like(sums)
    for k, (n, s) in enumerate(zip(mass, sums, strict=True)):
        left = np.diag(np.concatenate([[n.sum()], n + ridge]))
        left[0, 1:] = left[1:, 0] = n
        out[k] = np.linalg.lstsq(left, np.concatenate([s.sum(0)[None], s]), rcond=None)[0][1:]
    return out


def _sums(state: DataFrame, model: Clusters) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Over all cells: held (k x batches), unit vectors (k x width), uncorrected vectors (k x batches x width), objective."""
    given = state.sparkSession.sparkContext.broadcast(model)
    k, batches, width = len(model.centres), len(model.shares), model.centres.shape[1]

    def run(rows):
        held, unit, sums, cost = np.zeros((k, batches)), np.zeros((k, width)), np.zeros((k, batches, width)), 0.0
        for part in rows:
            if len(part):
                z, raw, batch = np.stack(part["z"].to_numpy()), np.stack(part["v"].to_numpy()), part["b"].to_numpy()
                r = memberships(z, batch, given.value)
                unit += r.T @ _units(z)
                for b in np.unique(batch):
                    held[:, b] += r[batch == b].sum(0)
                    sums[:, b] += r[batch == b].T @ raw[batch == b]
                cost += (r * (2 * (1 - _units(z) @ given.value.centres.T) + given.value.sigma * np.log(np.maximum(r, 1e-300)))).sum()
        yield pd.DataFrame({"part": np.arange(k), "g": [np.concatenate([[cost if c == 0 else 0.0], held[c], unit[c], sums[c].ravel()]) for c in range(k)]})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": rows["part"].iloc[:1], "g": [np.sum(np.stack(rows["g"].to_numpy()), axis=0)]})

    told = state.select("z", "v", "b").mapInPandas(run, "part int, g array<double>").groupBy("part").applyInPandas(added, "part int, g array<double>").toPandas().sort_values("part")
    flat = np.stack(told["g"].to_numpy())
    return flat[:, 1 : 1 + batches], flat[:, 1 + batches : 1 + batches + width], flat[:, 1 + batches + width :].reshape(k, batches, width), float(flat[:, 0].sum())


def _start(state: DataFrame, n: int, k: int) -> np.ndarray:
    """Unit centres: k-means over a sample of about SAMPLE_ROWS cells by a hash, from rows far from each other."""
    some = state if n <= SAMPLE_ROWS else state.where(F.pmod(F.xxhash64("cell"), F.lit(1 << 30)) < (1 << 30) * SAMPLE_ROWS / n)
    x = _units(np.array([r["z"] for r in some.orderBy("cell").limit(2 * SAMPLE_ROWS).collect()]))
    means = [x[0]]
    for _ in range(k - 1):
        means.append(x[(x @ np.array(means).T).max(1).argmin()])
    means = np.array(means)
    for _ in range(10):
        near = (x @ means.T).argmax(1)
        means = _units(np.stack([x[near == c].mean(0) if (near == c).any() else means[c] for c in range(len(means))]))
    return means


def corrected(
    points: DataFrame, clusters: int | None = None, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, rounds: int = 10,
    cluster_rounds: int = 20, tolerance: float = 1e-4,
) -> DataFrame:
    """MDL11: (cell, batch, v): vectors from which the batches' shifts within soft clusters were taken.

    A round finds soft clusters of the vectors so far, with a penalty for clusters in which a batch has more than its share,
    until their objective changes by less than `tolerance`; then each cluster's shift of each batch is a ridge regression on
    the first vectors, and each cell loses the shifts of its batch, weighted by its memberships. Rounds end when the vectors
    move by less than `tolerance` of their length. A step is one pass that sums memberships, vectors and their products by
    cluster and batch: clusters x batches x columns are what the driver holds. Clusters: cells / 30, at most 100, unless
    given. All cells of a cluster and batch move alike in proportion to their membership, so repeated rows stay equal.
    """
    names = [r[0] for r in points.select("batch").distinct().orderBy("batch").collect()]  # one row a batch
    number = F.array_position(F.array(*[F.lit(b) for b in names]), F.col("batch")).cast("int") - 1
    if not names:
        return points.select("cell", "batch", "v")
    state = materialised(points.select("cell", "batch", F.col("v").cast("array<double>").alias("v"), number.alias("b")).withColumn("z", F.col("v")))
    counts = {r["b"]: r["count"] for r in state.groupBy("b").count().collect()}
    n = sum(counts.values())
    shares = np.array([counts[b] / n for b in range(len(names))])
    k = clusters or max(1, min(100, n // 30))
    for _ in range(rounds):
        model = Clusters(_start(state, n, k), None, shares, theta, sigma)
        k = len(model.centres)
        before = np.inf
        for _ in range(cluster_rounds):
            held, unit, sums, cost = _sums(state, model)
            cost += sigma * theta * (held * np.log((held + 1) / (held.sum(1)[:, None] * shares[None] + 1))).sum()
            mixed = held if model.held is None else (held + model.held) / 2  # all cells move at once: half a step keeps it from swinging
            if abs(before - cost) < tolerance * abs(cost):
                break
            before, model = cost, Clusters(_units(unit), mixed, shares, theta, sigma)
        held, _, sums, _ = _sums(state, model)
        after = materialised(_moved(state, model, shifts(held, sums, ridge)))
        change = after.agg(F.sqrt(F.sum("gap") / F.sum("size")).alias("c")).first()["c"]
        released(state)
        state = after.drop("gap", "size")
        state._materialised_at = after._materialised_at
        if change is None or change < tolerance:
            break
    return state.select("cell", "batch", F.col("z").alias("v"))


def _moved(state: DataFrame, model: Clusters, shift: np.ndarray) -> DataFrame:
    given = state.sparkSession.sparkContext.broadcast((model, shift))

    def run(rows):
        model, shift = given.value
        for part in rows:
            if len(part):
                z, raw, batch = np.stack(part["z"].to_numpy()), np.stack(part["v"].to_numpy()), part["b"].to_numpy()
                r = memberships(z, batch, model)
                new = raw.copy()
                for b in np.unique(batch):
                    new[batch == b] -= r[batch == b] @ shift[:, b]
                yield part.assign(z=list(new), gap=((new - z) ** 2).sum(1), size=(z**2).sum(1))

    schema = state.select("*", F.lit(0.0).alias("gap"), F.lit(0.0).alias("size")).schema
    return state.mapInPandas(run, schema)
