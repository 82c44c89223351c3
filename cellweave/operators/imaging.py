"""Image slices as rows: (fov, round, channel, z, height, width, data array<double>), processed by named steps.

A slice is bounded by the camera, so a row is a bounded unit of work: slices are spread over tasks by Spark, and each step
is a NumPy function of one slice. Steps that need another slice (a histogram reference, a registration partner) get it
by a join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["fov", "round", "channel", "z"]


def _windows(img: np.ndarray, size: int, mode: str = "reflect") -> np.ndarray:
    half = size // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(img, half, mode=mode), (size, size))


def median(img, size: int = 3):
    """IMG01: odd window, reflected border."""
    if size % 2 == 0:
        raise ValueError("the window is odd")
    return np.median(_windows(img, size, "symmetric"), axis=(2, 3))


def gaussian(img, sigma: float = 1.0):
    """IMG02: separable convolution, four sigma wide, reflected border."""
    half = int(4 * sigma + 0.5)
    x = np.arange(-half, half + 1)
    kernel = np.exp(-x * x / (2 * sigma * sigma))
    kernel /= kernel.sum()
    for axis in (0, 1):
        pad = [(half, half) if a == axis else (0, 0) for a in (0, 1)]
        img = np.lib.stride_tricks.sliding_window_view(np.pad(img, pad, mode="symmetric"), 2 * half + 1, axis=axis) @ kernel
    return img


def gamma(img, value: float = 0.5):
    """IMG04"""
    return np.maximum(img, 0) ** value


def difference_of_gaussians(img, low: float = 1.0, high: float = 2.0):
    """IMG05: not below 0."""
    return np.maximum(gaussian(img, low) - gaussian(img, high), 0)


def min_max(img, top: float = 255.0):
    """IMG09: a flat slice becomes 0."""
    low, high = img.min(), img.max()
    return (img - low) / (high - low) * top if high > low else np.zeros_like(img)


def top_hat(img, size: int = 5):
    """IMG08: plus the white and minus the black top-hat, not below 0."""
    erode = lambda a: _windows(a, size, "edge").min((2, 3))
    dilate = lambda a: _windows(a, size, "edge").max((2, 3))
    return np.maximum(img + (img - dilate(erode(img))) - (erode(dilate(img)) - img), 0)


def equalise(img, tiles: int = 2, clip: float = 0.05, bins: int = 64):
    """IMG07: contrast-limited equalisation by tiles, with bilinear blending between the tiles' maps."""
    low, high = img.min(), img.max()
    if high <= low:
        return np.zeros_like(img)
    code = np.minimum(((img - low) / (high - low) * bins).astype(int), bins - 1)
    rows, cols = (np.array_split(np.arange(n), tiles) for n in img.shape)
    maps = np.empty((tiles, tiles, bins))
    for i, r in enumerate(rows):
        for j, c in enumerate(cols):
            h = np.bincount(code[np.ix_(r, c)].ravel(), minlength=bins) / (len(r) * len(c))
            extra = np.maximum(h - clip, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(h, clip) + extra / bins)
    at = [np.clip((np.arange(n) + 0.5) / n * tiles - 0.5, 0, tiles - 1) for n in img.shape]
    y0, x0 = (np.minimum(a.astype(int), tiles - 2) if tiles > 1 else a.astype(int) for a in at)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = (at[0] - y0)[:, None], (at[1] - x0)[None]
    pick = lambda y, x: maps[y[:, None], x[None], code]
    return (1 - fy) * ((1 - fx) * pick(y0, x0) + fx * pick(y0, x1)) + fy * ((1 - fx) * pick(y1, x0) + fx * pick(y1, x1))


#: IMG10: steps by name, each a function of a slice and its parameters.
STEPS: dict[str, Callable] = {
    "none": lambda img: img, "median": median, "gaussian": gaussian, "gamma": gamma, "difference_of_gaussians": difference_of_gaussians,
    "min_max": min_max, "top_hat": top_hat, "equalise": equalise,
}


def process(slices: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """IMG10, IMG11: slices after the named steps; ValueError for an unknown name."""
    if unknown := {n for n, _ in steps} - set(STEPS):
        raise ValueError(f"no steps {sorted(unknown)}")

    def run(batches):
        for batch in batches:
            out = []
            for data, h, w in zip(batch["data"], batch["height"], batch["width"], strict=True):
                img = np.asarray(data, float).reshape(h, w)
                for name, options in steps:
                    img = STEPS[name](img, **options)
                out.append(img.ravel())
            batch["data"] = out
            yield batch

    return slices.mapInPandas(run, slices.schema)


def clipped(slices: DataFrame, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """IMG06: values between two quantiles of the whole volume (fov, round, channel), from the slices' counts of values."""
    volume = KEYS[:3]

    def counted(batches):
        for batch in batches:
            for *key, data in zip(*(batch[c] for c in (*volume, "data")), strict=True):
                v, c = np.unique(np.asarray(data, float), return_counts=True)
                yield pd.DataFrame({**{name: [x] * len(v) for name, x in zip(volume, key, strict=True)}, "v": v, "c": c})

    schema = slices.select(*volume, F.lit(0.0).alias("v"), F.lit(0).cast("long").alias("c")).schema
    counts = slices.select(*volume, "data").mapInPandas(counted, schema).groupBy(*volume, "v").agg(F.sum("c").alias("c"))
    bounds = counts.groupBy(*volume).agg(F.percentile("v", F.array(F.lit(low), F.lit(high)), F.col("c")).alias("q"))
    joined = slices.join(bounds, volume)
    return joined.withColumn("data", F.transform("data", lambda v: F.least(F.greatest(v, F.col("q")[0]), F.col("q")[1]))).select(*slices.columns)


def matched(slices: DataFrame, reference: DataFrame) -> DataFrame:
    """IMG03: each slice's values mapped to the distribution of the reference slice of its (fov, channel, z); a slice
    without one stays as it is. reference: (fov, channel, z, data)."""
    joined = slices.join(reference.select("fov", "channel", "z", F.col("data").alias("ref")), ["fov", "channel", "z"], "left").select(*slices.columns, "ref")

    def run(batches):
        for batch in batches:
            out = []
            for data, ref in zip(batch["data"], batch["ref"], strict=True):
                x = np.asarray(data, float)
                if ref is not None:
                    value, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
                    rv, rn = np.unique(np.asarray(ref, float), return_counts=True)
                    x = np.interp(np.cumsum(n) / len(x), np.cumsum(rn) / rn.sum(), rv)[inverse]
                out.append(x)
            batch["data"] = out
            yield batch.drop(columns="ref")

    return joined.mapInPandas(run, slices.schema)


def shifts(fixed: DataFrame, moving: DataFrame) -> DataFrame:
    """IMG12, IMG26: (keys, dy, dx, peak) by phase correlation of slices with equal (fov, channel, z), whole pixels."""
    keys = ["fov", "channel", "z"]
    joined = fixed.select(*keys, "height", "width", F.col("data").alias("a")).join(moving.select(*keys, F.col("round").alias("round"), F.col("data").alias("b")), keys)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                a, b = (np.fft.fft2(np.asarray(x, float).reshape(r.height, r.width)) for x in (r.a, r.b))
                cross = a * np.conj(b)
                corr = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
                y, x = np.unravel_index(int(corr.argmax()), corr.shape)
                rows.append((r.fov, r.channel, r.z, r.round, int(y) - r.height * (y > r.height // 2), int(x) - r.width * (x > r.width // 2), float(corr.max())))
            yield pd.DataFrame(rows, columns=[*keys, "round", "dy", "dx", "peak"])

    return joined.mapInPandas(run, "fov long, channel int, z int, round int, dy long, dx long, peak double")


def shifted(slices: DataFrame, by: DataFrame) -> DataFrame:
    """IMG13, IMG17, IMG24: slices moved by (fov, round, dy, dx) in fractions of pixels, linear, zeros from outside."""
    joined = slices.join(by.select("fov", "round", F.col("dy").cast("double").alias("dy"), F.col("dx").cast("double").alias("dx")), ["fov", "round"])

    columns = slices.columns

    def move(img, d, axis):
        whole, part = int(np.floor(d)), d - np.floor(d)
        out = np.zeros_like(img)
        for k, f in ((whole, 1 - part), (whole + 1, part)):
            if f and abs(k) < img.shape[axis]:
                rolled = np.roll(img, k, axis)
                edge = [slice(None)] * 2
                edge[axis] = slice(0, k) if k > 0 else slice(img.shape[axis] + k, None)
                if k:
                    rolled[tuple(edge)] = 0
                out = out + f * rolled
        return out

    def run(batches):
        for batch in batches:
            batch["data"] = [move(move(np.asarray(r.data, float).reshape(r.height, r.width), r.dy, 0), r.dx, 1).ravel() for r in batch.itertuples()]
            yield batch[columns]

    return joined.mapInPandas(run, slices.schema)


def projection(slices: DataFrame, held: int = 64) -> DataFrame:
    """AGG35: maximum over z of each volume: (fov, round, channel, height, width, data).

    Slices are reduced as arrays in each task, which holds at most `held` volumes, and once more where a volume's parts meet."""
    keys = ["fov", "round", "channel", "height", "width"]
    rows = slices.select(*keys, "data")

    def frame(best: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, v) for k, v in best.items()], columns=[*keys, "data"])

    def reduced(batches):
        best: dict = {}
        for batch in batches:
            for *key, data in batch.itertuples(index=False):
                key, data = tuple(key), np.asarray(data)
                best[key] = np.maximum(best[key], data) if key in best else data
                if len(best) > held:
                    yield frame(best)
                    best = {}
        yield frame(best)

    def met(parts: pd.DataFrame) -> pd.DataFrame:
        return parts.iloc[:1].assign(data=[np.maximum.reduce(np.stack(parts["data"].to_numpy()))])

    return rows.mapInPandas(reduced, rows.schema).groupBy(*keys).applyInPandas(met, rows.schema)
