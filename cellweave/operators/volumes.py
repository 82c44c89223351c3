"""Voxel tables (fov, z, y, x, value): box sums, regional maxima, tiles, crops, mosaics, and spots moved by a flow."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.sources.shared import materialised, released

PLACE = ("fov", "z", "y", "x")


def _around(reach: tuple[int, int, int], self_too: bool) -> Column:
    """All places within `reach` of a voxel, along each axis."""
    steps = [d for d in product(*[range(-r, r + 1) for r in reach]) if self_too or any(d)]
    return F.explode(F.array(*[F.struct(*[(F.col(c) + i).alias(c) for c, i in zip(PLACE[1:], d, strict=True)]) for d in steps]))


def box_sums(spots: DataFrame, voxels: DataFrame, reach: tuple[int, int, int] = (0, 1, 1)) -> DataFrame:
    """ARR05, JON14: (spot, total, inside): sums over a box around each spot (spot, fov, z, y, x) and how many of its voxels
    there are; what lies outside counts as 0."""
    wanted = spots.select("spot", "fov", _around(reach, True).alias("b")).select("spot", "fov", "b.*")
    joined = wanted.join(voxels, list(PLACE), "left").groupBy("spot")
    return joined.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), F.count("value").alias("inside"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, group): the least node in reach of each node of undirected edges (a, b); labels fall along edges, and each node also
    takes its label's label, so a chain of n nodes needs about log n steps."""
    both = materialised(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    now = materialised(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("group")))
    while True:
        low = both.join(now.select(F.col("node").alias("b"), "group"), "b").groupBy(F.col("a").alias("node")).agg(F.min("group").alias("low"))
        step = now.join(low, "node").select("node", "group", F.least("group", "low").alias("next"))
        jump = now.select(F.col("node").alias("next"), F.col("group").alias("root"))
        after = materialised(step.join(jump, "next").select("node", "group", F.least("next", "root").alias("after")))
        still = after.where("group <> after").isEmpty()
        released(now)
        now = after.select("node", F.col("after").alias("group"))
        now._materialised_at = after._materialised_at
        if still:
            return now


def regional_maxima(voxels: DataFrame, threshold: float) -> DataFrame:
    """IMG21: (fov, z, y, x, intensity, voxels): 26-connected plateaus of equal values over `threshold` with no larger neighbour,
    each by the centroid of its voxels. Plateaus may touch the border.

    Only voxels over the threshold are joined: a neighbour that is larger or equal is one too.
    """
    bright = materialised(voxels.where(F.col("value") > threshold).select(*PLACE, "value", F.struct(*PLACE).alias("at")))
    near = bright.select("fov", _around((1, 1, 1), False).alias("b"), F.col("value").alias("near"), F.col("at").alias("of")).select("fov", "b.*", "near", "of")
    pairs = materialised(bright.join(near, list(PLACE)).where("near >= value").select("at", "of", (F.col("near") > F.col("value")).alias("larger")))
    beaten = pairs.where("larger").select("at").distinct()
    groups = connected(pairs.where("not larger").select(F.col("at").alias("a"), F.col("of").alias("b")))
    rows = bright.join(groups.withColumnRenamed("node", "at"), "at", "left").withColumn("group", F.coalesce("group", "at"))
    rows = rows.join(beaten.withColumn("beaten", F.lit(True)), "at", "left")
    found = rows.groupBy("fov", "group").agg(*[F.avg(c).alias(c) for c in PLACE[1:]], F.max("value").alias("intensity"), F.count(F.lit(1)).alias("voxels"), F.count("beaten").alias("beaten"))
    return found.where("beaten = 0").select(*PLACE, "intensity", "voxels")


def brightest_tile(voxels: DataFrame, size: int) -> DataFrame:
    """IMG19: (fov, ty, tx, total) of each volume's size x size tile with the largest sum, the first on ties."""
    sums = voxels.groupBy("fov", F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx")).agg(F.sum("value").alias("total"))
    return sums.groupBy("fov").agg(F.max(F.struct(F.round("total", 6).alias("r"), (-F.col("tx")).alias("tx"), (-F.col("ty")).alias("ty"), "total")).alias("b")).select("fov", (-F.col("b.ty")).alias("ty"), (-F.col("b.tx")).alias("tx"), F.col("b.total").alias("total"))


def crop_correlation(first: DataFrame, second: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """IMG18: (fov, correlation, voxels) of two volumes over the voxels of both within [low, high] of each axis; without any, the
    correlation is null."""
    inside = [F.col(c).between(a, b) for c, a, b in zip(PLACE[1:], low, high, strict=True)]
    both = first.where(inside[0] & inside[1] & inside[2]).join(second.withColumnRenamed("value", "other"), list(PLACE))
    found = both.groupBy("fov").agg(F.corr("value", "other").alias("correlation"), F.count(F.lit(1)).alias("voxels"))
    return first.select("fov").distinct().join(found, "fov", "left").fillna(0, ["voxels"])


def mosaic(tiles: DataFrame, offsets: DataFrame, mode: str = "max") -> DataFrame:
    """IMG27: (z, y, x, value) of volumes put at whole offsets (fov, dz, dy, dx): where they overlap the largest value ("max"), the
    mean ("mean"), or that of the last fov ("overwrite")."""
    placed = tiles.join(offsets, "fov").select("fov", *[(F.col(c) + F.col(f"d{c}")).alias(c) for c in PLACE[1:]], "value").groupBy(*PLACE[1:])
    value = {"max": F.max("value"), "mean": F.avg("value"), "overwrite": F.max(F.struct("fov", "value"))["value"]}
    if mode not in value:
        raise ValueError(f"mode is one of {sorted(value)}")
    return placed.agg(value[mode].alias("value"))


def moved_spots(spots: DataFrame, flow: DataFrame, shape: tuple[int, int, int], sign: int = 1) -> DataFrame:
    """IMG23: spots (fov, z, y, x, ...) moved by the flow (fov, z, y, x, dz, dy, dx) at their nearest voxel, 0 where there is none,
    and held within the shape. A flow of one row for a fov, with null z, y and x, moves all its spots alike."""
    near = lambda c, n: F.least(F.greatest(F.floor(F.col(c) + 0.5), F.lit(0)), F.lit(n - 1)).cast("long")
    whole = flow.where("z is null").select("fov", *[F.col(f"d{c}").alias(f"w{c}") for c in PLACE[1:]])
    field = flow.where("z is not null").select("fov", *[F.col(c).cast("long").alias(f"n{c}") for c in PLACE[1:]], *[f"d{c}" for c in PLACE[1:]])
    at = spots.withColumns({f"n{c}": near(c, n) for c, n in zip(PLACE[1:], shape, strict=True)})
    joined = at.join(field, ["fov", "nz", "ny", "nx"], "left").join(F.broadcast(whole), "fov", "left")  # one row a fov
    new = {c: F.least(F.greatest(F.col(c) + sign * F.coalesce(f"d{c}", f"w{c}", F.lit(0.0)), F.lit(0.0)), F.lit(float(n - 1))) for c, n in zip(PLACE[1:], shape, strict=True)}
    return joined.withColumns(new).select(*spots.columns)
