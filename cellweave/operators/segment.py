"""Cells from reads (MDL16): composition of each read's neighbourhood, density, nearest denser read, and the trees these make.

Reads are (read, section, x, y, z, gene). All work is by joins on grid bins within a section, so nothing is cut into tiles and
nothing has to be stitched: a read's cell does not depend on how the section is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.sources.shared import materialised, released

#: Similarities are whole parts of this, so that sums of them do not depend on their order.
PARTS = 1_000_000
_AXES = ("x", "y", "z")


def _bins(radius: float, offsets: tuple[int, int, int] = (0, 0, 0)) -> list[Column]:
    wide = radius * (1 + 1e-9)  # so that rounding can't put two points a radius apart two bins apart
    return [(F.floor(F.col(c) / wide) + o).alias(f"b{c}") for c, o in zip(_AXES, offsets, strict=True)]


def _meeting(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs of rows of a and b, whose other columns differ in name, of one section at most `radius` apart, and their `apart`.

    a stands in its own bin of the grid, b is copied to the 27 around it."""
    around = F.array(*[F.struct(*_bins(radius, (i, j, k))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    left = a.select("*", *_bins(radius))
    right = b.withColumn("_b", F.explode(around)).select(*[F.col(c).alias(f"{c}2") for c in _AXES], *[c for c in b.columns if c not in _AXES], "_b.*")
    gap = lambda c: (F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2"))
    met = left.join(right, ["section", "bx", "by", "bz"]).withColumn("apart", F.sqrt(gap("x") + gap("y") + gap("z")))
    return met.where(F.col("apart") <= radius).drop("bx", "by", "bz", *[f"{c}2" for c in _AXES])


def _whole() -> Column:
    ok = F.col("read").isNotNull() & F.col("section").isNotNull() & F.col("gene").isNotNull()
    for c in _AXES:
        ok = ok & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))  # NaN counts as greater
    return ok


def usable(reads: DataFrame, flatten: float = 1.0) -> DataFrame:
    """(read, section, x, y, z, gene) with a place and a gene; z times `flatten`, the radius in the plane over that in depth.

    Reads without a finite place or without a gene are left out here, and get cell -1 in segmented()."""
    at = lambda c: F.col(c).cast("double")
    return reads.where(_whole()).select("read", "section", at("x").alias("x"), at("y").alias("y"), (at("z") * flatten).alias("z"), "gene")


def compositions(reads: DataFrame, radius: float) -> DataFrame:
    """(read, gene, n): how many reads of each gene lie within `radius` of a read, itself included.

    Reads of one place are counted before the join, so that a heap of reads on a pixel is one row for each gene."""
    return _places(reads, radius).join(reads.drop("gene"), ["section", *_AXES]).select("read", "gene", "n")


def _places(reads: DataFrame, radius: float) -> DataFrame:
    heaps = reads.groupBy("section", *_AXES, "gene").agg(F.count(F.lit(1)).alias("n"))
    spots = heaps.select("section", *_AXES).distinct()
    return _meeting(spots, heaps, radius).groupBy("section", *_AXES, "gene").agg(F.sum("n").alias("n"))


def profiles(reads: DataFrame, radius: float) -> DataFrame:
    """(section, x, y, z, n, genes, counts, norm): each distinct place with its reads n, the composition around it as arrays
    sorted by gene, and the sum of the counts' squares."""
    entry = F.array_sort(F.collect_list(F.struct("gene", "n")))
    around = _places(reads, radius).groupBy("section", *_AXES).agg(entry.alias("e"), F.sum(F.col("n") * F.col("n")).alias("norm"))
    own = reads.groupBy("section", *_AXES).agg(F.count(F.lit(1)).alias("n"))
    return around.join(own, ["section", *_AXES]).select("section", *_AXES, "n", F.col("e.gene").alias("genes"), F.col("e.n").alias("counts"), "norm")


def _alike() -> Column:
    """Cosine of two compositions (genes, counts, norm) and (of2, norm2), in whole parts of PARTS, rounded down."""
    dot = F.aggregate(F.zip_with("genes", "counts", lambda g, n: n * F.coalesce(F.col("of2")[g], F.lit(0))), F.lit(0).cast("long"), lambda s, v: s + v)
    return F.floor(F.lit(float(PARTS)) * dot / F.sqrt(F.col("norm").cast("double") * F.col("norm2").cast("double")))


def _others(places: DataFrame, *more: str) -> DataFrame:
    return places.select("section", *_AXES, F.map_from_arrays("genes", "counts").alias("of2"), F.col("norm").alias("norm2"), *[F.col(c).alias(f"{c}2") for c in more])


def densities(places: DataFrame, radius: float) -> DataFrame:
    """places of profiles() and their density: over all reads within `radius`, own place included, the sum of the cosine of
    their compositions with the own one, in millionths."""
    met = _meeting(places.drop("n"), _others(places, "n"), radius).select("section", *_AXES, (_alike() * F.col("n2")).alias("part"))
    return places.join(met.groupBy("section", *_AXES).agg(F.sum("part").alias("density")), ["section", *_AXES])


def denser(places: DataFrame, radius: float, reach: float, unlike: float = 1.0) -> DataFrame:
    """(place, parent, gap): for each of places (place, section, x, y, z, density, genes, counts, norm) the nearest denser one,
    at a distance of at most `reach`; null and null for a peak.

    Of two equal densities the smaller place id counts as denser. The distance is that in space times 1 + unlike * (1 -
    cosine of the compositions), ties by id. Since it is never below that in space, a partner found at most r away among all
    that lie within r is the nearest: rings of radius, twice, four times, ... up to reach are joined for those still without one.
    """
    if not 0 < radius <= reach or unlike < 0:
        raise ValueError("0 < radius <= reach and unlike >= 0 are needed")
    other = _others(places, "place", "density")
    left, r, done = places.drop("n"), radius, None
    while True:
        higher = (F.col("density2") > F.col("density")) | ((F.col("density2") == F.col("density")) & (F.col("place2") < F.col("place")))
        met = _meeting(left, other, r).where(higher)
        met = met.select("place", F.col("place2").alias("parent"), (F.col("apart") * (1.0 + unlike * (1.0 - _alike() / PARTS))).alias("gap")).where(F.col("gap") <= r)
        best = materialised(met.groupBy("place").agg(F.min(F.struct("gap", "parent")).alias("b")).select("place", "b.parent", "b.gap"))
        done = best if done is None else done.union(best)
        if r >= reach:
            break
        left = left.join(best.select("place"), "place", "left_anti")
        r = min(2 * r, reach)
    return places.select("place").join(done, "place", "left").select("place", "parent", "gap")


def roots(pointers: DataFrame) -> DataFrame:
    """(place, root): the end of each chain of pointers (place, parent), a null parent ending it.

    Pointer jumping: each round doubles the length of the steps, so chains of n places take log2(n) rounds. Places that have
    reached an end leave the rounds. A place whose parent is not in the table is an end's child: the parent is its root.
    """
    start = pointers.select("place", F.coalesce("parent", "place").alias("at"), F.col("parent").isNull().alias("ended"))
    moving, ends = materialised(start), None
    while True:
        over = moving.where("ended").select("place", F.col("at").alias("root"))
        ends = materialised(over if ends is None else ends.union(over))
        left = moving.where("not ended")
        if left.isEmpty():
            return ends
        ahead = left.select(F.col("place").alias("at"), F.col("at").alias("next"))
        final = ends.select(F.col("place").alias("at"), F.col("root").alias("next"))
        both = ahead.withColumn("final", F.lit(False)).union(final.withColumn("final", F.lit(True)))
        gone, moving = moving, materialised(left.join(both, "at", "left").select("place", F.coalesce("next", "at").alias("at"), F.coalesce("final", F.lit(True)).alias("ended")))
        released(gone)


def segmented(reads: DataFrame, radius: float, reach: float, flatten: float = 1.0, unlike: float = 1.0, least_reads: int = 5) -> DataFrame:
    """MDL16: (read, cell): the cell of each read of (read, section, x, y, z, gene), and -1 for reads in no cell.

    A cell is a peak of density with all places whose chain of nearest denser places ends there; it is named after the least
    read on the peak's place. Cells of fewer than least_reads reads, and reads without a place or a gene, get -1. Rows that
    repeat a read id each count as a read. Reads of one place always share their cell. An empty table gives no rows.
    """
    good = materialised(usable(reads, flatten))
    names = good.groupBy("section", *_AXES).agg(F.min("read").alias("place"))
    table = materialised(densities(materialised(profiles(good, radius)), radius).join(names, ["section", *_AXES]))
    found = roots(denser(table, radius, reach, unlike))
    of = table.select("section", *_AXES, "place", "n").join(found, "place")
    size = of.groupBy("root").agg(F.sum("n").alias("reads")).where(F.col("reads") >= least_reads)
    named = of.join(size, "root", "left").select("section", *_AXES, F.when(F.col("reads").isNotNull(), F.col("root")).otherwise(F.lit(-1)).alias("cell"))
    inside = good.join(named, ["section", *_AXES]).select("read", "cell")
    return inside.union(reads.where(~_whole()).select("read", F.lit(-1).cast(inside.schema["cell"].dataType).alias("cell")))


def cell_centres(reads: DataFrame, cells: DataFrame) -> DataFrame:
    """MDL16: (read, cell, reads, cx, cy, cz): each read with its cell's size and mean place, rounded down; -1 outside cells.

    reads: (read, x, y, z), cells: (read, cell), read being unique. Means are made by cell and joined back.
    """
    placed = cells.join(reads.select("read", *_AXES), "read")
    mean = placed.where("cell <> -1").groupBy("cell").agg(F.count(F.lit(1)).alias("reads"), *[F.floor(F.avg(c)).alias(f"c{c}") for c in _AXES])
    out = cells.join(mean, "cell", "left")
    return out.select("read", "cell", F.coalesce("reads", F.lit(0).cast("long")).alias("reads"), *[F.coalesce(f"c{c}", F.lit(-1).cast("long")).alias(f"c{c}") for c in _AXES])
