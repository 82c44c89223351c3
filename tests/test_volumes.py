"""Voxel operators against plain loops: plateaus in three dimensions that touch borders, mosaics, spots moved by a field."""

import numpy as np
import pytest

from cellweave.operators import volumes as V

VOXELS = "fov int, z int, y int, x int, value double"


def table(spark, volumes):
    rows = [(f, *map(int, at), float(v)) for f, volume in enumerate(volumes) for at, v in np.ndenumerate(volume)]
    return spark.createDataFrame(rows, VOXELS)


def flooded(volume, threshold):
    seen, out = np.zeros(volume.shape, bool), []
    for start in np.ndindex(volume.shape):
        if seen[start] or volume[start] <= threshold:
            continue
        seen[start], front, members, top = True, [start], [], True
        while front:
            at = front.pop()
            members.append(at)
            for d in np.ndindex(3, 3, 3):
                to = tuple(a + b - 1 for a, b in zip(at, d, strict=True))
                if all(0 <= a < n for a, n in zip(to, volume.shape, strict=True)):
                    top &= volume[to] <= volume[at]
                    if volume[to] == volume[at] and not seen[to]:
                        seen[to] = True
                        front.append(to)
        if top:
            out.append((*np.round(np.mean(members, axis=0), 9), volume[start], len(members)))
    return out


def test_plateaus_against_a_flood_fill(spark):
    rng = np.random.default_rng(3)
    volumes = [rng.integers(0, 4, (4, 7, 8)), rng.integers(0, 9, (3, 6, 6)), np.full((2, 3, 3), 5)]
    volumes[0][0, :2, :] = 3  # a snake of equal values along the border
    got = [(r.fov, round(r.z, 9), round(r.y, 9), round(r.x, 9), r.intensity, r.voxels) for r in V.regional_maxima(table(spark, volumes), 1.0).collect()]
    assert sorted(got) == sorted((f, *s) for f, v in enumerate(volumes) for s in flooded(v, 1.0))
    assert V.regional_maxima(table(spark, volumes), 99.0).count() == 0


def test_chains_are_one_group(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101), (103, 103)], "a long, b long")
    got = {r.node: r.group for r in V.connected(edges).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == 100 and got[103] == 103


def test_mosaics_and_moved_spots(spark):
    tiles = table(spark, [np.ones((1, 2, 2)), 3 * np.ones((1, 2, 2))])
    offsets = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 0, 1)], "fov int, dz int, dy int, dx int")
    for mode, want in (("max", 3), ("mean", 2), ("overwrite", 3)):
        got = {(r.y, r.x): r.value for r in V.mosaic(tiles, offsets, mode).collect()}
        assert len(got) == 6 and got[0, 0] == 1 and got[1, 1] == want and got[1, 2] == 3
    with pytest.raises(ValueError):
        V.mosaic(tiles, offsets, "median")
    spots = spark.createDataFrame([(1, 0, 0.0, 1.4, 1.6), (2, 0, 0.0, 3.0, 3.0), (3, 1, 0.0, 0.0, 0.0)], "spot int, fov int, z double, y double, x double")
    flow = spark.createDataFrame([(0, 0, 1, 2, 0.5, 0.25, 9.0), (1, None, None, None, 0.0, 1.0, -4.0)], "fov int, z int, y int, x int, dz double, dy double, dx double")
    got = {r.spot: (r.z, r.y, r.x) for r in V.moved_spots(spots, flow, (2, 4, 5)).collect()}
    assert got == {1: (0.5, 1.65, 4.0), 2: (0.0, 3.0, 3.0), 3: (0.0, 1.0, 0.0)}
