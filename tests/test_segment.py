"""Cells from reads against a plain version, on planted cells and on odd rows."""

import math
from collections import Counter

import numpy as np
import pytest

from cellweave.operators import segment

SCHEMA = "read long, section long, x double, y double, z double, gene string"


def plain(rows, radius, reach, flatten, unlike, least):
    """{read: cell} by comparing all reads of a section."""
    places = {}
    for read, section, x, y, z, gene in rows:
        places.setdefault((section, x, y, z * flatten), []).append((read, gene))
    apart = lambda a, b: math.dist(a[1:], b[1:]) if a[0] == b[0] else math.inf
    comp = {p: Counter(g for q, rs in places.items() if apart(p, q) <= radius for _, g in rs) for p in places}
    norm = {p: sum(n * n for n in c.values()) for p, c in comp.items()}
    alike = lambda p, q: math.floor(1e6 * sum(n * comp[q][g] for g, n in comp[p].items()) / math.sqrt(norm[p] * norm[q]))
    rho = {p: sum(alike(p, q) * len(places[q]) for q in places if apart(p, q) <= radius) for p in places}
    name = {p: min(r for r, _ in rs) for p, rs in places.items()}
    up = {}
    for p in places:
        higher = [(apart(p, q) * (1 + unlike * (1 - alike(p, q) / 1e6)), name[q], q) for q in places if (rho[q], -name[q]) > (rho[p], -name[p])]
        higher = [h for h in higher if h[0] <= reach]
        up[p] = min(higher)[2] if higher else None

    def top(p):
        return p if up[p] is None else top(up[p])

    size = Counter()
    for p in places:
        size[top(p)] += len(places[p])
    return {r: name[top(p)] if size[top(p)] >= least else -1 for p, rs in places.items() for r, _ in rs}


def planted(seed=3):
    """Cells of 60 reads, 40 apart in two sections, each with genes of its own, on whole pixels; and lone reads."""
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for section in (0, 1):
        for cell in range(6):
            centre = np.array([(cell % 3) * 40.0, (cell // 3) * 40.0, 10.0 * section])
            for _ in range(60):
                at = np.round(centre + np.clip(rng.normal(0, 3, 3), -8, 8) * (1, 1, 0.5))
                truth[len(rows)] = (section, cell)
                rows.append((len(rows), section, *map(float, at), f"g{cell * 2 + rng.integers(2)}"))
    for i in range(4):
        truth[len(rows)] = None
        rows.append((len(rows), 0, 500.0 + 100 * i, 500.0, 0.0, "g0"))
    return rows, truth


def test_planted_cells_are_found_as_by_the_plain_version(spark):
    rows, truth = planted()
    got = {r.read: r.cell for r in segment.segmented(spark.createDataFrame(rows, SCHEMA), 8.0, 20.0, 2.0).collect()}
    assert got == plain(rows, 8.0, 20.0, 2.0, 1.0, 5)
    assert {got[r] for r, t in truth.items() if t is None} == {-1}
    majority = Counter((truth[r], c) for r, c in got.items() if truth[r] is not None)
    main = [max((n, c) for (t, c), n in majority.items() if t == cell) for cell in {t for t in truth.values() if t}]
    assert len({c for _, c in main}) == 12 and min(n for n, _ in main) >= 55


@pytest.mark.parametrize("unlike", [0.0, 3.0])
def test_scattered_reads_with_ties_equal_the_plain_version(spark, unlike):
    rng = np.random.default_rng(1)
    rows = [(i * 7 + 1, int(rng.integers(2)), *map(float, rng.integers(-12, 12, 2)), float(rng.integers(2)), f"g{rng.integers(3)}") for i in range(250)]
    got = {r.read: r.cell for r in segment.segmented(spark.createDataFrame(rows, SCHEMA), 2.5, 9.0, 1.0, unlike, 3).collect()}
    assert got == plain(rows, 2.5, 9.0, 1.0, unlike, 3)


def test_odd_rows(spark):
    heap = [(i, 0, 1.0, 1.0, 0.0, "a") for i in range(300)]  # one place
    odd = [(900, None, 1.0, 1.0, 0.0, "a"), (901, 0, None, 1.0, 0.0, "a"), (902, 0, math.nan, 1.0, 0.0, "a"), (903, 0, 1.0, math.inf, 0.0, "a"), (904, 0, 1.0, 1.0, 0.0, None)]
    again = [(5, 0, 1.0, 1.0, 0.0, "a")] * 2
    got = [(r.read, r.cell) for r in segment.segmented(spark.createDataFrame([*heap, *odd, *again], SCHEMA), 2.0, 4.0).collect()]
    assert len(got) == 307 and Counter(c for _, c in got) == {0: 302, -1: 5} and {r for r, c in got if c == -1} == set(range(900, 905))
    assert segment.segmented(spark.createDataFrame([], SCHEMA), 2.0, 4.0).count() == 0
    with pytest.raises(ValueError):
        segment.denser(spark.createDataFrame([], SCHEMA), 3.0, 2.0)


def test_long_chains_end_at_their_root(spark):
    n = 700
    chain = [(i, i - 1 if i else None) for i in range(n)] + [(n + i, 350) for i in range(300)] + [(5000, None)]
    got = {r.place: r.root for r in segment.roots(spark.createDataFrame(chain, "place long, parent long")).collect()}
    assert got == {i: 0 for i in range(n + 300)} | {5000: 5000}


def test_centres(spark):
    reads = spark.createDataFrame([(1, 0, 1.0, 2.0, 0.0, "a"), (2, 0, 4.0, 2.0, 1.0, "b"), (3, 0, 9.0, 9.0, 9.0, "b")], SCHEMA)
    cells = spark.createDataFrame([(1, 1), (2, 1), (3, -1)], "read long, cell long")
    assert sorted(map(tuple, segment.cell_centres(reads, cells).collect())) == [(1, 1, 2, 2, 2, 0), (2, 1, 2, 2, 2, 0), (3, -1, 0, -1, -1, -1)]
