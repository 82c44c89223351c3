"""Exact nearest neighbours: small tables, blocks with pruning, and groups, against all pairs, with ties and clusters."""

import numpy as np
import pytest

from cellweave.operators import neighbors


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) + 12 * rng.integers(0, 4, (n, 1))
    x[50:90] = x[50]  # ties
    return x


def plain(x, ids, asked, k, same, groups=None):
    out = {}
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        ok = [j for j in range(len(x)) if not (same and j == q) and (groups is None or groups[j] == groups[q])]
        out[ids[q]] = [(ids[j], round(d[j], 9)) for j in sorted(ok, key=lambda j: (d[j], ids[j]))[:k]]
    return out


def told(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.src, r.rank)):
        out.setdefault(r.src, []).append((r.dst, round(r.distance, 9)))
    return out


@pytest.mark.parametrize("bytes_,rows", [(1 << 25, 4096), (0, 40), (0, 4096)])
def test_nearest_against_all_pairs(spark, bytes_, rows):
    x = clustered(1, 300)
    ids = (np.random.default_rng(2).permutation(300) * 7).tolist()
    points = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "cell long, v array<double>")
    options = {"block_rows": rows, "broadcast_bytes": bytes_}
    assert told(neighbors.nearest(points, k=6, **options).collect()) == plain(x, ids, range(300), 6, True)
    some = points.where("cell % 5 = 0")
    got = told(neighbors.nearest(points, some, k=45, **options).collect())
    assert got == plain(x, ids, [i for i in range(300) if ids[i] % 5 == 0], 45, False)
    few = points.where("cell < 20")
    assert all(len(v) == few.count() - 1 for v in told(neighbors.nearest(few, k=10, **options).collect()).values())
    grouped = points.selectExpr("cell", "v", "cell % 3 AS grp")
    assert told(neighbors.nearest(grouped, k=4, **options).collect()) == plain(x, ids, range(300), 4, True, [i % 3 for i in ids])
    assert neighbors.nearest(points.where("cell < 0"), k=3, **options).count() == 0


@pytest.mark.parametrize("kind", ["plain", "far away", "few digits", "copies", "tiny", "odd"])
def test_closest_over_many_columns_against_all(kind):
    """Rough distances in short floats must not lose a neighbour, wherever the points lie, nor without a bound nor with one."""
    rng = np.random.default_rng(7)
    y = rng.normal(size=(9000, 5))
    ids = rng.permutation(9000) * 3
    if kind == "far away":
        y = y * 1e-3 + 1e6
    elif kind == "few digits":
        y = np.round(y, 1)
    elif kind == "copies":
        y[rng.permutation(9000)[:5000]] = y[0]
    elif kind == "tiny":
        y = y * 1e-40
    elif kind == "odd":
        y[5], y[6, 2], y[7, 0] = np.nan, np.inf, 1e300
    asked = np.concatenate([rng.permutation(9000)[:150], [0, 5, 6]])
    with np.errstate(all="ignore"):
        want = {}
        for q in asked.tolist():
            d = np.sqrt(((y - y[q]) ** 2).sum(1))
            ok = np.flatnonzero(np.isfinite(d) & (ids != ids[q]))
            want[q] = ok[np.lexsort((ids[ok], d[ok]))[:12]].tolist()
    for bound in (None, np.array([np.sqrt(((y[want[q][-1]] - y[q]) ** 2).sum()) if want[q] else np.inf for q in asked.tolist()])):
        i, j, _ = neighbors._closest(y[asked], ids[asked], y, ids, 12, True, bound)
        assert {q: j[i == row].tolist() for row, q in enumerate(asked.tolist())} == want


def test_vectors_are_not_written_for_each_block(spark, monkeypatch):
    """Points without clusters leave nearly all blocks open; their vectors are not copied for each of them."""
    x = np.random.default_rng(8).normal(size=(1200, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell long, v array<double>")
    written, real = [], neighbors.materialised

    def counted(df):
        out = real(df)
        written.append(out.count() if "v" in out.columns else 0)
        return out

    monkeypatch.setattr(neighbors, "materialised", counted)
    got = told(neighbors.nearest(rows, k=5, block_rows=40, broadcast_bytes=0).collect())
    assert got == plain(x, list(range(1200)), range(1200), 5, True)
    assert sum(written) <= 2 * 1200


def test_balanced_neighbours_against_plain_proposals(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(30, 2)) * 0.1, rng.normal(size=(50, 2)) * 3])
    near = {i: sorted((round(float(np.hypot(*(x[i] - x[j]))), 12), j) for j in range(80) if j != i)[:15] for i in range(80)}
    edges = spark.createDataFrame([(i, j, d) for i, c in near.items() for d, j in c], "src long, dst long, distance double")
    for k, most in ((4, 5), (6, 3), (3, 100)):
        got = {(r.src, r.dst) for r in neighbors.balanced(edges, k, most).collect()}
        held, refused = {j: [] for j in range(80)}, set()
        while True:  # one source at a time asks for one more
            open_ = [(i, next(((d, j) for d, j in near[i] if (i, j) not in refused and not any(s == i for _, s in held[j])), None)) for i in range(80) if sum(any(s == i for _, s in h) for h in held.values()) < k]
            open_ = [(i, c) for i, c in open_ if c]
            if not open_:
                break
            i, (d, j) = open_[-1]
            held[j] = sorted([*held[j], (d, i)])
            if len(held[j]) > most:
                refused.add((held[j].pop()[1], j))
        assert got == {(i, j) for j, h in held.items() for _, i in h}
        assert max(len(h) for h in held.values()) <= most
