"""Leiden communities, metacells by walks, weighted nearest neighbours and Harmony against plain dense versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import harmony, metacells, modularity, multimodal


def louvain(w, gamma=1.0):
    """Plain Louvain over a dense matrix, one node after the other."""
    member, a, m2 = np.arange(len(w)), w.copy(), w.sum()
    while True:
        k, label, moved, ever = a.sum(1), np.arange(len(a)), True, False
        while moved:
            moved = False
            for i in range(len(a)):
                total, to = np.bincount(label, k, len(a)), np.bincount(label, a[i], len(a))
                to[label[i]] -= a[i, i]
                total[label[i]] -= k[i]
                gain = to - gamma * k[i] * total / m2
                if gain.max() > gain[label[i]] + 1e-12:
                    label[i], moved, ever = gain.argmax(), True, True
        if not ever:
            return member
        names, code = np.unique(label, return_inverse=True)
        member = code[member]
        z = np.eye(len(names))[code]
        a = z.T @ a @ z


def quality(w, label, gamma=1.0):
    k = w.sum(1)
    return ((w - gamma * np.outer(k, k) / w.sum()) * (label[:, None] == label[None])).sum() / w.sum()


def blocks(rng, sizes, inside, outside):
    c = np.repeat(np.arange(len(sizes)), sizes)
    p = np.where(c[:, None] == c[None], inside, outside)
    w = np.triu(rng.random(p.shape) < p, 1).astype(float)
    return w + w.T


def graphs():
    rng = np.random.default_rng(1)
    ring = np.kron(np.eye(6), np.ones((5, 5)))
    for c in range(6):
        ring[5 * c, (5 * c + 5) % 30] = ring[(5 * c + 5) % 30, 5 * c] = 1
    np.fill_diagonal(ring, 0)
    x = rng.normal(size=(120, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near, knn = np.argsort(d, 1)[:, 1:7], np.zeros((120, 120))
    knn[np.repeat(np.arange(120), 6), near.ravel()] = np.exp(-np.take_along_axis(d, near, 1).ravel())
    return [ring, blocks(rng, [30, 20, 25], 0.4, 0.04), blocks(rng, [15] * 8, 0.5, 0.05), np.maximum(knn, knn.T), blocks(rng, [80], 0.08, 0)]


def table(spark, w):
    return spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "src long, dst long, weight double")


def labelled(rows, n):
    found = {r.cell: r.community for r in rows}
    return np.array([found.get(i, i) for i in range(n)])


@pytest.mark.parametrize("which", range(5))
def test_leiden_is_as_good_as_a_dense_louvain(spark, which):
    w = graphs()[which]
    label = labelled(modularity.leiden(table(spark, w)).collect(), len(w))
    assert quality(w, label) >= quality(w, louvain(w)) - 1e-9
    for c in set(label):  # named after the least cell, and connected
        inside = np.flatnonzero(label == c)
        assert inside.min() == c
        seen, front = {c}, [c]
        while front:
            new = set(np.flatnonzero(w[front.pop()]).tolist()) & set(inside.tolist()) - seen
            seen |= new
            front += new
        assert seen == set(inside.tolist())


def test_several_blocks_and_resolutions_at_once(spark, monkeypatch):
    monkeypatch.setattr(modularity, "BLOCK_NODES", 25)
    w = graphs()[2]
    rows = modularity.leiden(table(spark, w), (0.2, 1.0)).collect()
    for gamma, least in ((0.2, 0.97), (1.0, 0.97)):
        label = labelled([r for r in rows if r.resolution == gamma], len(w))
        assert quality(w, label, gamma) >= least * quality(w, louvain(w, gamma), gamma)


def test_a_number_of_communities_is_met(spark):
    found = modularity.target_communities(table(spark, graphs()[2]), 8, (0.1, 0.5, 1.0, 1.1)).collect()
    assert len({r.community for r in found}) == 8 and len({r.resolution for r in found}) == 1
    empty = spark.createDataFrame([], "src long, dst long, weight double")
    assert modularity.leiden(empty).count() == 0


def test_metacells_equal_a_plain_agglomeration(spark):
    """Against one that compares all pairs of touching groups at every step, on two groups and a cell without edges."""
    w = blocks(np.random.default_rng(5), [12, 12, 12], 0.6, 0.05) * 0.5
    w[35], w[:, 35] = 0, 0
    cells = spark.createDataFrame([(i, int(i >= 20)) for i in range(36)], "cell long, grp int")
    got = {r.cell: r.metacell for r in metacells.metacells(table(spark, w), cells, 4.0).collect()}
    for members, wanted in (((range(20)), 5), (range(20, 35), 4 - 1)):
        sub = w[np.ix_(members, members)]
        v = metacells.walk_vectors(sub, 4)
        groups = [[i] for i in range(len(sub))]
        while len(groups) > wanted:
            pairs = []
            for a in range(len(groups)):
                for b in range(a + 1, len(groups)):
                    if sub[np.ix_(groups[a], groups[b])].any():
                        both = v[groups[a] + groups[b]]
                        rise = ((both - both.mean(0)) ** 2).sum() - sum(((v[g] - v[g].mean(0)) ** 2).sum() for g in (groups[a], groups[b]))
                        pairs.append((round(rise, 12), min(groups[a]), min(groups[b]), a, b))
            if not pairs:
                break
            *_, a, b = min(pairs)
            groups[a] += groups.pop(b)
        want = {members[i]: members[min(g)] for g in groups for i in g}
        assert {k: got[k] for k in want} == want
    assert got[35] == 35 and len(got) == 36


def test_large_groups_are_parted_first(spark):
    w = blocks(np.random.default_rng(6), [20, 20], 0.5, 0.02)
    cells = spark.createDataFrame([(i, "one") for i in range(40)], "cell long, grp string")
    got = metacells.metacells(table(spark, w), cells, 5.0, most=25).collect()
    assert sorted(r.cell for r in got) == list(range(40)) and 6 <= len({r.metacell for r in got}) <= 10


def test_weighted_neighbours_with_growing_range_are_exact(spark):
    rng = np.random.default_rng(8)
    parts = {"a": rng.normal(size=(60, 5)), "b": rng.normal(size=(60, 4))}
    tables = {m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell long, v array<double>") for m, x in parts.items()}
    got = multimodal.weighted_neighbours(tables, k=5, knn_range=6, n_far=5, grow=True).collect()
    weight = {(r.cell, r.modality): r.weight for r in multimodal.modality_weights(tables, k=5, n_far=5).collect()}
    joint = np.zeros((60, 60))
    for m, x in parts.items():
        u = x / np.linalg.norm(x, axis=1)[:, None]
        d = np.sqrt(((u[:, None] - u[None]) ** 2).sum(2))
        near = np.argsort(d + np.eye(60) * 9, 1)[:, :5]
        lists = np.zeros((60, 60), bool)
        lists[np.repeat(np.arange(60), 5), near.ravel()] = True
        np.fill_diagonal(lists, True)
        both = lists.astype(int) @ lists.T.astype(int)
        jaccard = np.where((both > 0) & ~np.eye(60, dtype=bool), both / (12 - both), 9)
        far = np.argsort(np.round(jaccard, 9), 1, kind="stable")
        for i in range(60):
            chosen = [j for j in far[i] if jaccard[i, j] < 9][:5]
            first, sigma = d[i, near[i, 0]], d[i, chosen].mean()
            joint[i] += weight[i, m] * np.exp(-np.maximum(d[i] - first, 0) / (sigma - first))
    np.fill_diagonal(joint, -1)
    for i in range(60):
        want = sorted(range(60), key=lambda j: (-round(joint[i, j], 12), j))[:5]
        assert [r.dst for r in sorted(got, key=lambda r: r.rank) if r.src == i] == want
    few = {m: t.where("cell < 3") for m, t in tables.items()}
    assert multimodal.weighted_neighbours(few).count() == 6


def test_one_round_of_harmony_against_dense_numpy(spark):
    rng = np.random.default_rng(2)
    batch = rng.integers(0, 2, 200)
    x = rng.normal(size=(200, 4)) + 4 * np.eye(4)[rng.integers(0, 3, 200)] + np.where(batch[:, None] == 1, [0, 0, 0, 2.0], 0)
    points = spark.createDataFrame([(i, "pq"[b], v.tolist()) for i, (b, v) in enumerate(zip(batch, x, strict=True))], "cell long, batch string, v array<double>")
    state = points.select("cell", "v", (F.col("batch") == "q").cast("int").alias("b")).withColumn("z", F.col("v"))
    shares = np.bincount(batch) / 200
    model = harmony.Clusters(harmony._units(x[:5]), None, shares, 2.0, 0.1)
    r = harmony.memberships(x, batch, model)
    held, unit, sums, _ = harmony._sums(state, model)
    assert np.allclose(held, np.stack([r[batch == b].sum(0) for b in (0, 1)], axis=1))
    assert np.allclose(unit, r.T @ harmony._units(x))
    model = harmony.Clusters(harmony._units(unit), held, shares, 2.0, 0.1)
    r = harmony.memberships(x, batch, model)
    held, _, sums, _ = harmony._sums(state, model)
    got = {row.cell: row.z for row in harmony._moved(state, model, harmony.shifts(held, sums, 1.0)).collect()}
    want, design = x.copy(), np.stack([np.ones(200), batch == 0, batch == 1], axis=1).astype(float)
    for c in range(5):
        beta = np.linalg.solve((design * r[:, [c]]).T @ design + np.diag([0, 1.0, 1.0]), (design * r[:, [c]]).T @ x)
        beta[0] = 0
        want -= r[:, [c]] * (design @ beta)
    assert np.allclose([got[i] for i in range(200)], want)

    def mixed(z):
        d = ((z[:, None] - z[None]) ** 2).sum(2)
        near = np.argsort(d, 1)[:, 1:16]
        return (batch[near] == batch[:, None]).mean()

    out = harmony.corrected(points, clusters=6, rounds=4)
    after = np.array([r.v for r in sorted(out.collect(), key=lambda r: r.cell)])
    assert mixed(after) < mixed(x) - 0.1
    assert harmony.corrected(points.where("cell < 0")).count() == 0


def test_small_communities_share_tasks(spark, monkeypatch, tmp_path):
    """Hundreds of small communities and groups are parted as by themselves, but not in hundreds of tasks."""
    real = modularity._refine_block

    def counted(m2):
        run = real(m2)

        def told(rows):
            import uuid

            (tmp_path / uuid.uuid4().hex).touch()
            return run(rows)

        return told

    monkeypatch.setattr(modularity, "_refine_block", counted)
    chains = [(3 * g + i, 3 * g + i + 1) for g in range(250) for i in (0, 1)]
    edges = spark.createDataFrame([(s, d, 1.0) for a, b in chains for s, d in ((a, b), (b, a))], "src long, dst long, weight double")
    found = {r.cell: r.community for r in modularity.leiden(edges).collect()}
    assert found == {c: c // 3 * 3 for c in range(750)}
    assert 0 < len(list(tmp_path.iterdir())) <= 10
    cells = spark.createDataFrame([(c, c // 3) for c in range(760)], "cell long, grp long")
    got = metacells.metacells(edges, cells, 3.0, most=100)
    assert {r.cell: (r.grp, r.metacell, r.size) for r in got.collect() if r.cell < 750} == {c: (c // 3, c // 3 * 3, 3) for c in range(750)}
    assert got.count() == 760
