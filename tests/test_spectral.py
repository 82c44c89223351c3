"""Spectral operators and smoothing against dense linear algebra."""

import numpy as np
import pytest

from cellweave.operators import impute, neighbors, spectral


def ring(n, chords):
    rng = np.random.default_rng(0)
    w = np.zeros((n, n))
    for i in range(n):
        w[i, (i + 1) % n] = w[(i + 1) % n, i] = 1
    for i, j in rng.integers(0, n, (chords, 2)):
        if i != j:
            w[i, j] = w[j, i] = rng.random() + 0.1
    return w


def edges_of(spark, w):
    return spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "src long, dst long, weight double")


def laplacian(w):
    d = w.sum(1)
    return np.eye(len(w)) - w / np.sqrt(np.outer(d, d))


def matrix(basis):
    return np.array([r.u for r in basis.orderBy("cell").collect()])


def test_smallest_eigenpairs(spark):
    w = ring(60, 40)
    lap = laplacian(w)
    value, basis = spectral.smallest_laplacian(edges_of(spark, w), 4, steps=7)
    u = matrix(basis)
    want = np.linalg.eigvalsh(lap)[:4]
    assert abs(value[0]) < 1e-8 and np.allclose(value, want, atol=1e-4)
    assert np.allclose(u.T @ u, np.eye(4), atol=1e-8)
    assert np.abs(lap @ u - u * value).max() < 0.02
    x = np.random.default_rng(1).random((60, 2))
    rows = spark.createDataFrame([(i, g, float(x[i, g])) for i in range(60) for g in range(2)], "cell long, gene long, value double")
    got = {(r.cell, r.gene): r.value for r in spectral.denoised(basis, np.array([1.0, 0.5, 0.25, 0.1]), rows).collect()}
    expected = np.maximum(u @ np.diag([1.0, 0.5, 0.25, 0.1]) @ u.T @ x, 0)
    assert all(got[i, g] == pytest.approx(expected[i, g], abs=1e-9) for i in range(60) for g in range(2))
    assert spectral.subspace_distance(basis, basis) < 1e-4


def test_eigenpairs_of_a_graph_far_larger_than_the_blocks(spark):
    x = np.random.default_rng(8).normal(size=(900, 24))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    w = np.zeros((900, 900))
    near = np.argsort(d, axis=1)[:, 1:11]
    for i in range(900):
        w[i, near[i]] = np.exp(-d[i, near[i]] / 20)
    w = np.maximum(w, w.T)
    lap = laplacian(w)
    value, basis = spectral.smallest_laplacian(edges_of(spark, w), 8)
    u = matrix(basis)
    assert np.allclose(value, np.linalg.eigvalsh(lap)[:8], atol=2e-3)
    assert np.abs(np.linalg.norm(lap @ u - u * value, axis=0)).max() < 4e-3
    with pytest.raises(RuntimeError):
        spectral.smallest_laplacian(edges_of(spark, w), 8, steps=2, most_rounds=1)


def test_components_of_many_columns(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 6)) * [20, 15, 10, 8, 6, 5] @ rng.normal(size=(6, 700)) + rng.normal(size=(400, 700)) * 0.1
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(400)], "cell long, v array<double>")
    got, share = spectral.principal_components(rows, 4)
    z = np.array([r.x for r in got.orderBy("cell").collect()])
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose((z**2).sum(0), s[:4] ** 2, rtol=1e-6) and np.allclose(share, s[:4] ** 2 / (s**2).sum(), rtol=1e-6)


def test_fused_basis_and_components(spark):
    a, b = ring(40, 30), ring(40, 15)
    value, basis = spectral.fused_basis([edges_of(spark, a), edges_of(spark, b)], [1.0, 1.0], [0.5, 0.5], 3, steps=6)
    dense = np.zeros((40, 40))
    for w in (a, b):
        lap = laplacian(w)
        v = np.linalg.eigh(lap)[1][:, :3]
        dense += lap - 0.5 * v @ v.T
    assert np.allclose(value, np.linalg.eigvalsh(dense)[:3], atol=5e-3)
    x = np.random.default_rng(2).normal(size=(50, 6)) * np.arange(1, 7)
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(50)], "cell long, v array<double>")
    got, share = spectral.principal_components(rows, 3)
    z = np.array([r.x for r in got.orderBy("cell").collect()])
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose((z**2).sum(0), s[:3] ** 2) and np.allclose(share, s[:3] ** 2 / (s**2).sum())


def test_nearest_in_blocks(spark):
    x = np.random.default_rng(3).normal(size=(120, 5)).round(1)
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(120)], "cell long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for size in (16, 4096):
        got = sorted((r.src, r["rank"], r.dst) for r in neighbors.nearest(rows, k=4, block_rows=size).collect())
        assert got == [(i, k + 1, int(j)) for i in range(120) for k, j in enumerate(np.lexsort((np.arange(120), d[i]))[:4])]


def test_knn_smoothing(spark):
    x = np.random.default_rng(4).poisson(4, (24, 6)).astype(float)
    rows = spark.createDataFrame([(i, g, float(x[i, g])) for i in range(24) for g in range(6) if x[i, g]], "cell long, gene long, value double")
    smooth = x.copy()
    for now in (2, 4):
        norm = smooth * np.median(smooth.sum(1)) / smooth.sum(1)[:, None]
        f = np.sqrt(norm) + np.sqrt(norm + 1)
        c = f - f.mean(0)
        z = c @ np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :3]
        d = ((z[:, None] - z[None]) ** 2).sum(2)
        near = np.argsort(d, axis=1, kind="stable")[:, :now]
        smooth = x[near].sum(1)
    got = {(r.cell, r.gene): r.value for r in impute.knn_smoothed(rows, 4, d=3).collect()}
    assert all(got.get((i, g), 0.0) == smooth[i, g] for i in range(24) for g in range(6))


def test_nearest_among_hundreds_of_copies(spark):
    x = np.random.default_rng(6).normal(size=(700, 5))
    x[np.random.default_rng(7).permutation(700)[:500]] = x[0]
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(700)], "cell long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = [(i, k + 1, int(j)) for i in range(700) for k, j in enumerate(np.lexsort((np.arange(700), d[i]))[:10])]
    for size in (128, 4096):
        assert sorted((r.src, r["rank"], r.dst) for r in neighbors.nearest(rows, k=10, block_rows=size).collect()) == want


def test_filters_by_gene_against_dense_algebra(spark):
    rng = np.random.default_rng(12)
    w = np.triu((rng.random((18, 18)) < 0.3) * rng.random((18, 18)), 1)
    w += w.T + np.diag(np.ones(17), 1) * 0.2 + np.diag(np.ones(17), -1) * 0.2
    d = w.sum(1)
    lap = np.eye(18) - w / np.sqrt(np.outer(d, d))
    lam, vec = np.linalg.eigh(lap)
    lam, vec, x = lam[:6], vec[:, :6], rng.random((18, 4)) * (rng.random((18, 4)) < 0.7)
    spatial = x - np.outer(vec[:, 0], vec[:, 0] @ x)
    rough = np.einsum("ig,ij,jg->g", spatial, lap, spatial) / ((spatial**2).sum(0) + 1e-8)
    beta = 10 - (rough - rough.min()) / (rough.max() - rough.min() + 1e-8) * 9
    want = vec[:, 1:] @ (np.exp(-np.outer(lam[1:] / lam[1:].max(), beta)) * (vec[:, 1:].T @ spatial))
    rows = lambda m, skip=False: [(int(i), int(j), float(m[i, j])) for i, j in np.ndindex(m.shape) if m[i, j] or not skip]
    basis = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "cell long, u array<double>")
    got = spectral.gene_filtered(spark.createDataFrame(rows(lap, True), "src long, dst long, weight double"), basis, lam, spark.createDataFrame(rows(x, True), "cell long, gene long, value double")).collect()
    assert len(got) == 72 and all(abs(r.value - want[r.cell, r.gene]) < 1e-9 for r in got)


def test_fused_basis_with_a_strength_for_each_cell(spark):
    a, b = ring(40, 30), ring(40, 60)[::-1, ::-1]
    rng = np.random.default_rng(5)
    alpha = rng.random(40) * 1.5
    alpha[3] = 0.0  # and cell 7 has no row
    table = spark.createDataFrame([(i, float(x)) for i, x in enumerate(alpha) if i != 7], "cell long, alpha double")
    alpha[7] = 0.0
    value, basis = spectral.fused_basis([edges_of(spark, a), edges_of(spark, b)], [1.0, 0.5], [table, 0.25], 3, steps=6)
    ua, ub = (np.linalg.eigh(laplacian(w))[1][:, :3] for w in (a, b))
    half = np.diag(np.sqrt(alpha))
    m = laplacian(a) + 0.5 * laplacian(b) - half @ ua @ ua.T @ half - 0.25 * ub @ ub.T
    u = matrix(basis)
    assert np.allclose(value, np.linalg.eigvalsh(m)[:3], atol=2e-3)
    assert np.linalg.norm(m @ u - u * value) < 2e-2 and np.allclose(u.T @ u, np.eye(3), atol=1e-6)
    with pytest.raises(ValueError):
        spectral.fused_basis([edges_of(spark, a)], [1.0], [spark.createDataFrame([(0, -1.0)], "cell long, alpha double")], 2, steps=6)
