"""Networks, completion, filters and layers against dense versions."""

import numpy as np
import pytest

from cellweave.operators import expression, impute, layers, networks, spectral
from cellweave.sources import readers


def long(spark, x):
    return spark.createDataFrame([(i, g, float(x[i, g])) for i in range(x.shape[0]) for g in range(x.shape[1]) if x[i, g]], "cell long, gene long, value double")


def vectors(spark, x, grp=None):
    if grp is None:
        return spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "cell long, v array<double>")
    return spark.createDataFrame([(i, int(grp[i]), x[i].tolist()) for i in range(len(x))], "cell long, grp long, v array<double>").repartition(5)


@pytest.mark.parametrize("method", ["boosting", "forest"])
def test_importances_find_the_regulators(spark, method):
    rng = np.random.default_rng(1)
    x = rng.poisson(5, (300, 7)).astype(float)
    x[:, 4] = 3 * x[:, 0] + rng.poisson(2, 300)
    x[:, 5] = np.where(x[:, 1] > 5, 20, 2) + rng.poisson(1, 300)
    rows = networks.inferred_network(long(spark, x), [0, 1, 2, 99], method, rounds=20).collect()
    best = {}
    for r in rows:
        assert r.regulator != r.target and r.importance > 0
        best.setdefault(r.target, []).append((r.importance, r.regulator))
    assert max(best[4])[1] == 0 and max(best[5])[1] == 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, networks.inferred_network(long(spark, x), [0, 1, 2, 99], method, rounds=20).collect()))
    with pytest.raises(ValueError):
        networks.inferred_network(long(spark, x), [])
    with pytest.raises(ValueError):
        networks.inferred_network(long(spark, x), [0], "other")


def test_ridge_network(spark):
    rng = np.random.default_rng(2)
    x, grp = rng.normal(size=(120, 5)), rng.integers(0, 2, 120)
    got = {(r.grp, r.regulator, r.target): r.weight for r in networks.ridge_network(vectors(spark, x, grp), [0, 2, 3], 10.0).collect()}
    for g in (0, 1):
        c = x[grp == g] - x[grp == g].mean(0)
        for t in range(5):
            use = [k for k in (0, 2, 3) if k != t]
            w = np.linalg.solve(c[:, use].T @ c[:, use] + 10 * np.eye(len(use)), c[:, use].T @ c[:, t])
            assert np.allclose([got[g, k, t] for k in use], w)
    assert len(got) == 2 * 12


def test_rank_and_completion(spark):
    rng = np.random.default_rng(3)
    full = rng.gamma(2, 1, (150, 4)) @ rng.gamma(2, 1, (4, 30))
    x = np.log1p(rng.poisson(full) * (rng.random((150, 30)) < 0.7))
    rows = vectors(spark, x)
    values, vec = spectral.singular_values(rows, 30)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s)
    gaps = s[:-1] - s[1:]
    noise = gaps[18:]
    assert spectral.chosen_rank(values, 20, 6.0) == np.flatnonzero((gaps - noise.mean()) / noise.std(ddof=1) > 6)[-1] + 1
    with pytest.raises(ValueError):
        spectral.chosen_rank(values, 27)
    low = u[:, :4] * s[:4] @ vt[:4]
    got = {(r.cell, r.gene): r.value for r in impute.alra(long(spark, x), rank=4).collect()}
    want = np.zeros_like(low)
    for g in range(30):
        kept = np.where(low[:, g] > abs(np.quantile(low[:, g], 0.001)), low[:, g], np.nan)
        own = x[x[:, g] != 0, g]
        moved = (kept - np.nanmean(kept)) * own.std(ddof=1) / np.nanstd(kept, ddof=1) + own.mean()
        value = np.maximum(np.nan_to_num(moved), 0)
        want[:, g] = np.where((value == 0) & (x[:, g] > 0), x[:, g], value)
    assert len(got) == 4500 and all(got[i, g] == pytest.approx(want[i, g], abs=1e-8) for i in range(150) for g in range(30))
    assert expression.gene_quantile(long(spark, x), 0.5, "q").count() == 30


def test_filters_by_gene(spark):
    rng = np.random.default_rng(4)
    v = np.linalg.qr(rng.normal(size=(25, 4)))[0]
    x, g = rng.normal(size=(25, 3)), rng.random((4, 3))
    basis = spark.createDataFrame([(i, v[i].tolist()) for i in range(25)], "cell long, u array<double>")
    gains = spark.createDataFrame([(k, j, float(g[k, j])) for k in range(4) for j in range(3)], "k int, gene long, gain double")
    for constant in (False, True):
        got = {(r.cell, r.gene): r.value for r in spectral.filtered(basis, gains, long(spark, x), add_constant=constant).collect()}
        own = np.vstack([np.full(3, float(constant)), g[1:]])
        want = v @ (own * (v.T @ x))
        assert all(got[i, j] == pytest.approx(want[i, j], abs=1e-9) for i in range(25) for j in range(3))
    whole = spectral.filtered(basis, gains.where("gene = 0").select("k", "gain"), long(spark, x), remove_constant=False).collect()
    want = v @ (g[:, :1] * (v.T @ x))
    assert all(r.value == pytest.approx(want[r.cell, r.gene], abs=1e-9) for r in whole)


def test_layer_parameters():
    names = ["a", "b"]
    assert layers.layer_parameters(2, names) == {"a": 2, "b": 2} and layers.layer_parameters([1, 3], names) == {"a": 1, "b": 3}
    assert layers.layer_parameters({"b": 5}, names, 7) == {"a": 7, "b": 5} and layers.layer_parameters(None, names, 1) == {"a": 1, "b": 1}
    for bad in ([1], {"c": 1}, {"a": 1}, None):
        with pytest.raises(ValueError):
            layers.layer_parameters(bad, names)


def test_slices_are_chosen_by_their_key(spark):
    rows = spark.createDataFrame([(f, r, c, f * 10 + r) for f in (1, 2) for r in (1, 2) for c in (0, 1)], "fov long, round int, channel int, z int")
    assert [x.z for x in readers.slices_of(rows, 2, 1, 0).collect()] == [21]
    with pytest.raises(ValueError):
        layers.normalised_energies(rows, "other")
