"""Places, running sums, quantiles and ranks against NumPy; mixtures and label graphs against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import affinity, alignment, expression, ranks


def frame(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id long, v double").repartition(7)


def test_places_and_running_sums(spark):
    v = np.random.default_rng(1).integers(0, 9, 500)
    got = {r.id: r.place for r in ranks.numbered(frame(spark, v), "v", "id").collect()}
    assert [got[i] for i in np.lexsort((np.arange(500), v))] == list(range(1, 501))
    rows = ranks.running(frame(spark, v), "v", "v", "id").orderBy("v", "id").collect()
    assert [r.running for r in rows] == np.cumsum(np.sort(v)).tolist() and {r.total for r in rows} == {v.sum()}
    assert ranks.numbered(frame(spark, []), "v", "id").count() == 0


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [0.0] * 300 + [5.0, 1.0, None], list(np.random.default_rng(2).normal(size=501))])
def test_quantiles_and_ranks(spark, values):
    shares = [0.0, 0.05, 0.25, 0.5, 0.99, 1.0]
    x = np.array([v for v in values if v is not None])
    assert np.allclose(ranks.quantiles(frame(spark, values), "v", shares).first().q, np.quantile(x, shares))
    got = {r.v: r["rank"] for r in ranks.average_ranks(frame(spark, values), "v").collect()}
    assert all(got[v] == (x < v).sum() + ((x == v).sum() + 1) / 2 for v in set(x.tolist()))


def test_quantiles_of_nothing(spark):
    assert ranks.quantiles(frame(spark, [None]), "v", [0.5]).first().q == [None]


def test_mixture_with_one_covariance(spark):
    rng = np.random.default_rng(3)
    root = np.array([[1.0, 0, 0], [0.8, 0.5, 0], [0, 0.2, 0.3]])
    centres = np.array([[-6.0, 0, 0], [0, 5, 1], [6, 0, -2]])
    label = rng.integers(0, 3, 900)
    x = centres[label] + rng.normal(size=(900, 3)) @ root.T
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(900)], "cell long, v array<double>")
    got = {r.cell: r for r in affinity.shared_covariance_mixture(rows, 3).collect()}
    assert np.mean([got[i].cluster == label[i] for i in range(900)]) > 0.99
    assert all(0.3 < r.probability <= 1 for r in got.values())


def test_rank_sums_over_all_cells(spark):
    rng = np.random.default_rng(4)
    dense = rng.poisson(0.6, (40, 5)).astype(float)
    dense[:, 4] = 0
    dense[7, 4] = 2
    grp = rng.integers(0, 3, 40)
    expr = spark.createDataFrame([(i, g, float(dense[i, g])) for i in range(40) for g in range(5) if dense[i, g]], "cell long, gene long, value double")
    groups = spark.createDataFrame([(i, int(grp[i])) for i in range(40)], "cell long, grp long")
    got = {(r.grp, r.gene): r for r in affinity.rank_sum_markers(expr, groups, 0.0).collect()}
    assert len(got) == 15
    for (a, g), r in got.items():
        x, inside = dense[:, g], grp == a
        rank = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
        n, n1, t = 40, inside.sum(), np.unique(x, return_counts=True)[1]
        var = n1 * (n - n1) / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1)))
        assert r.z == pytest.approx((rank[inside].sum() - n1 * (n + 1) / 2) / np.sqrt(var)) and r.pct == pytest.approx((x[inside] > 0).mean())
        assert r.difference == pytest.approx(x[inside].mean() - x[~inside].mean())
    assert all(r.difference >= 0.2 for r in affinity.rank_sum_markers(expr, groups, 0.0, 0.2).collect())


def test_profiles_and_rescaling_keep_what_is_zero(spark):
    expr = spark.createDataFrame([(1, 1, 4.0), (2, 1, 2.0), (3, 2, 0.0)], "cell long, gene long, value double")
    groups = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 20)], "cell long, grp long")
    got = {(r.grp, r.gene): (r["mean"], r.pct) for r in expression.marker_profile(expr, groups).collect()}
    assert got == {(10, 1): (3.0, 1.0), (20, 1): (0.0, 0.0), (10, 2): (0.0, 0.0), (20, 2): (0.0, 0.0)}
    rows = expression.rescaled_to_reference(expr, expr.where("gene = 1")).collect()
    assert {(r.cell, r.gene) for r in rows} == {(1, 1), (2, 1), (3, 2)}


def test_joins_by_position(spark):
    a = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "x long, y long, s string")
    assert alignment.joined_by_position(a, a.select("x", "y"), ["x", "y"]).count() == 2
    with pytest.raises(ValueError):
        alignment.joined_by_position(a, a.limit(1).select("x", "y"), ["x", "y"])


def test_running_sums_within_keys(spark):
    from cellweave.operators.ranks import running_by

    rows = [(k % 3 if k < 200 else 0, k * 7 % 101, 1 + k % 4) for k in range(300)]
    frame = spark.createDataFrame([(g, o * 1000 + i, n) for i, (g, o, n) in enumerate(rows)], "g long, o long, n long")
    got = {(r.g, r.o): r.running for r in running_by(frame, "g", "n", F.desc("o")).collect()}
    plain = [(g, o * 1000 + i, n) for i, (g, o, n) in enumerate(rows)]
    assert got == {(g, o): sum(n2 for g2, o2, n2 in plain if g2 == g and o2 >= o) for g, o, _ in plain}


def test_lists_of_common_neighbours_in_tiles(spark):
    from cellweave.operators.graph import shared_neighbours

    edges = spark.createDataFrame([(a, b) for a in range(40) for b in ({99} | {100 + a % 5, 200 + a % 7})], "src long, dst long")
    want = sorted(map(tuple, shared_neighbours(edges, 0.3).collect()))
    assert sorted(map(tuple, shared_neighbours(edges, 0.3, most=6).collect())) == want and len(want) > 100
