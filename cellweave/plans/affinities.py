"""Queries on affinities, layers, communities, propagation and markers."""

from pyspark.sql import functions as F

from cellweave.operators import affinity as A
from cellweave.plans.geometry import KNN, knn
from cellweave.plans.graphs import symmetric
from cellweave.plans.registry import query
from cellweave.sources import bindings as B


def r(c, n=6):
    return F.round(c, n).alias(c)


@query(f"""WITH {KNN}, s AS (SELECT src, distance AS sigma FROM knn WHERE rank = 5), w AS (SELECT knn.src, dst, exp(-pow(distance / greatest(sigma, 1e-12::DOUBLE), 2)) AS weight FROM knn JOIN s ON s.src = knn.src),
u AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM w UNION ALL SELECT dst, src, weight FROM w) GROUP BY 1, 2), d AS (SELECT src, dst, weight FROM u UNION ALL SELECT src, src, max(weight) FROM u GROUP BY src)
SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS weight FROM d""")
def diffusion_affinity(spark, sf_dir):
    """GRF13, GRF25: the affinity of a diffusion, bandwidth by the fifth neighbour."""
    return A.magic_affinity(knn(spark, sf_dir), 5).select("src", "dst", r("weight"))


@query(f"""WITH {KNN}, sc AS (SELECT src, dst, CASE WHEN a.label = b.label THEN 8 ELSE -12 END - 2.0::DOUBLE * distance AS score FROM knn JOIN emb a ON a.cell = src JOIN emb b ON b.cell = dst),
t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst) AS k FROM sc) SELECT src, dst, round(score, 6) AS score, round(exp(least(greatest(score, -30), 30)) / sum(exp(least(greatest(score, -30), 30))) OVER (PARTITION BY src), 6) AS weight FROM t WHERE k <= 6""")
def prior_attention_edges(spark, sf_dir):
    """GRF10, NUM16: candidate edges of the attention graph with their prior score and softmax."""
    cells = B.embedding(spark, sf_dir).select("cell", F.col("label").alias("type"))
    return A.prior_edges(knn(spark, sf_dir).select("src", "dst", "distance"), cells, 6, 2.0).select("src", "dst", r("score"), r("weight"))


@query("""WITH e AS (SELECT l_suppkey AS cell, l_linenumber AS layer, avg(l_discount) * 100 AS energy FROM lineitem GROUP BY 1, 2), s AS (SELECT cell, layer, exp(-(energy - min(energy) OVER (PARTITION BY cell))) AS w FROM e),
f AS (SELECT cell, layer, greatest(w / sum(w) OVER (PARTITION BY cell), 1e-4::DOUBLE) AS w FROM s) SELECT cell, layer, round(w / sum(w) OVER (PARTITION BY cell), 6) AS weight FROM f""")
def layer_weights(spark, sf_dir):
    """GRF22: weights of a cell's layers from their energies."""
    rows = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.col("l_linenumber").alias("layer")).agg((F.avg("l_discount") * 100).alias("energy"))
    return A.layer_weights(rows).select("cell", "layer", r("weight"))


@query(f"""WITH net AS (SELECT l_suppkey % 64 AS regulator, l_partkey % 64 AS target, avg(l_discount - 0.05) AS weight FROM lineitem WHERE l_suppkey % 64 <> l_partkey % 64 GROUP BY 1, 2), {B.EXPR},
clamp AS (SELECT 3 AS gene, -1.0::DOUBLE AS delta), d0 AS (SELECT DISTINCT cell, 3 AS gene, -1.0::DOUBLE AS delta FROM expr),
d1 AS (SELECT cell, target AS gene, sum(weight * delta) AS delta FROM net JOIN d0 ON d0.gene = regulator WHERE target <> 3 GROUP BY 1, 2 UNION ALL SELECT * FROM d0),
d2 AS (SELECT cell, target AS gene, sum(weight * delta) AS delta FROM net JOIN d1 ON d1.gene = regulator WHERE target <> 3 GROUP BY 1, 2 UNION ALL SELECT * FROM d0),
d3 AS (SELECT cell, target AS gene, sum(weight * delta) AS delta FROM net JOIN d2 ON d2.gene = regulator WHERE target <> 3 GROUP BY 1, 2 UNION ALL SELECT * FROM d0)
SELECT cell, gene, round(delta, 7) AS delta FROM d3""")
def propagated_knock_out(spark, sf_dir):
    """MDL14: three rounds of a knock-out's propagation, the silenced gene clamped."""
    lines = B.table(spark, sf_dir, "lineitem").where("l_suppkey % 64 <> l_partkey % 64")
    network = lines.groupBy((F.col("l_suppkey") % 64).alias("regulator"), (F.col("l_partkey") % 64).alias("target")).agg(F.avg(F.col("l_discount") - 0.05).alias("weight"))
    clamped = spark.createDataFrame([(3, -1.0)], "gene long, delta double")
    start = B.expression(spark, sf_dir).select("cell").distinct().select("cell", F.lit(3).cast("long").alias("gene"), F.lit(-1.0).alias("delta"))
    return A.propagated(network, start, clamped).select("cell", "gene", r("delta", 7))


@query(f"""WITH {B.EXPR}, g AS (SELECT s_suppkey AS cell, (s_nationkey % 4)::BIGINT AS grp FROM supplier), d AS (SELECT g.cell, g.grp, ge.gene, coalesce(expr.value, 0)::DOUBLE AS value FROM g CROSS JOIN (SELECT DISTINCT gene FROM expr) ge LEFT JOIN expr ON expr.cell = g.cell AND expr.gene = ge.gene),
x AS (SELECT gene, grp, value, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0::DOUBLE AS rank, count(*) OVER (PARTITION BY gene) AS n, sum(value) OVER (PARTITION BY gene) AS s FROM d),
t AS (SELECT gene, sum(c * c * c - c) AS ties FROM (SELECT gene, value, count(*)::DOUBLE AS c FROM d GROUP BY 1, 2) GROUP BY gene),
o AS (SELECT grp, gene, sum(rank) AS r, count(*)::DOUBLE AS n1, sum(value) AS s1, any_value(n)::DOUBLE AS n, any_value(s) AS s, count(*) FILTER (WHERE value > 0) AS k FROM x GROUP BY 1, 2)
SELECT grp, gene, round(coalesce((r - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) / nullif(sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))), 0), 0), 5) AS z, round(s1 / n1 - (s - s1) / (n - n1), 5) AS difference, round(k / n1, 5) AS pct FROM o JOIN t USING (gene) WHERE n > n1""")
def rank_sum_markers(spark, sf_dir):
    """AGG36, WIN13: rank-sum statistics of each gene in each group against the rest, over all cells."""
    groups = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), (F.col("s_nationkey") % 4).cast("long").alias("grp"))
    return A.rank_sum_markers(B.expression(spark, sf_dir), groups, 0.0).select("grp", "gene", r("z", 5), r("difference", 5), r("pct", 5))


@query()
def communities(spark, sf_dir):
    """MDL07: communities of the similarity graph by label propagation."""
    return A.communities(symmetric(spark, sf_dir), 6)


@query()
def mixture_clusters(spark, sf_dir):
    """MDL06: clusters of a Gaussian mixture with one covariance, over all dimensions."""
    return A.shared_covariance_mixture(B.embedding(spark, sf_dir).select("cell", "v"), 4)
