"""Queries on networks, completed matrices, filters and layers."""

from pyspark.sql import functions as F

from cellweave.functions import numeric as N
from cellweave.operators import impute, layers, networks, spectral
from cellweave.plans.geometry import KNN, knn
from cellweave.plans.graphs import symmetric, values
from cellweave.plans.registry import query
from cellweave.sources import bindings as B
from cellweave.sources import readers
from cellweave.sources.shared import materialised


def r(c, n=6):
    return F.round(c, n).alias(c)


@query()
def tree_importances(spark, sf_dir):
    """MDL01: importances of eight regulators for every gene."""
    return networks.inferred_network(B.expression(spark, sf_dir), list(range(8)), rounds=20)


@query()
def alra_completion(spark, sf_dir):
    """LIN04, LIN05: expression completed by a low rank, chosen by the gaps of the singular values."""
    return impute.alra(B.expression(spark, sf_dir), most=64, noise_start=40)


@query()
def ridge_network(spark, sf_dir):
    """MDL14: ridge coefficients of all dimensions on the first ten, within each label."""
    rows = B.embedding(spark, sf_dir).select("cell", F.col("label").alias("grp"), "v")
    return networks.ridge_network(rows, list(range(10)))


_C = "list_sum(list_transform(list_zip(d, w), lambda t: t[1] * t[2])) - list_sum(d) * list_sum(w) / len(d)"


@query(f"""WITH {KNN}, x AS (SELECT knn.src, knn.dst, list_transform(a.v, lambda y: y * y) AS d, list_transform(list_zip(b.v, a.v), lambda t: t[1] - t[2]) AS w FROM knn JOIN emb a ON a.cell = knn.src JOIN emb b ON b.cell = knn.dst),
c AS (SELECT src, dst, ({_C}) / sqrt(abs({_C.replace("w)", "d)")}) * abs({_C.replace("(d,", "(w,").replace("sum(d)", "sum(w)")})) AS r FROM x)
SELECT src, dst, round(exp((r - 1) / 0.05::DOUBLE) / sum(exp((r - 1) / 0.05::DOUBLE)) OVER (PARTITION BY src), 6) AS probability FROM c""")
def transition_probabilities(spark, sf_dir):
    """MDL14: where cells move under a shift; here the squares of their own vectors."""
    emb = B.embedding(spark, sf_dir).select("cell", "v")
    shifts = emb.select("cell", F.transform("v", lambda y: y * y).alias("d"))
    return networks.transitions(knn(spark, sf_dir).select("src", "dst"), emb, shifts).select("src", "dst", r("probability"))


@query("SELECT c_nationkey::BIGINT AS grp, count(*) AS n, greatest(20, least(100, floor(count(*) * 0.025::DOUBLE)))::BIGINT AS k FROM customer GROUP BY 1")
def adaptive_neighbours(spark, sf_dir):
    """NUM22: neighbours by the size of a group."""
    n = B.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("grp", "n", networks.adaptive_k(F.col("n")).alias("k"))


@query()
def filtered_values(spark, sf_dir):
    """LIN13, LIN15, NUM21: values on a graph under one filter for each gene, the constant part taken out and put back."""
    value, basis = spectral.smallest_laplacian(materialised(symmetric(spark, sf_dir)), 8)
    lam = spark.createDataFrame([(k, float(v)) for k, v in enumerate(value)], "k int, lam double")
    genes = values(spark, sf_dir).select("gene").distinct()
    gains = genes.join(F.broadcast(lam)).select("k", "gene", N.filter_gain("heat", F.col("lam"), F.lit(float(value.max())), t=1.0).alias("gain"))
    return spectral.filtered(basis, gains, values(spark, sf_dir), add_constant=True)


_ENERGY = "en AS (SELECT l_suppkey AS cell, l_returnflag AS layer, round(avg(l_discount) * 100, 6) AS energy FROM lineitem GROUP BY 1, 2)"


def energies(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.col("l_returnflag").alias("layer")).agg(F.round(F.avg("l_discount") * 100, 6).alias("energy"))


@query(f"""WITH {_ENERGY} SELECT cell, layer, round((energy - avg(energy) OVER w) / stddev_samp(energy) OVER w, 5) AS zscore, round(energy / median(energy) OVER w, 5) AS over_median,
round((rank() OVER (PARTITION BY layer ORDER BY energy) + (count(*) OVER (PARTITION BY layer, energy) - 1) / 2.0::DOUBLE) / count(*) OVER w, 6) AS share FROM en WINDOW w AS (PARTITION BY layer)""")
def layer_energies(spark, sf_dir):
    """GRF24: energies of cells normalised within each layer in three ways."""
    e = energies(spark, sf_dir)
    named = [layers.normalised_energies(e, m).withColumnRenamed("energy", c) for m, c in (("zscore", "zscore"), ("median", "over_median"), ("rank", "share"))]
    out = named[0].join(named[1], ["cell", "layer"]).join(named[2], ["cell", "layer"])
    return out.select("cell", "layer", r("zscore", 5), r("over_median", 5), r("share"))


@query(f"""WITH {_ENERGY}, b AS (SELECT cell, layer, row_number() OVER (PARTITION BY cell ORDER BY energy DESC, CASE layer WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS k FROM en),
u AS (SELECT cell, layer, CASE WHEN layer = 'R' THEN 0 ELSE energy END AS energy FROM en), al AS (SELECT cell, layer, 0.1::DOUBLE + 1.9::DOUBLE * energy / (sum(energy) OVER (PARTITION BY cell) + 1e-10::DOUBLE) AS alpha FROM u)
SELECT al.cell, al.layer, round(alpha, 6) AS alpha, b.layer AS dominant FROM al JOIN b ON b.cell = al.cell AND b.k = 1""")
def layer_alphas(spark, sf_dir):
    """GRF24: the dominant layer of each cell, and strengths by shares of energy with one layer removed."""
    e = energies(spark, sf_dir)
    best = layers.dominant_layer(e, ["N", "A", "R"]).withColumnRenamed("layer", "dominant")
    return layers.energy_alphas(e, remove=["R"]).join(best, "cell").select("cell", "layer", r("alpha"), "dominant")


@query(f"WITH {KNN} SELECT 'near' AS sample, src, dst, round(distance, 6) AS weight FROM knn WHERE rank <= 3 UNION ALL SELECT 'far', src, dst, round(distance, 6) FROM knn WHERE rank > 7")
def joined_samples(spark, sf_dir):
    """SET06: two samples' graphs as one."""
    edges = knn(spark, sf_dir).withColumn("weight", F.round("distance", 6))
    return layers.block_diagonal({"near": edges.where("rank <= 3"), "far": edges.where("rank > 7")})


@query("WITH d AS (SELECT l_suppkey AS k, sum(l_discount) AS a, sum(l_tax) AS b FROM lineitem GROUP BY 1), x AS (SELECT row_number() OVER (ORDER BY a DESC) AS k, a FROM d), y AS (SELECT row_number() OVER (ORDER BY b DESC) AS k, b FROM d) SELECT round(corr(a, b), 6) AS correlation FROM x JOIN y USING (k)")
def spectrum_correlation(spark, sf_dir):
    """LIN19: correlation of two spectra in order."""
    d = B.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_discount").alias("a"), F.sum("l_tax").alias("b"))
    return layers.spectrum_correlation(d.select(F.col("a").alias("value")), d.select(F.col("b").alias("value"))).select(r("correlation"))


@query("SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def previewed_rows(spark, sf_dir):
    """SRC06: the first rows of a table."""
    return readers.preview(B.table(spark, sf_dir, "customer"), "c_custkey", 5)


@query(f"WITH {B.EMB} SELECT cell FROM emb WHERE label = 3 AND label IS NOT NULL")
def one_sample(spark, sf_dir):
    """SRC09: the labelled cells of one sample."""
    return readers.one_sample(B.embedding(spark, sf_dir), "label", 3, "label").select("cell")
