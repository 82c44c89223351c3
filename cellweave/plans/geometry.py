"""Queries on neighbours and spatial graphs."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.operators import graph as G
from cellweave.operators import ranks
from cellweave.operators import neighbors as NB
from cellweave.plans.registry import query
from cellweave.sources import bindings as B


def r(c, n=6):
    return F.round(c, n).alias(c)


_RADIUS = f"{B.COORDS}, e AS (SELECT a.cell AS src, b.cell AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM coords a JOIN coords b ON a.cell <> b.cell AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 30 WHERE a.x <> b.x OR a.y <> b.y)"
KNN = f"""{B.EMB}, dims AS (SELECT cell, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM emb),
pairs AS (SELECT a.cell AS src, b.cell AS dst, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS distance FROM emb a JOIN emb b ON a.cell <> b.cell),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(distance, 9), dst) AS rank FROM pairs) WHERE rank <= 10)"""


def knn(spark, sf_dir, k=10):
    return NB.nearest(B.embedding(spark, sf_dir).select("cell", "v"), k=k)


@query(f"WITH {_RADIUS} SELECT src, dst, round(distance, 6) AS distance FROM e")
def radius_graph(spark, sf_dir):
    """JON08, FLT05: all pairs of cells within 30."""
    return NB.radius_join(B.coordinates(spark, sf_dir), 30.0).select("src", "dst", r("distance"))


@query(f"WITH {_RADIUS} SELECT src, dst, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM e) WHERE rank <= 5")
def capped_radius_graph(spark, sf_dir):
    """JON11, SRT06: at most the five nearest within 30."""
    return NB.capped(NB.radius_join(B.coordinates(spark, sf_dir), 30.0), 5).select("src", "dst", r("distance"), F.col("rank").cast("long"))


@query(f"WITH {_RADIUS}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM e) SELECT src, dst, round((1 / distance) / sum(1 / distance) OVER (PARTITION BY src), 6) AS weight FROM k WHERE rank <= 5")
def directed_spatial_graph(spark, sf_dir):
    """GRF05, NUM12: radius-capped neighbours with reciprocal weights, rows normalised, not symmetrised."""
    edges = NB.capped(NB.radius_join(B.coordinates(spark, sf_dir), 30.0), 5).select("src", "dst", (1 / F.col("distance")).alias("weight"))
    return G.row_normalised(edges).select("src", "dst", r("weight"))


_SECTIONS = f"""{B.COORDS}, p AS (SELECT a.cell AS src, b.cell AS dst, a.section AS s1, b.section AS s2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM coords a JOIN coords b ON a.cell <> b.cell),
o AS (SELECT section, lead(section) OVER (ORDER BY section) AS next FROM (SELECT DISTINCT section FROM coords))"""


@query(f"WITH {_SECTIONS} SELECT src, dst, round(distance, 6) AS distance, true AS same_section FROM p WHERE s1 = s2 AND distance <= 60 AND distance > 0 UNION ALL SELECT src, dst, round(distance, 6), false FROM p JOIN o ON (s1 = o.section AND s2 = o.next) OR (s2 = o.section AND s1 = o.next) WHERE distance <= 40")
def section_graph(spark, sf_dir):
    """JON10, FLT07, GRF27: neighbours within sections, and between each section and the next."""
    return NB.section_join(B.coordinates(spark, sf_dir), 60.0, 40.0).select("src", "dst", r("distance"), "same_section")


@query(f"WITH {_RADIUS}, s AS (SELECT src, median(distance) AS sigma FROM e GROUP BY src) SELECT e.src, e.dst, round(exp(-distance * distance / (a.sigma * b.sigma)), 6) AS weight FROM e JOIN s a ON a.src = e.src JOIN s b ON b.src = e.dst")
def adaptive_spatial_graph(spark, sf_dir):
    """GRF04, NUM11: Gaussian weights by the median distance in the radius."""
    edges = NB.radius_join(B.coordinates(spark, sf_dir), 30.0)
    sigma = edges.groupBy(F.col("src").alias("cell")).agg(F.median("distance").alias("sigma"))
    return G.gaussian(edges, sigma).select("src", "dst", r("weight"))


@query(f"WITH {_RADIUS}, c AS (SELECT coords.cell, count(e.dst) AS n FROM coords LEFT JOIN e ON e.src = coords.cell GROUP BY 1) SELECT n, count(*) AS cells FROM c GROUP BY n")
def spatial_degrees(spark, sf_dir):
    """AGG09, AGG32: how many cells have how many neighbours, isolated cells included."""
    points = B.coordinates(spark, sf_dir)
    n = NB.radius_join(points, 30.0).groupBy(F.col("src").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return points.select("cell").join(n, "cell", "left").fillna(0, ["n"]).groupBy("n").agg(F.count(F.lit(1)).alias("cells"))


@query(f"WITH {_RADIUS} SELECT e.src, e.dst FROM e JOIN coords a ON a.cell = e.src JOIN coords b ON b.cell = e.dst WHERE a.section = b.section")
def same_label_edges(spark, sf_dir):
    """FLT06, JON04: edges whose end points share a label."""
    points = B.coordinates(spark, sf_dir)
    ends = [points.select(F.col("cell").alias(c), F.col("section").alias(f"s_{c}")) for c in ("src", "dst")]
    return NB.radius_join(points, 30.0).join(ends[0], "src").join(ends[1], "dst").where("s_src = s_dst").select("src", "dst")


@query(f"WITH {KNN} SELECT src, dst, round(distance, 6) AS distance, rank FROM knn")
def nearest_neighbours(spark, sf_dir):
    """JON09: the ten nearest vectors of each cell."""
    return knn(spark, sf_dir).select("src", "dst", r("distance"), F.col("rank").cast("long"))


@query(f"WITH {KNN} SELECT round(median(distance), 6) AS reference FROM knn WHERE rank = 10")
def reference_distance(spark, sf_dir):
    """WIN14: the median distance of the tenth neighbour."""
    return ranks.quantiles(knn(spark, sf_dir).where("rank = 10"), "distance", [0.5]).select(F.round(F.col("q")[0], 6).alias("reference"))


_KERNEL = f"{KNN}, sig AS (SELECT src AS cell, distance AS sigma FROM knn WHERE rank = 10), w AS (SELECT knn.src, knn.dst, exp(-distance * distance / (a.sigma * b.sigma)) AS weight FROM knn JOIN sig a ON a.cell = knn.src JOIN sig b ON b.cell = knn.dst)"
SYMMETRIC = f"{_KERNEL}, sym AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM w UNION ALL SELECT dst, src, weight FROM w) GROUP BY 1, 2)"


def kernel_edges(spark, sf_dir):
    edges = knn(spark, sf_dir)
    return G.gaussian(edges, edges.where("rank = 10").select(F.col("src").alias("cell"), F.col("distance").alias("sigma")))


@query(f"WITH {SYMMETRIC} SELECT src, dst, round(weight, 6) AS weight FROM sym")
def similarity_graph(spark, sf_dir):
    """GRF01, SET05: nearest neighbours with Gaussian weights by the tenth distance, symmetrised by the maximum."""
    return G.symmetrised(kernel_edges(spark, sf_dir)).select("src", "dst", r("weight"))


@query(f"WITH {_KERNEL} SELECT src, dst, round(sum(weight) / 2, 6) AS weight FROM (SELECT src, dst, weight FROM w UNION ALL SELECT dst, src, weight FROM w) GROUP BY 1, 2")
def mean_similarity_graph(spark, sf_dir):
    """GRF01: the same, symmetrised by the mean with absent edges as 0."""
    return G.symmetrised(kernel_edges(spark, sf_dir), "mean").select("src", "dst", r("weight"))


@query(f"WITH {KNN}, n AS (SELECT src, count(*) AS n FROM knn GROUP BY src), p AS (SELECT a.src AS a, b.src AS b, count(*) AS i FROM knn a JOIN knn b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2) SELECT a, b, round(i / (na.n + nb.n - i), 6) AS jaccard FROM p JOIN n na ON na.src = a JOIN n nb ON nb.src = b WHERE i / (na.n + nb.n - i) >= 1 / 15.0::DOUBLE")
def shared_neighbour_graph(spark, sf_dir):
    """GRF03, JON20: Jaccard index of neighbour lists, pruned below 1/15."""
    return G.shared_neighbours(knn(spark, sf_dir).select("src", "dst"), 1 / 15).select("a", "b", r("jaccard"))


@query(f"WITH {B.EMB}, q AS (SELECT * FROM emb WHERE cell % 20 = 0), p AS (SELECT q.cell AS src, e.cell AS dst, sqrt(list_sum(list_transform(list_zip(q.v, e.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS d FROM q JOIN emb e ON e.cell % 20 <> 0), n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) AS k FROM p) SELECT src, dst, round(d, 6) AS distance, label FROM n JOIN emb ON emb.cell = dst WHERE k = 1")
def nearest_reference(spark, sf_dir):
    """JON12: each query point takes the label of the nearest reference point."""
    points = B.embedding(spark, sf_dir)
    found = NB.nearest(points.where("cell % 20 <> 0").select("cell", "v"), points.where("cell % 20 = 0").select("cell", "v"), k=1)
    return found.join(points.select(F.col("cell").alias("dst"), "label"), "dst").select("src", "dst", r("distance"), "label")


@query(f"WITH {KNN}, l AS (SELECT src, label, count(*) AS n FROM knn JOIN emb ON emb.cell = dst GROUP BY 1, 2) SELECT src, label FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, label) AS k FROM l) WHERE k = 1")
def neighbour_vote(spark, sf_dir):
    """AGG20, JON09: the most frequent label among each cell's neighbours, the least on ties."""
    labels = B.embedding(spark, sf_dir).select(F.col("cell").alias("dst"), "label")
    votes = knn(spark, sf_dir).join(labels, "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
    best = W.partitionBy("src").orderBy(F.desc("n"), "label")
    return votes.withColumn("k", F.row_number().over(best)).where("k = 1").select("src", "label")


@query(f"""WITH {B.COORDS}, p AS (SELECT cell, section % 2 AS sample, cell % 3 AS type, x, y FROM coords), d AS (SELECT a.cell, a.type = b.type AS same, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.sample = b.sample AND a.cell <> b.cell),
al AS (SELECT cell, d FROM (SELECT cell, d, row_number() OVER (PARTITION BY cell ORDER BY d) AS k FROM d) WHERE k = 5), sm AS (SELECT cell, d FROM (SELECT cell, d, row_number() OVER (PARTITION BY cell ORDER BY d) AS k FROM d WHERE same) WHERE k = 5),
am AS (SELECT sample, median(d) AS m FROM p JOIN al USING (cell) GROUP BY 1), e AS (SELECT sample, type, count(*) AS n, median(d) AS m FROM p LEFT JOIN sm USING (cell) GROUP BY 1, 2 HAVING count(*) >= 5),
r AS (SELECT type, e.sample, n, e.m / am.m AS ratio FROM e JOIN am ON am.sample = e.sample), w AS (SELECT *, sum(n) OVER (PARTITION BY type ORDER BY ratio, sample) AS upto, sum(n) OVER (PARTITION BY type) AS total FROM r),
t AS (SELECT type, count(*) AS samples, sum(n)::BIGINT AS cells, arg_min(ratio, upto) FILTER (WHERE upto >= total / 2) AS ratio FROM w GROUP BY type), q AS (SELECT quantile_cont(ln(1 + ratio), 0.05) AS lo, quantile_cont(ln(1 + ratio), 0.95) AS hi FROM t),
s AS (SELECT t.*, (least(greatest(ln(1 + ratio), lo), hi) - lo) / (hi - lo) AS scattered FROM t, q), q2 AS (SELECT quantile_cont(scattered, 0.05) AS a, quantile_cont(scattered, 0.95) AS b FROM s), u AS (SELECT s.*, (least(greatest(scattered, a), b) - a) / (b - a) AS z FROM s, q2)
SELECT type, samples, cells, round(ratio, 6) AS ratio, round(scattered, 6) AS scattered, round(1.2::DOUBLE + (1 - z) * 2.6::DOUBLE, 6) AS penalty, round_even(20 + z * 40, 0)::INT AS candidate_k, round_even(10 + z * 20, 0)::INT AS attention_k FROM u""")
def adaptive_parameters(spark, sf_dir):
    """GRF11: spatial parameters of each cell type by how clumped it lies in its samples."""
    at = B.coordinates(spark, sf_dir).select("cell", F.array("x", "y").alias("v"), (F.col("section") % 2).alias("sample"), (F.col("cell") % 3).alias("type"))
    kth = lambda grp, name: NB.nearest(at.select("cell", "v", grp.alias("grp")), k=5).where("rank = 5").select(F.col("src").alias("cell"), F.col("distance").alias(name))
    distances = kth(F.col("sample"), "all_kth").join(kth(F.col("sample") * 3 + F.col("type"), "same_kth"), "cell", "left")
    return NB.adaptive_parameters(at.select("cell", "sample", "type"), distances, least_cells=5).select("type", "samples", "cells", r("ratio"), r("scattered"), r("penalty"), "candidate_k", "attention_k")
