"""Queries on weighted graphs: transitions, diffusion, energies, Laplacians, attention."""

from pyspark.sql import functions as F

from cellweave.functions import numeric as N
from cellweave.operators import graph as G
from cellweave.operators import ranks
from cellweave.plans.geometry import KNN, SYMMETRIC, kernel_edges, knn
from cellweave.plans.registry import query
from cellweave.sources import bindings as B


def r(c, n=6):
    return F.round(c, n).alias(c)


def symmetric(spark, sf_dir):
    return G.symmetrised(kernel_edges(spark, sf_dir))


#: Symmetrised kernel graph, its five heaviest edges a row, A + A^T, diagonal, row sums 1.
_TRANSITION = f"""{SYMMETRIC}, top AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM sym) WHERE k <= 5),
summed AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM top UNION ALL SELECT dst, src, weight FROM top) GROUP BY 1, 2),
diag AS (SELECT src, dst, weight FROM summed UNION ALL SELECT src, src, max(weight) FROM summed GROUP BY src), tr AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS weight FROM diag)"""
_VALUES = "x AS (SELECT cell, gene, value FROM (SELECT vec_id AS cell, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) AS gene FROM embeddings))"


def values(spark, sf_dir):
    rows = B.embedding(spark, sf_dir).select("cell", F.posexplode("v").alias("gene", "value"))
    return rows.select("cell", (F.col("gene") + 1).cast("long").alias("gene"), "value")


@query(f"WITH {_TRANSITION} SELECT src, dst, round(weight, 6) AS weight FROM tr")
def transition_matrix(spark, sf_dir):
    """GRF12, WIN04, WIN05: row-stochastic transitions from a similarity graph."""
    return G.transition(symmetric(spark, sf_dir), 5).select("src", "dst", r("weight"))


@query(f"""WITH {_TRANSITION}, {_VALUES}, s1 AS (SELECT tr.src AS cell, gene, sum(weight * value) AS value FROM tr JOIN x ON x.cell = tr.dst GROUP BY 1, 2),
s2 AS (SELECT tr.src AS cell, gene, sum(weight * value) AS value FROM tr JOIN s1 x ON x.cell = tr.dst GROUP BY 1, 2) SELECT cell, gene, round(value, 6) AS value FROM s2""")
def diffused_values(spark, sf_dir):
    """GRF14: two steps of diffusion."""
    return G.diffused(G.transition(symmetric(spark, sf_dir), 5), values(spark, sf_dir), 2).select("cell", "gene", r("value"))


@query(f"""WITH {_TRANSITION}, {_VALUES}, s1 AS (SELECT tr.src AS cell, gene, sum(weight * value) AS value FROM tr JOIN x ON x.cell = tr.dst GROUP BY 1, 2)
SELECT x.gene, round(sum((x.value - s1.value) * (x.value - s1.value)) / (sum(x.value * x.value) - sum(x.value) * sum(x.value) / count(*)), 6) AS change FROM x JOIN s1 ON s1.cell = x.cell AND s1.gene = x.gene GROUP BY x.gene""")
def diffusion_change(spark, sf_dir):
    """GRF15: squared change of one step over the total sum of squares."""
    x = values(spark, sf_dir)
    after = G.diffused(G.transition(symmetric(spark, sf_dir), 5), x, 1).withColumnRenamed("value", "after")
    v, d = F.col("value"), F.col("value") - F.col("after")
    return x.join(after, ["cell", "gene"]).groupBy("gene").agg(F.round(F.sum(d * d) / (F.sum(v * v) - F.sum(v) * F.sum(v) / F.count(F.lit(1))), 6).alias("change"))


@query(f"""WITH {SYMMETRIC}, {_VALUES}, deg AS (SELECT src, sum(weight) AS d FROM sym GROUP BY src), nb AS (SELECT sym.src AS cell, gene, sum(weight * value) AS s FROM sym JOIN x ON x.cell = sym.dst GROUP BY 1, 2)
SELECT x.cell, x.gene, round(0.3::DOUBLE * value + 0.7::DOUBLE * coalesce(s / d, 0), 6) AS value FROM x LEFT JOIN nb ON nb.cell = x.cell AND nb.gene = x.gene LEFT JOIN deg ON deg.src = x.cell""")
def smoothed_values(spark, sf_dir):
    """GRF09: own value blended with the neighbours' mean."""
    return G.smoothed(symmetric(spark, sf_dir), values(spark, sf_dir), 0.3).select("cell", "gene", r("value"))


@query(f"WITH {SYMMETRIC}, en AS (SELECT sym.src AS cell, 0.5::DOUBLE * sum(weight * list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) / sum(weight) AS energy FROM sym JOIN emb a ON a.cell = sym.src JOIN emb b ON b.cell = sym.dst GROUP BY 1) SELECT cell, round(energy, 6) AS energy, round(energy / ((SELECT median(energy) FROM en) + 1e-10::DOUBLE), 6) AS relative FROM en")
def dirichlet_energies(spark, sf_dir):
    """GRF19, GRF20, GRF21: energy of each node, and over the median."""
    energy = G.dirichlet_energy(symmetric(spark, sf_dir), B.embedding(spark, sf_dir))
    median = ranks.quantiles(energy, "energy", [0.5]).select((F.col("q")[0] + 1e-10).alias("m"))
    return energy.join(F.broadcast(median)).select("cell", r("energy"), F.round(F.col("energy") / F.col("m"), 6).alias("relative"))


@query(f"WITH {SYMMETRIC}, d AS (SELECT src, sum(weight) AS d FROM sym GROUP BY src) SELECT sym.src, sym.dst, round(-weight / sqrt(a.d * b.d), 6) AS weight FROM sym JOIN d a ON a.src = sym.src JOIN d b ON b.src = sym.dst UNION ALL SELECT src, src, 1.0::DOUBLE FROM d")
def symmetric_laplacian(spark, sf_dir):
    """LIN06"""
    return G.laplacian(symmetric(spark, sf_dir)).select("src", "dst", r("weight"))


@query(f"WITH {SYMMETRIC}, d AS (SELECT src, sum(weight) AS d FROM sym GROUP BY src) SELECT sym.src, sym.dst, round(-weight / d, 6) AS weight FROM sym JOIN d ON d.src = sym.src UNION ALL SELECT src, src, 1.0::DOUBLE FROM d")
def random_walk_laplacian(spark, sf_dir):
    """LIN07"""
    return G.laplacian(symmetric(spark, sf_dir), "random_walk").select("src", "dst", r("weight"))


@query(f"WITH {SYMMETRIC}, {_VALUES}, q AS (SELECT a.gene, sum(weight * (a.value - b.value) * (a.value - b.value)) / 2 AS q FROM sym JOIN x a ON a.cell = sym.src JOIN x b ON b.cell = sym.dst AND b.gene = a.gene GROUP BY 1), s AS (SELECT gene, sum(value * value) AS s FROM x GROUP BY gene), b AS (SELECT q.gene, q / s AS roughness FROM q JOIN s ON s.gene = q.gene) SELECT gene, round(roughness, 6) AS roughness FROM b")
def gene_roughness(spark, sf_dir):
    """LIN14: quadratic form of each gene on the graph."""
    return G.roughness(symmetric(spark, sf_dir), values(spark, sf_dir)).select("gene", r("roughness"))


@query(f"WITH {SYMMETRIC}, p AS (SELECT a.label, sum(CASE WHEN a.label = b.label THEN weight ELSE 0 END) AS i, sum(weight) AS s FROM sym JOIN emb a ON a.cell = sym.src JOIN emb b ON b.cell = sym.dst GROUP BY 1), m AS (SELECT sum(s) AS m FROM p) SELECT round(sum(i / m - (s / m) * (s / m)), 6) AS modularity FROM p, m")
def label_modularity(spark, sf_dir):
    """MDL09"""
    return G.modularity(symmetric(spark, sf_dir), B.embedding(spark, sf_dir).select("cell", "label")).select(r("modularity"))


_WEIGHTS = [(-1) ** k * (k + 1) / 10 for k in range(64)], [(k % 5) / 10 for k in range(64)]
_ATTENTION = f"""{KNN}, att AS (SELECT src, dst, 1 / (1 + exp(-(a.s + b.t))) AS z FROM knn JOIN (SELECT cell, list_sum(list_transform(list_zip(v, [{", ".join(f"{w!r}::DOUBLE" for w in _WEIGHTS[0])}]), lambda t: t[1] * t[2])) AS s FROM emb) a ON a.cell = src
JOIN (SELECT cell, list_sum(list_transform(list_zip(v, [{", ".join(f"{w!r}::DOUBLE" for w in _WEIGHTS[1])}]), lambda t: t[1] * t[2])) AS t FROM emb) b ON b.cell = dst), aw AS (SELECT src, dst, exp(z) / sum(exp(z)) OVER (PARTITION BY src) AS weight FROM att)"""


def attention(spark, sf_dir):
    return G.attention(knn(spark, sf_dir).select("src", "dst"), B.embedding(spark, sf_dir).select("cell", "v"), *_WEIGHTS)


@query(f"WITH {_ATTENTION} SELECT src, dst, round(weight, 6) AS weight FROM aw")
def attention_weights(spark, sf_dir):
    """MDL04, NUM16: one attention layer over the neighbour graph."""
    return attention(spark, sf_dir).select("src", "dst", r("weight"))


@query(f"WITH {_ATTENTION}, p AS (SELECT aw.src, aw.dst, weight FROM aw JOIN emb a ON a.cell = aw.src JOIN emb b ON b.cell = aw.dst WHERE a.label = b.label), u AS (SELECT src, dst, 0.75::DOUBLE * weight AS weight FROM aw UNION ALL SELECT src, dst, 0.25::DOUBLE * weight FROM p) SELECT src, dst, round(sum(weight), 6) AS weight FROM u GROUP BY 1, 2")
def blended_attention(spark, sf_dir):
    """MDL05, FLT06: full attention blended with that over edges inside labels."""
    full = attention(spark, sf_dir)
    labels = [B.embedding(spark, sf_dir).select(F.col("cell").alias(c), F.col("label").alias(f"l_{c}")) for c in ("src", "dst")]
    inside = full.join(labels[0], "src").join(labels[1], "dst").where("l_src = l_dst").select("src", "dst", "weight")
    return G.blended_attention(full, inside, 0.25).select("src", "dst", r("weight"))


@query(f"WITH {_ATTENTION} SELECT src AS cell, count(*) AS n, round(1 / sum(weight * weight), 6) AS effective, round(max(weight), 6) AS largest FROM aw GROUP BY src")
def attention_by_cell(spark, sf_dir):
    """AGG13"""
    return G.attention_summary(attention(spark, sf_dir)).select("cell", "n", r("effective"), r("largest"))


@query(f"WITH {_ATTENTION} SELECT a.label AS l1, b.label AS l2, round(sum(weight), 6) AS total, round(avg(weight), 6) AS mean, count(*) AS n FROM aw JOIN emb a ON a.cell = aw.src JOIN emb b ON b.cell = aw.dst GROUP BY 1, 2")
def attention_by_labels(spark, sf_dir):
    """AGG15, JON21: attention between pairs of labels."""
    ends = [B.embedding(spark, sf_dir).select(F.col("cell").alias(c), F.col("label").alias(n)) for c, n in (("src", "l1"), ("dst", "l2"))]
    return attention(spark, sf_dir).join(ends[0], "src").join(ends[1], "dst").groupBy("l1", "l2").agg(F.round(F.sum("weight"), 6).alias("total"), F.round(F.avg("weight"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ATTENTION} SELECT count(*) AS edges, round(avg(CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS same, round(avg(weight) FILTER (WHERE a.label = b.label), 6) AS same_mean, round(median(weight), 6) AS median FROM aw JOIN emb a ON a.cell = aw.src JOIN emb b ON b.cell = aw.dst")
def attention_overview(spark, sf_dir):
    """AGG16"""
    ends = [B.embedding(spark, sf_dir).select(F.col("cell").alias(c), F.col("label").alias(n)) for c, n in (("src", "l1"), ("dst", "l2"))]
    same = F.col("l1") == F.col("l2")
    rows = attention(spark, sf_dir)
    sums = rows.join(ends[0], "src").join(ends[1], "dst").agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg(same.cast("double")), 6).alias("same"), F.round(F.avg(F.when(same, F.col("weight"))), 6).alias("same_mean"))
    return sums.join(F.broadcast(ranks.quantiles(rows, "weight", [0.5]).select(F.round(F.col("q")[0], 6).alias("median"))))


@query(f"WITH {KNN}, c AS (SELECT src, dst, list_sum(list_transform(list_zip(a.v, b.v), lambda t: t[1] * t[2])) / (sqrt(list_sum(list_transform(a.v, lambda t: t * t))) * sqrt(list_sum(list_transform(b.v, lambda t: t * t)))) AS cosine FROM knn JOIN emb a ON a.cell = src JOIN emb b ON b.cell = dst), q AS (SELECT median(cosine) AS m, quantile_cont(cosine, 0.75) - quantile_cont(cosine, 0.25) AS iqr FROM c) SELECT src, dst, round(cosine, 6) AS cosine, round(1 / (1 + exp(-(4 / iqr) * (cosine - m))), 6) AS gate FROM c, q")
def reweighted_graph(spark, sf_dir):
    """GRF07, GRF08, ARR06, NUM13: edges gated by the cosine of their end points, centre and slope from the data."""
    ends = [B.embedding(spark, sf_dir).select(F.col("cell").alias(c), F.col("v").alias(f"v_{c}")) for c in ("src", "dst")]
    cosine = knn(spark, sf_dir).join(ends[0], "src").join(ends[1], "dst").select("src", "dst", N.cosine(F.col("v_src"), F.col("v_dst")).alias("cosine"))
    q = ranks.quantiles(cosine, "cosine", [0.25, 0.5, 0.75])
    gate = N.sigmoid(F.col("cosine"), F.col("q")[1], 4 / (F.col("q")[2] - F.col("q")[0]))
    return cosine.join(F.broadcast(q)).select("src", "dst", r("cosine"), F.round(gate, 6).alias("gate"))


@query(f"WITH {SYMMETRIC} SELECT src AS a, dst AS b, round(weight * 2, 6) AS weight FROM sym WHERE src < dst")
def undirected_edges(spark, sf_dir):
    """AGG24, SRT09: both directions summed into one undirected edge."""
    return G.undirected(symmetric(spark, sf_dir)).select("a", "b", r("weight"))


@query(f"WITH {SYMMETRIC} SELECT src AS cell, count(*) AS degree, round(sum(weight), 6) AS strength FROM sym GROUP BY src")
def node_strengths(spark, sf_dir):
    """AGG32"""
    return G.degrees(symmetric(spark, sf_dir)).select("cell", "degree", r("strength"))


_SPECTRUM = "sp AS (SELECT l_suppkey AS k, sum(l_discount) / (SELECT max(s) FROM (SELECT sum(l_discount) AS s FROM lineitem GROUP BY l_suppkey)) * 2 AS lam FROM lineitem GROUP BY 1)"


@query(f"WITH {_SPECTRUM}, m AS (SELECT max(lam) AS m FROM sp), g AS (SELECT k, exp(-1.5::DOUBLE * lam) AS heat, 1 / (1 + 1.5::DOUBLE * lam) AS tikhonov, lam / m * exp(1 - lam / m) AS wavelet, exp(-pow((lam / m - 0.5::DOUBLE) / 0.2::DOUBLE, 2)) AS bandpass, 1 / sqrt(1 + pow(lam / m / 0.5::DOUBLE, 4)) AS butterworth FROM sp, m) SELECT k, round(heat / max(heat) OVER (), 6) AS heat, round(tikhonov / max(tikhonov) OVER (), 6) AS tikhonov, round(wavelet / max(wavelet) OVER (), 6) AS wavelet, round(bandpass / max(bandpass) OVER (), 6) AS bandpass, round(butterworth / max(butterworth) OVER (), 6) AS butterworth FROM g")
def filter_gains(spark, sf_dir):
    """NUM21: gains of five graph filters over a spectrum, each over its maximum."""
    kinds = ["heat", "tikhonov", "wavelet", "bandpass", "butterworth"]
    sums = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_discount").alias("s"))
    spectrum = sums.join(F.broadcast(sums.agg(F.max("s").alias("m")))).select("k", (F.col("s") / F.col("m") * 2).alias("lam"))
    spectrum = spectrum.join(F.broadcast(spectrum.agg(F.max("lam").alias("top"))))
    gains = spectrum.select("k", *[N.filter_gain(g, F.col("lam"), F.col("top"), t=1.5).alias(g) for g in kinds])
    best = gains.agg(*[F.max(g).alias(f"m_{g}") for g in kinds])
    return gains.join(F.broadcast(best)).select("k", *[F.round(F.col(g) / F.col(f"m_{g}"), 6).alias(g) for g in kinds])


@query(f"WITH {_SPECTRUM}, o AS (SELECT k, lam, row_number() OVER (ORDER BY lam DESC, k) AS n FROM sp), c AS (SELECT n, sum(lam) OVER (ORDER BY n) / sum(lam) OVER () AS share, lam - lead(lam) OVER (ORDER BY n) AS gap FROM o) SELECT n, round(share, 6) AS share, round(gap, 6) AS gap, n = (SELECT min(n) FROM c WHERE share >= 0.95::DOUBLE) AS cutoff FROM c")
def energy_cutoff(spark, sf_dir):
    """WIN10, WIN11, LIN04, LIN16: gaps and cumulative energy of a spectrum, and the first index that reaches 95 per cent."""
    sums = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_discount").alias("s"))
    rows = sums.join(F.broadcast(sums.agg(F.max("s").alias("m")))).select("k", (F.col("s") / F.col("m") * 2).alias("lam"))
    rows = ranks.running(ranks.numbered(rows, F.desc("lam"), "k", name="n"), "lam", "n", name="upto", total="all")
    rows = rows.select("n", "lam", (F.col("upto") / F.col("all")).alias("share"))
    following = rows.select((F.col("n") - 1).alias("n"), F.col("lam").alias("following"))
    first = rows.where("share >= 0.95").agg(F.min("n").alias("first"))
    out = rows.join(following, "n", "left").join(F.broadcast(first))
    return out.select("n", r("share"), F.round(F.col("lam") - F.col("following"), 6).alias("gap"), (F.col("n") == F.col("first")).alias("cutoff"))
