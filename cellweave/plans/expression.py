"""Queries on expression tables."""

from pyspark.sql import functions as F

from cellweave.functions import numeric as N
from cellweave.operators import expression as X
from cellweave.operators import ranks
from cellweave.operators.regulon import scaled
from cellweave.plans.registry import query
from cellweave.sources import bindings as B

_LIB = f"{B.EXPR}, lib AS (SELECT cell, sum(value) AS library FROM expr GROUP BY cell), med AS (SELECT median(library) AS scale FROM lib), n AS (SELECT count(DISTINCT cell) AS n FROM expr)"
_DENSE = f"{_LIB}, dense AS (SELECT c.cell, g.gene, coalesce(e.value, 0) AS value FROM (SELECT DISTINCT cell FROM expr) c CROSS JOIN (SELECT DISTINCT gene FROM expr) g LEFT JOIN expr e ON e.cell = c.cell AND e.gene = g.gene)"


def r(c, n=6):
    return F.round(c, n).alias(c)


@query(f"WITH {_LIB} SELECT cell, round(library, 6) AS library, round((SELECT scale FROM med), 6) AS scale FROM lib")
def library_sizes(spark, sf_dir):
    """AGG01: library size of each cell, and their median."""
    rows = X.library_sizes(B.expression(spark, sf_dir))
    return rows.join(F.broadcast(ranks.quantiles(rows, "library", [0.5]).select(F.col("q")[0].alias("scale")))).select("cell", r("library"), r("scale"))


@query(f"WITH {B.EXPR} SELECT cell, gene, round(value, 6) AS value FROM expr WHERE gene IN (SELECT gene FROM expr WHERE value > 100 GROUP BY gene HAVING count(*) >= 3)")
def detected_genes(spark, sf_dir):
    """FLT02, SRC01: genes that enough cells express."""
    expr = B.expression(spark, sf_dir)
    kept = X.detected_genes(expr.withColumn("value", F.col("value") - 100), 3).select("cell", "gene", (F.col("value") + 100).alias("value"))
    return kept.select("cell", "gene", r("value"))


@query(f"WITH {_LIB} SELECT cell, gene, round(value * scale / library, 6) AS value, round(sqrt(value * scale / library) + sqrt(value * scale / library + 1), 6) AS transformed FROM expr JOIN lib USING (cell), med")
def normalised_expression(spark, sf_dir):
    """NUM04, NUM05: median normalisation and the Freeman-Tukey transform."""
    rows = X.median_normalised(B.expression(spark, sf_dir))
    return rows.select("cell", "gene", r("value"), F.round(N.freeman_tukey(F.col("value")), 6).alias("transformed"))


@query(f"WITH {B.LAYERS}, lib AS (SELECT cell, sum(total) AS library FROM layers GROUP BY cell) SELECT cell, gene, round(ln(1 + rb * (SELECT median(library) FROM lib) / library), 6) AS value FROM layers JOIN lib USING (cell) WHERE library > 0")
def assay_normalised(spark, sf_dir):
    """NUM06, NUM07, JON17: the bound layer over the total library, log(1 + x)."""
    rows = B.layers(spark, sf_dir)
    library = rows.groupBy("cell").agg(F.sum("total").alias("library")).where("library > 0")
    out = X.median_normalised(rows.select("cell", "gene", F.col("rb").alias("value")), library)
    return out.select("cell", "gene", F.round(F.log1p("value"), 6).alias("value"))


@query(f"WITH {B.LAYERS} SELECT cell, gene, round(rb / (total + 1e-6::DOUBLE), 6) AS te_total, round(rb / (rb + (total - rb) + 1e-6::DOUBLE), 6) AS te_layers, round(rb / (total + 1e-6::DOUBLE) * (total / (total + 50)), 6) AS te_confident FROM layers")
def translation_efficiency(spark, sf_dir):
    """NUM08, SRC08: three definitions of translation efficiency."""
    rows = B.layers(spark, sf_dir)
    total, rb = F.col("total"), F.col("rb")
    return rows.select("cell", "gene", F.round(N.translation_efficiency(rb, total), 6).alias("te_total"), F.round(N.translation_efficiency(rb, rb + (total - rb)), 6).alias("te_layers"),
                       F.round(N.translation_efficiency(rb, total) * N.saturation(total, F.lit(50.0)), 6).alias("te_confident"))


@query(f"WITH {B.LAYERS}, te AS (SELECT rb / (total + 1e-6::DOUBLE) AS te, gene FROM layers) SELECT gene, round(quantile_cont(te, 0.25), 6) AS q25, round(median(te), 6) AS q50, round(quantile_cont(te, 0.99), 6) AS q99, round(avg(CASE WHEN te > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS above FROM te GROUP BY gene")
def te_quantiles(spark, sf_dir):
    """AGG31, AGG11: quantiles of translation efficiency and the share in the tail."""
    rows = B.layers(spark, sf_dir).select("gene", N.translation_efficiency(F.col("rb"), F.col("total")).alias("te"))
    q = lambda p: F.round(F.percentile("te", p), 6)
    return rows.groupBy("gene").agg(q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.99).alias("q99"), F.round(F.avg((F.col("te") > 0.5).cast("double")), 6).alias("above"))


@query(f"""WITH {B.LAYERS}, tau AS (SELECT gene, quantile_cont(total, 0.25) FILTER (WHERE total > 100) + 1e-8::DOUBLE AS tau FROM layers GROUP BY gene)
SELECT cell, gene, CASE WHEN tau IS NULL THEN 0::DOUBLE ELSE round(total / (total + tau), 6) END AS weight FROM layers JOIN tau USING (gene)""")
def saturation_weights(spark, sf_dir):
    """NUM09: saturation by the 25 per cent quantile over detected cells; weight 0 where there is none."""
    rows = B.layers(spark, sf_dir)
    tau = rows.groupBy("gene").agg((F.percentile(F.when(F.col("total") > 100, F.col("total")), 0.25) + 1e-8).alias("tau"))
    return rows.join(tau, "gene").select("cell", "gene", F.round(N.saturation(F.col("total"), F.col("tau")), 6).alias("weight"))


@query(f"""WITH {B.LAYERS}, s AS (SELECT gene, median(total) AS med, count(*) AS n FROM layers WHERE total > 0 GROUP BY gene HAVING count(*) >= 5),
tau AS (SELECT gene, any_value(med) + 1.4826::DOUBLE * median(abs(total - med)) AS tau FROM layers JOIN s USING (gene) WHERE total > 0 GROUP BY gene)
SELECT cell, gene, round(ln(1 + total) / (ln(1 + total) + ln(1 + tau)), 6) AS confidence FROM layers JOIN tau USING (gene)""")
def te_confidence(spark, sf_dir):
    """NUM10: evidence log(1 + x), threshold median + MAD, Michaelis form."""
    rows = B.layers(spark, sf_dir)
    seen = rows.where("total > 0")
    centre = seen.groupBy("gene").agg(F.median("total").alias("med"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    tau = seen.join(centre, "gene").groupBy("gene").agg((F.max("med") + 1.4826 * F.median(F.abs(F.col("total") - F.col("med")))).alias("tau"))
    evidence = F.log1p("total")
    return rows.join(tau, "gene").select("cell", "gene", F.round(evidence / (evidence + F.log1p("tau")), 6).alias("confidence"))


@query(f"""WITH {_LIB} SELECT gene, count(*) FILTER (WHERE value <> 0) AS detected, round(sum(value) / max(n), 6) AS mean, round(sum(value * value) / max(n) - (sum(value) / max(n)) * (sum(value) / max(n)), 4) AS variance,
round(avg(value) FILTER (WHERE value <> 0), 6) AS nonzero_mean, round(stddev_samp(value) FILTER (WHERE value <> 0), 6) AS nonzero_sd FROM expr, n GROUP BY gene""")
def gene_moments(spark, sf_dir):
    """AGG25, AGG26: moments of each gene with implicit zeros."""
    return X.gene_moments(B.expression(spark, sf_dir)).select("gene", "detected", r("mean"), r("variance", 4), r("nonzero_mean"), r("nonzero_sd"))


@query(f"WITH {_DENSE} SELECT gene, round(quantile_cont(value, 0.99), 6) AS q99 FROM dense GROUP BY gene")
def gene_quantiles(spark, sf_dir):
    """AGG25, GRF17: the 99 per cent quantile of each gene over all cells."""
    return X.gene_quantile(B.expression(spark, sf_dir), 0.99, "q99").select("gene", r("q99"))


@query(f"WITH {B.EXPR}, d AS (SELECT cell, gene, value FROM expr WHERE (cell + gene) % 3 <> 0), g AS (SELECT DISTINCT cell FROM d), h AS (SELECT DISTINCT gene FROM d) SELECT g.cell, h.gene, round(coalesce(d.value, 0), 6) AS value FROM g CROSS JOIN h LEFT JOIN d ON d.cell = g.cell AND d.gene = h.gene")
def completed_grid(spark, sf_dir):
    """JON15: all pairs of cells and genes, zero where nothing was measured."""
    rows = X.densified(B.expression(spark, sf_dir).where("(cell + gene) % 3 <> 0"))
    return rows.select("cell", "gene", r("value"))


@query(f"""WITH {_LIB}, m AS (SELECT gene, round(sum(value * value) / max(n) - (sum(value) / max(n)) * (sum(value) / max(n)), 6) AS variance FROM expr, n GROUP BY gene)
SELECT gene, round(variance, 4) AS variance FROM (SELECT *, row_number() OVER (ORDER BY variance DESC, gene) AS k FROM m WHERE variance > 0) WHERE k <= 20""")
def variable_genes(spark, sf_dir):
    """SRT07, MDL15: the 20 most variable genes."""
    return X.variable_genes(B.expression(spark, sf_dir), 20).select("gene", r("variance", 4))


@query(f"""WITH {_DENSE}, imp AS (SELECT cell, gene, value * 0.5::DOUBLE + 3 AS value FROM expr), idense AS (SELECT dense.cell, dense.gene, coalesce(imp.value, 0) AS value FROM dense LEFT JOIN imp ON imp.cell = dense.cell AND imp.gene = dense.gene),
f AS (SELECT gene, (SELECT quantile_cont(d.value, 0.99) FROM dense d WHERE d.gene = i.gene) / (quantile_cont(value, 0.99) + 1e-8::DOUBLE) AS factor FROM idense i GROUP BY gene)
SELECT cell, gene, round(value * factor, 5) AS value FROM imp JOIN f USING (gene)""")
def rescaled_imputation(spark, sf_dir):
    """GRF16, GRF17: imputed values scaled so that upper quantiles agree with the measured ones."""
    expr = B.expression(spark, sf_dir)
    return X.rescaled_to_reference(expr.withColumn("value", F.col("value") * 0.5 + 3), expr).select("cell", "gene", r("value", 5))


@query(f"""WITH {B.EXPR}, imp AS (SELECT cell, gene, sqrt(value) AS value FROM expr), b AS (SELECT gene, min(value) AS lo, max(value) AS hi FROM expr GROUP BY gene), i AS (SELECT gene, min(value) AS lo, max(value) AS hi FROM imp GROUP BY gene)
SELECT cell, gene, round(b.lo + CASE WHEN i.hi > i.lo THEN (value - i.lo) / (i.hi - i.lo) ELSE 0 END * (b.hi - b.lo), 6) AS value FROM imp JOIN i USING (gene) JOIN b USING (gene)""")
def range_mapped_imputation(spark, sf_dir):
    """GRF18: each gene's imputed values mapped to the range of the measured ones."""
    expr = B.expression(spark, sf_dir)
    bounds = expr.groupBy("gene").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = scaled(expr.withColumn("value", F.sqrt("value")), "value", "share", "gene").join(bounds, "gene")
    return rows.select("cell", "gene", F.round(F.col("lo") + F.col("share") * (F.col("hi") - F.col("lo")), 6).alias("value"))


@query(f"""WITH {B.EXPR}, grp AS (SELECT s_suppkey AS cell, s_nationkey::BIGINT AS grp FROM supplier), sizes AS (SELECT grp, count(*) AS n FROM grp GROUP BY grp),
m AS (SELECT sizes.grp, d.gene, coalesce(sum(value), 0) / max(n) AS mean, count(*) FILTER (WHERE value > 0) / max(n) AS pct FROM sizes CROSS JOIN (SELECT DISTINCT gene FROM expr) d
  LEFT JOIN (SELECT expr.*, grp FROM expr JOIN grp USING (cell)) e ON e.grp = sizes.grp AND e.gene = d.gene GROUP BY sizes.grp, d.gene)
SELECT grp, gene, round(mean, 6) AS mean, round(pct, 6) AS pct, round(greatest(-2::DOUBLE, least(2::DOUBLE, coalesce((mean - avg(mean) OVER (PARTITION BY gene)) / nullif(stddev_samp(mean) OVER (PARTITION BY gene), 0), 0))), 5) AS z FROM m""")
def marker_profiles(spark, sf_dir):
    """AGG12, NUM14, FLT14: mean, share expressing and z-score of each gene across groups of cells."""
    groups = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").cast("long").alias("grp"))
    return X.marker_profile(B.expression(spark, sf_dir), groups).select("grp", "gene", r("mean"), r("pct"), r("z", 5))


@query(f"""WITH {B.EXPR}, low AS (SELECT cell, gene, value - 60 AS value FROM expr), orig AS (SELECT cell, gene, value FROM expr WHERE value > 70),
c AS (SELECT gene, abs(quantile_cont(value, 0.001)) AS cut FROM low GROUP BY gene), k AS (SELECT cell, gene, CASE WHEN value > cut THEN value END AS kept FROM low JOIN c USING (gene)),
o AS (SELECT *, avg(kept) OVER (PARTITION BY gene) AS m, stddev_samp(kept) OVER (PARTITION BY gene) AS s FROM k), t AS (SELECT gene, avg(value) AS m0, stddev_samp(value) AS s0 FROM orig GROUP BY gene),
v AS (SELECT o.cell, o.gene, greatest(coalesce(CASE WHEN s IS NULL OR s = 0 OR s0 IS NULL THEN kept ELSE (kept - m) * s0 / s + m0 END, 0), 0) AS value, orig.value AS v0 FROM o LEFT JOIN t ON t.gene = o.gene LEFT JOIN orig ON orig.cell = o.cell AND orig.gene = o.gene)
SELECT cell, gene, round(CASE WHEN value = 0 AND coalesce(v0, 0) > 0 THEN v0 ELSE value END, 4) AS value FROM v""")
def completed_expression(spark, sf_dir):
    """LIN05: thresholds, moment matching and restored values of a low-rank completion."""
    expr = B.expression(spark, sf_dir)
    return X.restored_low_rank(expr.withColumn("value", F.col("value") - 60), expr.where("value > 70")).select("cell", "gene", r("value", 4))


@query(f"WITH {_LIB} SELECT count(*) AS n, round(avg(CASE WHEN value > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.99), 6) AS q99, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS low, round(max(value), 6) AS high FROM expr")
def value_distribution(spark, sf_dir):
    """AGG30, SRC05: moments and quantiles of all values."""
    expr = B.expression(spark, sf_dir)
    sums = expr.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") > 100).cast("double")), 6).alias("share"),
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"),
    )
    q = ranks.quantiles(expr, "value", [0.25, 0.99]).select(F.round(F.col("q")[0], 6).alias("q25"), F.round(F.col("q")[1], 6).alias("q99"))
    return sums.join(F.broadcast(q))


@query(f"WITH {B.LAYERS}, t AS (SELECT cell, rank() OVER (ORDER BY total) + (count(*) OVER (PARTITION BY total) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY rb) + (count(*) OVER (PARTITION BY rb) - 1) / 2.0::DOUBLE AS b, total, rb FROM (SELECT cell, sum(total) AS total, sum(rb) AS rb FROM layers GROUP BY cell)) SELECT round(corr(total, rb), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM t")
def layer_correlation(spark, sf_dir):
    """AGG28, WIN13, JON18: Pearson and Spearman correlation of two layers' cell totals."""
    rows = B.layers(spark, sf_dir).groupBy("cell").agg(F.sum("total").alias("total"), F.sum("rb").alias("rb"))
    rows = rows.join(ranks.average_ranks(rows, "total", "a"), "total").join(ranks.average_ranks(rows, "rb", "b"), "rb")
    return rows.agg(F.round(F.corr("total", "rb"), 6).alias("pearson"), F.round(F.corr("a", "b"), 6).alias("spearman"))


@query(f"""WITH {B.EXPR}, q AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi, median(value) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM expr)
SELECT cell, gene, round((least(greatest(value, lo), hi) - lo) / (hi - lo), 6) AS clipped, round(1 / (1 + exp(-(4 / iqr) * (value - med))), 6) AS gate FROM expr, q""")
def clipped_and_gated(spark, sf_dir):
    """WIN18, NUM13, NUM19, FLT11: quantile-clipped range and an adaptive sigmoid gate."""
    expr = B.expression(spark, sf_dir)
    q = ranks.quantiles(expr, "value", [0.05, 0.25, 0.5, 0.75, 0.95])
    at = lambda k: F.col("q")[k]
    clipped = (F.least(F.greatest("value", at(0)), at(4)) - at(0)) / (at(4) - at(0))
    gate = N.sigmoid(F.col("value"), at(2), 4 / (at(3) - at(1)))
    return expr.join(F.broadcast(q)).select("cell", "gene", F.round(clipped, 6).alias("clipped"), F.round(gate, 6).alias("gate"))


@query(f"WITH {B.EXPR} SELECT gene, round(exp(value / 200) - 1, 5) * 2 AS restored, cell FROM expr")
def restored_counts(spark, sf_dir):
    """NUM20: exp(x) - 1 times a size factor."""
    return B.expression(spark, sf_dir).select("gene", (F.round(F.expm1(F.col("value") / 200), 5) * 2).alias("restored"), "cell")


@query(f"WITH {B.EXPR} SELECT cell, gene, round(CASE WHEN isnan(v) OR isinf(v) THEN 0 ELSE v END, 6) AS value, (isnan(v) OR isinf(v)) AS repaired FROM (SELECT cell, gene, CASE WHEN value < 20 THEN 'nan'::DOUBLE WHEN value > 400 THEN 'inf'::DOUBLE ELSE value END AS v FROM expr)")
def finite_values(spark, sf_dir):
    """FLT16: values that are not finite become 0."""
    v = F.when(F.col("value") < 20, float("nan")).when(F.col("value") > 400, float("inf")).otherwise(F.col("value"))
    rows = B.expression(spark, sf_dir).withColumn("v", v)
    odd = F.isnan("v") | (F.abs("v") == float("inf"))
    return rows.select("cell", "gene", F.round(F.when(odd, 0.0).otherwise(F.col("v")), 6).alias("value"), odd.alias("repaired"))
