"""Queries on cells, reads, clusters and fields of view."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.functions import numeric as N
from cellweave.operators import cells as C
from cellweave.operators import ranks
from cellweave.plans.registry import query
from cellweave.sources import bindings as B


def r(c, n=6):
    return F.round(c, n).alias(c)


@query(f"WITH {B.READS} SELECT cell, count(*) FILTER (WHERE gene = 'click') AS click, count(*) FILTER (WHERE gene = 'error') AS error, count(*) FILTER (WHERE gene = 'purchase') AS purchase, count(*) AS total FROM reads GROUP BY cell")
def cell_gene_counts(spark, sf_dir):
    """AGG04, AGG17, SNK05: counts by cell and gene, pivoted over known genes, zero where there is none."""
    genes = ["click", "error", "purchase"]
    counts = B.reads(spark, sf_dir).groupBy("cell")
    return counts.agg(*[F.count_if(F.col("gene") == g).alias(g) for g in genes], F.count(F.lit(1)).alias("total"))


@query(f"WITH {B.READS} SELECT gene, cell, count(*) AS n_reads FROM reads GROUP BY gene, cell HAVING count(*) >= 10")
def reads_per_cell(spark, sf_dir):
    """AGG05: reads of each gene and cell, where there are enough."""
    return B.reads(spark, sf_dir).groupBy("gene", "cell").agg(F.count(F.lit(1)).alias("n_reads")).where("n_reads >= 10")


@query(f"WITH {B.READS} SELECT gene, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS low, max(value) AS high FROM reads GROUP BY gene")
def position_summary(spark, sf_dir):
    """AGG06: five numbers of each group."""
    return B.reads(spark, sf_dir).groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))


@query(f"WITH {B.READS} SELECT count(DISTINCT gene) AS n_positions, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd FROM reads")
def overall_summary(spark, sf_dir):
    """AGG07: one row over everything."""
    return B.reads(spark, sf_dir).agg(F.count_distinct("gene").alias("n_positions"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.round(F.stddev_samp("value"), 6).alias("sd"))


@query(f"WITH {B.READS} SELECT cell, n FROM (SELECT cell, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, cell) AS k FROM reads GROUP BY cell) WHERE k <= 10")
def busiest_cells(spark, sf_dir):
    """AGG08: value counts, the top ten."""
    return B.reads(spark, sf_dir).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cell").limit(10)


@query(f"WITH {B.READS}, n AS (SELECT cell, count(DISTINCT gene) AS k FROM reads GROUP BY cell) SELECT k, count(*) AS cells, round(count(*) / (SELECT count(*) FROM n)::DOUBLE, 6) AS share FROM n GROUP BY k")
def degree_distribution(spark, sf_dir):
    """AGG09: how many cells have how many neighbours, as shares (one row per count)."""
    n = B.reads(spark, sf_dir).groupBy("cell").agg(F.count_distinct("gene").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("cells"))
    return n.select("k", "cells", F.round(F.col("cells") / F.sum("cells").over(W.partitionBy(F.lit(0))), 6).alias("share"))


@query(f"WITH {B.READS}, s AS (SELECT cell, gene, sum(value) AS w FROM reads GROUP BY 1, 2) SELECT cell, gene, round(w / sum(w) OVER (PARTITION BY cell), 6) AS of_cell, round(w / sum(w) OVER (PARTITION BY gene), 6) AS of_gene FROM s")
def two_way_shares(spark, sf_dir):
    """WIN05, WIN06: shares within cells and within genes."""
    s = B.reads(spark, sf_dir).groupBy("cell", "gene").agg(F.sum("value").alias("w"))
    share = lambda k: F.round(F.col("w") / F.sum("w").over(W.partitionBy(k)), 6)
    return s.select("cell", "gene", share("cell").alias("of_cell"), share("gene").alias("of_gene"))


@query(f"WITH {B.READS} SELECT read_id, cell, gene, value FROM (SELECT *, row_number() OVER (PARTITION BY cell, gene ORDER BY read_id) AS n FROM reads) WHERE n = 1")
def first_reads(spark, sf_dir):
    """WIN08: the first read of each cell and gene."""
    return C.first_rows(B.reads(spark, sf_dir), ["cell", "gene"], [F.col("read_id")])


@query(f"WITH {B.READS}, f AS (SELECT gene, min(read_id) AS first FROM reads GROUP BY gene) SELECT gene, first, rank() OVER (ORDER BY first) AS code FROM f")
def gene_codes(spark, sf_dir):
    """WIN16: genes numbered by first appearance."""
    first = B.reads(spark, sf_dir).groupBy("gene").agg(F.min("read_id").alias("first"))
    return ranks.numbered(first, "first", name="code")


@query("SELECT event_id FROM events WHERE contains(lower(concat_ws(' ', event_type, props)), 'rr') OR contains(lower(concat_ws(' ', event_type, props)), 'click')")
def masked_reads(spark, sf_dir):
    """FLT15, FLT21: literal, case-blind search over several text columns."""
    text = F.lower(F.concat_ws(" ", "event_type", "props"))
    return B.table(spark, sf_dir, "events").where(F.contains(text, F.lower(F.lit("RR"))) | F.contains(text, F.lower(F.lit("Click")))).select("event_id")


@query(f"WITH {B.READS}, t AS (SELECT cell, gene, sum(value) AS x, count(*)::DOUBLE AS w FROM reads GROUP BY 1, 2), v AS (SELECT gene, round(x, 4) AS x, sum(w) AS w FROM t GROUP BY 1, 2), u AS (SELECT *, sum(w) OVER (PARTITION BY gene ORDER BY x) AS run, sum(w) OVER (PARTITION BY gene) AS total FROM v) SELECT gene, min(x) AS weighted_median FROM u WHERE run >= total / 2 GROUP BY gene")
def weighted_medians(spark, sf_dir):
    """AGG18: weighted median of cell sums by gene."""
    t = B.reads(spark, sf_dir).groupBy("cell", "gene").agg(F.round(F.sum("value"), 4).alias("x"), F.count(F.lit(1)).cast("double").alias("w"))
    return C.weighted_median(t, "x", "w", "gene")


@query(f"WITH {B.READS} SELECT gene, round(sum(value * (cell + 1)) / sum(cell + 1), 6) AS weighted_mean FROM reads GROUP BY gene")
def weighted_means(spark, sf_dir):
    """AGG19"""
    w = F.col("cell") + 1
    return B.reads(spark, sf_dir).groupBy("gene").agg(F.round(F.sum(F.col("value") * w) / F.sum(w), 6).alias("weighted_mean"))


_CLUSTERS = f"{B.EMB}, dims AS (SELECT cell, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM emb), cent AS (SELECT label, d, avg(x) AS c FROM dims GROUP BY 1, 2), dist AS (SELECT cell, dims.label, sqrt(sum((x - c) * (x - c))) AS distance FROM dims JOIN cent ON cent.label = dims.label AND cent.d = dims.d GROUP BY 1, 2)"


def _distances(spark, sf_dir):
    """Distance of each cell to its cluster's centroid: one aggregate per (cluster, dimension), joined back."""
    dims = B.embedding(spark, sf_dir).select("cell", "label", F.posexplode("v").alias("d", "x"))
    centroid = dims.groupBy("label", "d").agg(F.avg("x").alias("c"))
    return dims.join(centroid, ["label", "d"]).groupBy("cell", "label").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c")))).alias("distance"))


@query(f"WITH {_CLUSTERS} SELECT label, d - 1 AS d, round(c, 6) AS c FROM cent")
def cluster_centroids(spark, sf_dir):
    """AGG10: the mean of each dimension in each cluster."""
    dims = B.embedding(spark, sf_dir).select("label", F.posexplode("v").alias("d", "x"))
    return dims.groupBy("label", F.col("d").cast("long").alias("d")).agg(F.round(F.avg("x"), 6).alias("c"))


@query(f"WITH {_CLUSTERS}, t AS (SELECT label, quantile_cont(distance, 0.95) AS threshold, count(*) AS size FROM dist GROUP BY label) SELECT cell, dist.label, round(distance, 6) AS distance, (distance > threshold OR size < 10) AS outlier FROM dist JOIN t ON t.label = dist.label")
def cluster_outliers(spark, sf_dir):
    """FLT13, AGG11, WIN07: cells beyond the 95 per cent quantile of their cluster's distances, or in clusters of under ten."""
    rows = _distances(spark, sf_dir)
    limit = rows.groupBy("label").agg(F.percentile("distance", 0.95).alias("threshold"), F.count(F.lit(1)).alias("size"))
    return rows.join(limit, "label").select("cell", "label", r("distance"), ((F.col("distance") > F.col("threshold")) | (F.col("size") < 10)).alias("outlier"))


_META = f"{B.EMB}, m AS (SELECT cell % 25 AS metacell, cell, label, CASE WHEN cell % 11 = 0 THEN NULL ELSE label END AS known FROM emb)"


def _members(spark, sf_dir):
    rows = B.embedding(spark, sf_dir)
    return rows.select((F.col("cell") % 25).alias("metacell"), "cell", "label", F.when(F.col("cell") % 11 != 0, F.col("label")).alias("known"))


@query(f"""WITH {_META}, n AS (SELECT metacell, known, count(*) AS n FROM m WHERE known IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY metacell ORDER BY n DESC, known) AS k, sum(n) OVER (PARTITION BY metacell) AS total FROM n)
SELECT s.metacell, s.size, k.known AS majority, round(k.n / k.total, 6) AS purity FROM (SELECT metacell, count(*) AS size FROM m GROUP BY 1) s LEFT JOIN k ON k.metacell = s.metacell AND k.k = 1""")
def metacell_purity(spark, sf_dir):
    """AGG20, AGG21: majority label and purity of each metacell, missing labels left out."""
    return C.majority_labels(_members(spark, sf_dir), "metacell", "known").select("metacell", "size", "majority", r("purity"))


@query(f"""WITH {_META}, n AS (SELECT metacell, label, count(*) AS n FROM m GROUP BY 1, 2), p AS (SELECT metacell, max(n) / sum(n) AS purity, sum(n)::DOUBLE AS size FROM n GROUP BY 1)
SELECT count(*) AS metacells, round(sum(purity * size) / sum(size), 6) AS weighted_purity, round(avg(purity), 6) AS mean, round(median(purity), 6) AS median, round(stddev_samp(purity), 6) AS sd, round(stddev_samp(size) / avg(size), 6) AS size_cv FROM p""")
def metacell_summary(spark, sf_dir):
    """AGG22: purity and size over all metacells."""
    rows = C.majority_labels(_members(spark, sf_dir), "metacell", "label")
    return rows.agg(
        F.count(F.lit(1)).alias("metacells"), F.round(F.sum(F.col("purity") * F.col("size")) / F.sum("size"), 6).alias("weighted_purity"), F.round(F.avg("purity"), 6).alias("mean"),
        F.round(F.median("purity"), 6).alias("median"), F.round(F.stddev_samp("purity"), 6).alias("sd"), F.round(F.stddev_samp("size") / F.avg("size"), 6).alias("size_cv"),
    )


@query(f"""WITH {_META}, {B.EXPR}, g AS (SELECT m.metacell, gene, sum(value) AS counts FROM expr JOIN m ON m.cell = expr.cell GROUP BY 1, 2), s AS (SELECT metacell, count(*) AS size FROM m GROUP BY 1)
SELECT 'MC_' || lpad((g.metacell + 1)::VARCHAR, 4, '0') AS metacell, gene, round(counts, 4) AS counts, round(counts / size, 6) AS mean FROM g JOIN s ON s.metacell = g.metacell""")
def metacell_expression(spark, sf_dir):
    """AGG23, STR04, SET07: counts summed and values averaged over all members, zeros included."""
    members = _members(spark, sf_dir).select("metacell", "cell")
    sizes = members.groupBy("metacell").agg(F.count(F.lit(1)).alias("size"))
    sums = B.expression(spark, sf_dir).join(members, "cell").groupBy("metacell", "gene").agg(F.sum("value").alias("counts"))
    name = F.concat(F.lit("MC_"), F.lpad((F.col("metacell") + 1).cast("string"), 4, "0"))
    return sums.join(sizes, "metacell").select(name.alias("metacell"), "gene", r("counts", 4), F.round(F.col("counts") / F.col("size"), 6).alias("mean"))


@query(f"WITH {_META}, t AS (SELECT metacell, label, count(*)::DOUBLE AS n FROM m GROUP BY 1, 2), a AS (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS total FROM t), b AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM t GROUP BY metacell)), c AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM t GROUP BY label)) SELECT round((a.x - b.x * c.x / (total * (total - 1) / 2)) / ((b.x + c.x) / 2 - b.x * c.x / (total * (total - 1) / 2)), 6) AS ari FROM a, b, c")
def rand_index(spark, sf_dir):
    """AGG29: agreement of two labellings."""
    return C.adjusted_rand_index(_members(spark, sf_dir), "metacell", "label").select(r("ari"))


@query(f"WITH {_META} SELECT metacell, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY metacell), 6) AS of_metacell, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS of_label FROM m GROUP BY 1, 2")
def contingency(spark, sf_dir):
    """AGG17, WIN06: cluster by label with both fractions."""
    n = _members(spark, sf_dir).groupBy("metacell", "label").agg(F.count(F.lit(1)).alias("n"))
    share = lambda k: F.round(F.col("n") / F.sum("n").over(W.partitionBy(k)), 6)
    return n.withColumn("of_metacell", share("metacell")).withColumn("of_label", share("label"))


@query(f"WITH {B.CELLS}, s AS (SELECT fov, max(cell % 40) + 1 AS span FROM cells GROUP BY fov), o AS (SELECT fov, coalesce(sum(span) OVER (ORDER BY fov ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s) SELECT cells.cell, cells.fov, (CASE WHEN cell % 7 = 0 THEN -1 ELSE cell % 40 + off END)::BIGINT AS global_id FROM cells JOIN (SELECT o.fov, coalesce(sum(s2.span), 0) AS off FROM o LEFT JOIN (SELECT fov, coalesce(max(CASE WHEN cell % 7 <> 0 THEN cell % 40 END) + 1, 0) AS span FROM cells GROUP BY fov) s2 ON s2.fov < o.fov GROUP BY o.fov) f ON f.fov = cells.fov")
def stitched_cell_ids(spark, sf_dir):
    """WIN09, WIN15, SET01, SRC18: running id offsets across fields of view; reads without a cell keep -1."""
    rows = B.cells(spark, sf_dir).select("cell", "fov", F.when(F.col("cell") % 7 == 0, -1).otherwise(F.col("cell") % 40).alias("local"))
    return C.stitched_ids(rows, "fov", "local").select("cell", "fov", F.col("global_id").cast("long"))


_GLOBAL = f"{B.FOVS}, {B.CELLS}, g AS (SELECT cell, cells.fov, x0 + x AS x, y0 + y AS y FROM cells JOIN fovs USING (fov))"


@query(f"""WITH {_GLOBAL}, d AS (SELECT cell, g.fov, x, y, f.fov AS near, row_number() OVER (PARTITION BY cell ORDER BY sqrt(pow(x - (x0 + 500), 2) + pow(y - (y0 + 500), 2)), f.fov) AS k FROM g CROSS JOIN fovs f)
SELECT cell, fov, x, y FROM d WHERE k = 1 AND near = fov""")
def owned_cells(spark, sf_dir):
    """JON13: cells that lie nearest to the centre of their own field of view."""
    fovs = B.fields_of_view(spark, sf_dir)
    cells = B.cells(spark, sf_dir).join(F.broadcast(fovs), "fov").select("cell", "fov", (F.col("x0") + F.col("x")).alias("x"), (F.col("y0") + F.col("y")).alias("y"))  # one row per field
    return C.nearest_owner(cells, fovs.select("fov", (F.col("x0") + 500).alias("cx"), (F.col("y0") + 500).alias("cy")), 900.0)


@query(f"WITH {B.CELLS} SELECT cell, fov, (-y)::DOUBLE AS rot90_x, x AS rot90_y, floor(x * cos(0.5::DOUBLE) - y * sin(0.5::DOUBLE) + 0.5::DOUBLE)::BIGINT AS turned_x, round_even(x / 7, 0)::BIGINT AS snapped FROM cells WHERE x * cos(0.5::DOUBLE) - y * sin(0.5::DOUBLE) + 0.5::DOUBLE >= 0")
def rotated_cells(spark, sf_dir):
    """NUM17, NUM18: rotation by 90 degrees and by an angle, half-up truncation, half-even rounding."""
    turned = F.col("x") * F.cos(F.lit(0.5)) - F.col("y") * F.sin(F.lit(0.5)) + 0.5
    rows = B.cells(spark, sf_dir).where(turned >= 0)
    return rows.select("cell", "fov", (-F.col("y")).alias("rot90_x"), F.col("x").alias("rot90_y"), turned.cast("long").alias("turned_x"), F.rint(F.col("x") / 7).cast("long").alias("snapped"))


@query(f"WITH {B.CELLS}, t AS (SELECT cell, fov, x, y FROM cells), tiles AS (SELECT unnest(range(0, 4)) AS tx), tt AS (SELECT a.tx AS tx, b.tx AS ty FROM tiles a, tiles b) SELECT tx, ty, count(*) AS n, count(*) FILTER (WHERE x >= tx * 250 AND x < tx * 250 + 250 AND y >= ty * 250 AND y < ty * 250 + 250) AS owned FROM t JOIN tt ON x >= tx * 250 - 20 AND x < tx * 250 + 270 AND y >= ty * 250 - 20 AND y < ty * 250 + 270 GROUP BY 1, 2")
def haloed_tiles(spark, sf_dir):
    """IMG20, FLT10, SRC19: points dealt to tiles of 250 with a halo of 20; each is owned by exactly one."""
    reach = lambda c: F.sequence(F.greatest(F.floor((F.col(c) - 20) / 250), F.lit(0)), F.least(F.floor((F.col(c) + 20) / 250), F.lit(3)))
    rows = B.cells(spark, sf_dir).withColumn("tx", F.explode(reach("x"))).withColumn("ty", F.explode(reach("y")))
    near = lambda c, t: (F.col(c) >= F.col(t) * 250 - 20) & (F.col(c) < F.col(t) * 250 + 270)
    own = (F.floor(F.col("x") / 250) == F.col("tx")) & (F.floor(F.col("y") / 250) == F.col("ty"))
    return rows.where(near("x", "tx") & near("y", "ty")).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.count_if(own).alias("owned"))


@query("SELECT coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def numeric_properties(spark, sf_dir):
    """NUM01, JSN01: a number out of JSON text, 0 where there is none."""
    k = N.number(F.get_json_object("props", "$.k"))
    return B.table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT event_type, round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 3) AS seconds, count(*) AS n FROM events GROUP BY event_type")
def durations(spark, sf_dir):
    """DAT01: time spans in seconds."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return B.table(spark, sf_dir, "events").groupBy("event_type").agg(F.round((F.max(us(F.col("ts"))) - F.min(us(F.col("ts")))) / 1e6, 3).alias("seconds"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus))")
def two_level_rollup(spark, sf_dir):
    """AGG14: the same statistics by (sample, type) and by type."""
    B.table(spark, sf_dir, "lineitem").createOrReplaceTempView("cellweave_lines")
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM cellweave_lines GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus))")


@query("SELECT count(*) AS spots, count(*) FILTER (WHERE value > 5) AS bright, count(*) FILTER (WHERE value > 5 AND event_type <> 'error') AS valid, round(count(*) FILTER (WHERE value > 5) / count(*)::DOUBLE, 6) AS rate FROM events")
def filtration_funnel(spark, sf_dir):
    """AGG34, FLT19: how many rows each filter leaves, in one pass."""
    bright = F.col("value") > 5
    return B.table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("spots"), F.count_if(bright).alias("bright"), F.count_if(bright & (F.col("event_type") != "error")).alias("valid"), F.round(F.count_if(bright) / F.count(F.lit(1)), 6).alias("rate"))
