"""Queries on barcodes: intensities from vectors, codebooks from part numbers."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.operators import cells as C
from cellweave.operators import ranks
from cellweave.operators import decode as D
from cellweave.operators import volumes as V
from cellweave.plans.registry import query
from cellweave.sources import bindings as B


def r(c, n=6):
    return F.round(c, n).alias(c)


#: 16 rounds of 4 channels; every 50th spot has a tie in its first round.
_SPOTS = """spots AS (SELECT vec_id AS spot, list_transform(range(0, 16), lambda i: list_transform(range(1, 5), lambda c: CASE WHEN vec_id % 50 = 0 AND i = 0 THEN 1.0::DOUBLE ELSE abs(embedding[i * 4 + c]::DOUBLE) END)) AS intensity FROM embeddings)"""
_CALLED = f"""{_SPOTS}, rounds AS (SELECT spot, unnest(intensity) AS c, generate_subscripts(intensity, 1) AS round FROM spots),
norm AS (SELECT spot, round, c AS raw, list_transform(c, lambda x: x / (sqrt(c[1] * c[1] + c[2] * c[2] + c[3] * c[3] + c[4] * c[4]) + 1e-6::DOUBLE)) AS c FROM rounds),
calls AS (SELECT spot, round, raw, list_max(c) AS top, len(list_filter(c, lambda x: x = list_max(c))) > 1 AS tie, list_position(c, list_max(c)) AS pos, list_reverse_sort(c)[1] - list_reverse_sort(c)[2] AS margin FROM norm),
called AS (SELECT spot, string_agg(CASE WHEN tie THEN '.' ELSE pos::VARCHAR END, '' ORDER BY round) AS barcode, sum(CASE WHEN tie THEN 'inf'::DOUBLE ELSE -ln(top) END) / 16 AS quality, sum(margin) / 16 AS margin, bool_and(NOT tie) AS valid, max(list_max(raw)) AS brightest FROM calls GROUP BY spot)"""


def called(spark, sf_dir):
    rows = B.embedding(spark, sf_dir).withColumnRenamed("cell", "spot")
    channel = lambda i, c: F.when((F.col("spot") % 50 == 0) & (F.lit(i) == 0), F.lit(1.0)).otherwise(F.abs(F.col("v")[i * 4 + c]))
    intensity = F.array(*[F.array(*[channel(i, c) for c in range(4)]) for i in range(16)])
    return D.call_bases(rows.select("spot", intensity.alias("intensity")))


@query(f"WITH {_CALLED} SELECT spot, barcode, CASE WHEN valid THEN round(quality, 6) END AS quality, round(margin, 6) AS margin, valid, round(brightest, 6) AS brightest FROM called")
def base_calls(spark, sf_dir):
    """ARR01-ARR04, STR12: barcodes, qualities and margins of all spots; a tie gives "." and no quality."""
    return called(spark, sf_dir).select("spot", "barcode", F.when(F.col("valid"), F.round("quality", 6)).alias("quality"), r("margin"), "valid", r("brightest"))


@query(f"WITH {_CALLED}, q AS (SELECT round, avg(-ln(top)) AS quality FROM calls WHERE NOT tie GROUP BY round) SELECT round - 1 AS round, round(quality, 6) AS quality, quality = (SELECT max(quality) FROM q) AS weakest FROM q")
def round_qualities(spark, sf_dir):
    """AGG33, ARR07: mean quality of each round and the weakest (16 rows)."""
    rows = called(spark, sf_dir).select(F.posexplode("qualities").alias("round", "q")).where(F.col("q") != float("inf"))
    q = rows.groupBy(F.col("round").cast("long").alias("round")).agg(F.avg("q").alias("quality"))
    return q.select("round", r("quality"), (F.col("quality") == F.max("quality").over(W.partitionBy(F.lit(0)))).alias("weakest"))


@query(f"WITH {_CALLED}, p AS (SELECT *, greatest(quality - 0.4::DOUBLE, 0) * 2 + greatest(0.2::DOUBLE - margin, 0) AS penalty FROM called WHERE valid) SELECT spot, round(penalty, 6) AS penalty, quality < 0.4::DOUBLE AND margin >= 0.2::DOUBLE AND penalty <= 0.5 AS keep FROM p")
def spot_rules(spark, sf_dir):
    """FLT18, FLT19: masks and penalties of the spot rules."""
    rows = D.apply_rules(called(spark, sf_dir).where("valid"), [("quality_mean_lt", 0.4, 2.0), ("channel_margin_mean_gt", 0.2, 1.0)], 0.5)
    return rows.select("spot", r("penalty"), "keep")


#: Every part has six bases: its key in base 4, least digit first.
_BASES = "substr('ACGT', ((p_partkey // {0}) % 4 + 1)::INT, 1)"
_SEQUENCE = " || ".join(_BASES.format(4**k) for k in range(6))
_PAIRS = ", ".join(f"'{k}': '{v}'" for k, v in D.COLOURS.items())
_CODEBOOK = f"seqs AS (SELECT p_partkey AS gene, {_SEQUENCE} AS seq FROM part), coded AS (SELECT gene, seq, list_aggregate(list_transform(range(1, 6), lambda i: MAP {{{_PAIRS}}}[substr(seq, i::INT, 2)]), 'string_agg', '') AS barcode FROM seqs)"


def sequences(spark, sf_dir):
    base = lambda k: F.substring(F.lit("ACGT"), (F.floor(F.col("p_partkey") / 4**k) % 4 + 1).cast("int"), F.lit(1))
    return B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.concat(*[base(k) for k in range(6)]).alias("seq"))


@query(f"WITH {_CODEBOOK} SELECT gene, seq, barcode, reverse(barcode) AS reversed, substr(barcode, 2, 3) AS segment FROM coded")
def codebook(spark, sf_dir):
    """STR07, STR08, MAP01, SRC14: colour barcodes of all gene sequences."""
    rows = sequences(spark, sf_dir).withColumn("barcode", D.encoded(F.col("seq"), D.COLOURS))
    return rows.select("gene", "seq", "barcode", F.reverse("barcode").alias("reversed"), F.substring("barcode", 2, 3).alias("segment"))


@query(f"WITH {_CODEBOOK} SELECT gene, seq AS decoded, substr(seq, 1, 1) = 'A' AND substr(seq, 6, 1) = 'A' AS anchored FROM coded")
def decoded_barcodes(spark, sf_dir):
    """STR09, STR11: the bases of all barcodes from their first bases, and the anchor check."""
    rows = sequences(spark, sf_dir).withColumn("barcode", D.encoded(F.col("seq"), D.COLOURS))
    bases = F.coalesce(*[F.when(F.col("seq").startswith(c), D.decoded(F.col("barcode"), c, D.COLOURS)) for c in "ACGT"])
    return rows.select("gene", bases.alias("decoded"), D.ends_match(bases, "AA").alias("anchored"))


@query(f"WITH {_CODEBOOK}, {_CALLED}, book AS (SELECT barcode, min(gene) AS gene FROM coded GROUP BY 1), rd AS (SELECT spot, pos, substr(barcode, pos, 5) AS barcode FROM called, (SELECT unnest(range(1, 13)) AS pos)) SELECT spot, pos, rd.barcode, coalesce(gene::VARCHAR, 'background') AS gene, gene IS NOT NULL AS in_codebook FROM rd LEFT JOIN book ON book.barcode = rd.barcode")
def gene_lookup(spark, sf_dir):
    """JON05: the genes that the codebook has for each segment of five rounds of the called barcodes, else background."""
    book = sequences(spark, sf_dir).select(D.encoded(F.col("seq"), D.COLOURS).alias("barcode"), "gene").groupBy("barcode").agg(F.min("gene").cast("string").alias("gene"))
    reads = called(spark, sf_dir).select("spot", "barcode", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("pos"))
    return D.with_genes(reads.select("spot", "pos", F.substr(F.col("barcode"), F.col("pos").cast("int"), F.lit(5)).alias("barcode")), book)


@query(f"WITH {_CALLED}, g AS (SELECT spot, valid, quality, substr(barcode, 1, 1) <> '3' AS pattern_valid, spot % 3 <> 0 AS in_codebook FROM called), k AS (SELECT CASE WHEN NOT valid OR quality >= 0.5 THEN 'quality' WHEN NOT pattern_valid THEN 'pattern_valid' WHEN NOT in_codebook THEN 'in_codebook' ELSE 'kept' END AS gate FROM g) SELECT gate, count(*) AS n FROM k GROUP BY gate")
def gated_reads(spark, sf_dir):
    """FLT20, AGG34: where reads stop on the way to being kept."""
    rows = called(spark, sf_dir).withColumn("pattern_valid", F.substring("barcode", 1, 1) != "3").withColumn("in_codebook", F.col("spot") % 3 != 0)
    return D.gated(rows).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {B.CELLS} SELECT round_even(x / 3, 0)::BIGINT AS x, round_even(y / 3, 0)::BIGINT AS y, round_even((x + y) / 100, 0)::BIGINT + 1 AS z, 'gene' || (cell % 5)::VARCHAR AS gene FROM cells WHERE cell % 4 <> 0")
def good_points(spark, sf_dir):
    """SNK04: reads without background, rounded half-even, planes counted from 1."""
    near = lambda c: F.bround(c, 0).cast("long")
    rows = B.cells(spark, sf_dir).withColumn("gene", F.when(F.col("cell") % 4 == 0, "background").otherwise(F.concat(F.lit("gene"), (F.col("cell") % 5).cast("string"))))
    return rows.where("gene <> 'background'").select(near(F.col("x") / 3).alias("x"), near(F.col("y") / 3).alias("y"), (near((F.col("x") + F.col("y")) / 100) + 1).alias("z"), "gene")


_VOXELS = "vox AS (SELECT c_custkey % 40 AS x, (c_custkey // 40) % 40 AS y, 0 AS z, sum(abs(c_acctbal)) AS value FROM customer GROUP BY 1, 2)"


def voxels(spark, sf_dir):
    rows = B.table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 40).alias("x"), (F.floor(F.col("c_custkey") / 40) % 40).alias("y"))
    return rows.agg(F.sum(F.abs("c_acctbal")).alias("value"))


def volume(spark, sf_dir):
    """The same as one volume of one slice."""
    return voxels(spark, sf_dir).select(F.lit(0).alias("fov"), F.lit(0).alias("z"), "y", "x", "value")


@query(f"WITH {_VOXELS}, s AS (SELECT s_suppkey AS spot, s_suppkey * 7 % 40 AS sx, s_suppkey * 3 % 40 AS sy FROM supplier) SELECT spot, round(coalesce(sum(value), 0), 4) AS total, count(value) AS inside FROM s LEFT JOIN vox ON abs(x - sx) <= 1 AND abs(y - sy) <= 1 GROUP BY spot")
def box_sums(spark, sf_dir):
    """ARR05, JON14: sums over a box around each spot; voxels outside count as 0."""
    spots = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("spot"), F.lit(0).alias("fov"), F.lit(0).alias("z"), (F.col("s_suppkey") * 3 % 40).alias("y"), (F.col("s_suppkey") * 7 % 40).alias("x"))
    return V.box_sums(spots, volume(spark, sf_dir)).select("spot", r("total", 4), "inside")


@query(f"WITH {_VOXELS}, q AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi, min(value) AS a, max(value) AS b FROM vox) SELECT x, y, round(least(greatest(value, lo), hi), 4) AS clipped, round((value - a) / (b - a), 6) AS scaled, round(pow(greatest(value, 0) / b, 0.5::DOUBLE), 6) AS gamma FROM vox, q")
def voxel_contrast(spark, sf_dir):
    """IMG04, IMG06, IMG09: percentile clip, min-max and gamma over a volume."""
    rows = voxels(spark, sf_dir)
    q = ranks.quantiles(rows, "value", [0.05, 0.95, 0.0, 1.0]).select("q", F.col("q")[2].alias("a"), F.col("q")[3].alias("b"))
    v = F.col("value")
    return rows.join(F.broadcast(q)).select("x", "y", F.round(F.least(F.greatest(v, F.col("q")[0]), F.col("q")[1]), 4).alias("clipped"), F.round((v - F.col("a")) / (F.col("b") - F.col("a")), 6).alias("scaled"), F.round(F.pow(F.greatest(v, F.lit(0.0)) / F.col("b"), 0.5), 6).alias("gamma"))


@query(f"WITH {_VOXELS} SELECT a.x, a.y, round(a.value, 4) AS value FROM vox a WHERE a.value > 3000 AND NOT EXISTS (SELECT 1 FROM vox b WHERE (b.x <> a.x OR b.y <> a.y) AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.value >= a.value)")
def regional_maxima(spark, sf_dir):
    """IMG21: voxels above a threshold that exceed all their neighbours (no plateaus here)."""
    rows = voxels(spark, sf_dir)
    around = F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    best = rows.select(around.alias("b"), "value").groupBy("b.x", "b.y").agg(F.max("value").alias("near"))
    return rows.where("value > 3000").join(best, ["x", "y"], "left").where("near is null or value > near").select("x", "y", r("value", 4))


@query(f"WITH {_VOXELS}, t AS (SELECT x // 10 AS tx, y // 10 AS ty, sum(value) AS s FROM vox GROUP BY 1, 2) SELECT tx, ty, round(s, 4) AS total FROM t QUALIFY row_number() OVER (ORDER BY round(s, 4) DESC, tx, ty) = 1")
def brightest_tile(spark, sf_dir):
    """IMG19: the tile with the largest sum."""
    return V.brightest_tile(volume(spark, sf_dir), 10).select("tx", "ty", r("total", 4))


@query(f"WITH {_VOXELS}, m AS (SELECT x, y, value FROM vox UNION ALL SELECT x + 5, y + 5, value FROM vox) SELECT x, y, round(max(value), 4) AS largest, round(avg(value), 4) AS mean FROM m GROUP BY x, y")
def blended_mosaic(spark, sf_dir):
    """IMG27, AGG35, IMG13: two shifted tiles blended by maximum and by mean."""
    rows = volume(spark, sf_dir)
    tiles = rows.union(rows.withColumn("fov", F.lit(1)))
    offsets = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 5, 5)], "fov int, dz int, dy int, dx int")
    largest = V.mosaic(tiles, offsets, "max").select("x", "y", r("value", 4)).withColumnRenamed("value", "largest")
    return largest.join(V.mosaic(tiles, offsets, "mean").select("x", "y", F.round("value", 4).alias("mean")), ["x", "y"])


@query(f"WITH {_VOXELS} SELECT round(corr(a.value, b.value), 6) AS correlation, count(*) AS voxels FROM vox a JOIN vox b ON b.x = a.x + 1 AND b.y = a.y WHERE a.x BETWEEN 10 AND 29 AND a.y BETWEEN 10 AND 29")
def crop_correlation(spark, sf_dir):
    """IMG18: correlation of two volumes over the central crop."""
    rows = volume(spark, sf_dir)
    moved = rows.withColumn("x", F.col("x") - 1)
    return V.crop_correlation(rows, moved, (0, 10, 10), (0, 29, 29)).select(r("correlation"), "voxels")


@query(f"WITH {B.CELLS} SELECT cell, round(least(greatest(x - 3.5::DOUBLE, 0), 999), 4) AS x, round(least(greatest(y + 2.25::DOUBLE, 0), 999), 4) AS y FROM cells")
def shifted_spots(spark, sf_dir):
    """IMG23: spot coordinates in the moving round, clipped at the border."""
    spots = B.cells(spark, sf_dir).select("cell", F.lit(0).alias("fov"), F.lit(0.0).alias("z"), "y", "x")
    flow = spark.createDataFrame([(0, None, None, None, 0.0, 2.25, -3.5)], "fov int, z long, y long, x long, dz double, dy double, dx double")
    return V.moved_spots(spots, flow, (1, 1000, 1000)).select("cell", r("x", 4), r("y", 4))


#: Volumes with plateaus: suppliers' voxels in 3-D, values in whole tenths.
_PLATEAUS = """vox AS (SELECT l_linenumber AS fov, l_suppkey % 4 AS z, l_suppkey // 4 % 10 AS y, l_partkey % 20 AS x, round(avg(l_discount) * 100) AS value FROM lineitem GROUP BY 1, 2, 3, 4),
bright AS (SELECT *, row_number() OVER (ORDER BY fov, z, y, x) AS id FROM vox WHERE value > 5),
near AS (SELECT a.id AS a, b.id AS b, a.value AS va, b.value AS vb FROM bright a JOIN bright b ON a.fov = b.fov AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.id <> b.id)"""


@query(f"""WITH RECURSIVE {_PLATEAUS}, eq AS (SELECT a, b FROM near WHERE va = vb), reach AS (SELECT id AS a, id AS b FROM bright UNION SELECT reach.a, eq.b FROM reach JOIN eq ON eq.a = reach.b),
grp AS (SELECT b AS id, min(a) AS g FROM reach GROUP BY b), beaten AS (SELECT DISTINCT a FROM near WHERE vb > va)
SELECT fov, round(avg(z), 6) AS z, round(avg(y), 6) AS y, round(avg(x), 6) AS x, max(value) AS intensity, count(*) AS voxels FROM bright JOIN grp USING (id) LEFT JOIN beaten ON beaten.a = bright.id GROUP BY fov, g HAVING count(beaten.a) = 0""")
def plateau_maxima(spark, sf_dir):
    """IMG21: 26-connected plateaus of a volume that no neighbour exceeds, by centroid."""
    rows = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("fov"), (F.col("l_suppkey") % 4).alias("z"), (F.floor(F.col("l_suppkey") / 4) % 10).alias("y"), (F.col("l_partkey") % 20).alias("x"))
    return V.regional_maxima(rows.agg(F.round(F.avg("l_discount") * 100).alias("value")), 5.0).select("fov", r("z"), r("y"), r("x"), "intensity", "voxels")
