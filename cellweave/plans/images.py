"""Queries on image slices: one 20 x 20 slice for each nation and plane, from customers' numbers and balances."""

from pyspark.sql import functions as F

from cellweave.operators import imaging as I
from cellweave.plans.registry import query
from cellweave.sources import bindings as B

_PIXELS = "px AS (SELECT c_nationkey::BIGINT AS fov, (c_custkey % 2)::INT AS z, (c_custkey * 7) % 400 AS p, sum(abs(c_acctbal)) AS v FROM customer GROUP BY 1, 2, 3)"


def slices(spark, sf_dir):
    """Slices (fov, round 1, channel 0, z); a pixel without a customer is 0."""
    c = B.table(spark, sf_dir, "customer")
    px = c.groupBy(F.col("c_nationkey").cast("long").alias("fov"), (F.col("c_custkey") % 2).cast("int").alias("z"), ((F.col("c_custkey") * 7) % 400).alias("p")).agg(F.sum(F.abs("c_acctbal")).alias("v"))
    made = px.groupBy("fov", "z").agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("m"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(399).cast("long"))
    data = F.transform(every, lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0.0)))
    return made.select("fov", F.lit(1).alias("round"), F.lit(0).alias("channel"), "z", F.lit(20).alias("height"), F.lit(20).alias("width"), data.alias("data"))


def pixels(df):
    return df.select("fov", "z", F.posexplode("data").alias("p", "v")).select("fov", "z", F.col("p").cast("long").alias("p"), F.round("v", 4).alias("v"))


_GRID = f"{_PIXELS}, grid AS (SELECT f.fov, f.z, g.p, coalesce(px.v, 0) AS v FROM (SELECT DISTINCT fov, z FROM px) f CROSS JOIN (SELECT unnest(range(0, 400)) AS p) g LEFT JOIN px ON px.fov = f.fov AND px.z = f.z AND px.p = g.p)"


@query(f"WITH {_GRID}, q AS (SELECT fov, quantile_cont(v, 0.5) AS lo, quantile_cont(v, 0.99) AS hi FROM grid GROUP BY fov) SELECT grid.fov, z, p, round(least(greatest(v, lo), hi), 4) AS v FROM grid JOIN q ON q.fov = grid.fov")
def clipped_volumes(spark, sf_dir):
    """IMG06: values between two quantiles of each volume."""
    return pixels(I.clipped(slices(spark, sf_dir), 0.5, 0.99))


@query(f"WITH {_GRID} SELECT grid.fov, z, p, round(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 255 ELSE 0 END, 4) AS v FROM grid WINDOW w AS (PARTITION BY fov, z)")
def normalised_slices(spark, sf_dir):
    """IMG09, IMG10: min-max of each slice to 255."""
    return pixels(I.process(slices(spark, sf_dir), [("min_max", {})]))


@query(f"WITH {_GRID}, n AS (SELECT a.fov, a.z, a.p, median(b.v) AS v FROM grid a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS i) i CROSS JOIN (SELECT unnest([-1, 0, 1]) AS j) j JOIN grid b ON b.fov = a.fov AND b.z = a.z AND b.p = least(greatest(a.p // 20 + i, 0), 19) * 20 + least(greatest(a.p % 20 + j, 0), 19) GROUP BY 1, 2, 3) SELECT fov, z, p, round(v, 4) AS v FROM n")
def median_filtered(spark, sf_dir):
    """IMG01: 3 x 3 median; the border repeats its pixels."""
    return pixels(I.process(slices(spark, sf_dir), [("median", {"size": 3})]))


@query(f"WITH {_GRID} SELECT fov, p, round(max(v), 4) AS v FROM grid GROUP BY fov, p")
def volume_projections(spark, sf_dir):
    """AGG35: maximum over z."""
    out = I.projection(slices(spark, sf_dir))
    return out.select("fov", F.posexplode("data").alias("p", "v")).select("fov", F.col("p").cast("long").alias("p"), F.round("v", 4).alias("v"))


@query(f"WITH {_GRID} SELECT fov, z, p, round(CASE WHEN p // 20 >= 2 AND p % 20 < 17 THEN (SELECT 0::DOUBLE) + lag(v, 37) OVER (PARTITION BY fov, z ORDER BY p) ELSE 0 END, 4) AS v FROM grid")
def shifted_slices(spark, sf_dir):
    """IMG13: two rows down and three columns to the left, zeros from outside."""
    rows = slices(spark, sf_dir)
    by = rows.select("fov", "round").distinct().withColumn("dy", F.lit(2.0)).withColumn("dx", F.lit(-3.0))
    return pixels(I.shifted(rows, by))


@query()
def registered_slices(spark, sf_dir):
    """IMG12: shifts found between slices and moved copies of them."""
    rows = slices(spark, sf_dir)
    by = rows.select("fov", "round").distinct().withColumn("dy", F.lit(2.0)).withColumn("dx", F.lit(-3.0))
    return I.shifts(rows, I.shifted(rows, by).withColumn("round", F.lit(2)))


@query()
def enhanced_slices(spark, sf_dir):
    """IMG02, IMG03, IMG05, IMG07, IMG08, IMG11: a chain of steps, matched to the first plane of each field of view."""
    done = I.process(slices(spark, sf_dir), [("top_hat", {"size": 3}), ("difference_of_gaussians", {}), ("equalise", {})])
    reference = done.where("z = 0").select("fov", "channel", F.explode(F.array(F.lit(0), F.lit(1))).alias("z"), "data")
    return pixels(I.matched(done, reference))
