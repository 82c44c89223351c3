"""Queries on names, ranges and samples."""

from pyspark.sql import functions as F

from cellweave.functions import numeric as N
from cellweave.operators import ranks
from cellweave.plans.registry import query
from cellweave.sources import bindings as B
from cellweave.sources import readers, sinks


@query("SELECT c_custkey AS id, trim(regexp_replace(chr(65279) || '  ' || c_name || ' ', '^' || chr(65279), '')) AS name, regexp_replace(c_name || '_ntRNA', '_(nt|rb)RNA$', '') AS gene, regexp_replace(c_name, '[^A-Za-z0-9_.-]+', '_', 'g') AS file, 'Position' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS position FROM customer")
def cleaned_names(spark, sf_dir):
    """STR01-STR04: names without marks, suffixes and signs, and with padded numbers."""
    name = F.concat(F.lit("﻿  "), "c_name", F.lit(" "))
    return B.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), N.clean_name(name).alias("name"), N.without_suffix(F.concat("c_name", F.lit("_ntRNA"))).alias("gene"), N.file_name(F.col("c_name")).alias("file"),
        F.concat(F.lit("Position"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0")).alias("position"),
    )


@query("SELECT s_name, try_cast(nullif(regexp_extract(s_name, '(\\d+)', 1), '') AS BIGINT) AS number, row_number() OVER (ORDER BY try_cast(nullif(regexp_extract(s_name, '(\\d+)', 1), '') AS BIGINT) % 10, s_name) AS place FROM supplier")
def natural_order(spark, sf_dir):
    """STR05, SRT05, WIN17: names in order of the numbers in them."""
    rows = B.table(spark, sf_dir, "supplier").select("s_name", N.first_integer(F.col("s_name")).alias("number"))
    return ranks.numbered(rows, F.col("number") % 10, F.col("s_name"))


@query("WITH r AS (SELECT n_nationkey AS id, n_nationkey::INT AS lo, (n_nationkey + n_regionkey)::INT AS hi FROM nation) SELECT DISTINCT id, unnest(range(lo, hi + 1))::INT AS fov FROM r")
def expanded_ranges(spark, sf_dir):
    """SRC20, SRC22, STR06: "a-b" ranges as rows."""
    rows = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat_ws("-", "n_nationkey", (F.col("n_nationkey") + F.col("n_regionkey")).cast("string")).alias("r"))
    return readers.expand_ranges(rows, "r", "fov").select("id", "fov").distinct()


@query("SELECT n_nationkey AS fov, round, channel, count(c_custkey) AS images FROM nation CROSS JOIN (SELECT unnest([1, 2, 3]) AS round) CROSS JOIN (SELECT unnest([0, 1]) AS channel) LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 3 + 1 = round AND c_custkey % 2 = channel GROUP BY 1, 2, 3")
def complete_rounds(spark, sf_dir):
    """SRC12, SRC24: every field of view has every round and channel, with nothing where no image is."""
    nation = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("fov"))
    grid = nation.withColumn("round", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("channel", F.explode(F.array(F.lit(0), F.lit(1))))
    found = B.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("fov"), (F.col("c_custkey") % 3 + 1).cast("int").alias("round"), (F.col("c_custkey") % 2).cast("int").alias("channel")).agg(F.count(F.lit(1)).alias("images"))
    return grid.join(found, ["fov", "round", "channel"], "left").fillna(0, ["images"])


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(spark, sf_dir):
    """SRT08: distinct rows."""
    return B.table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").dropDuplicates()


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30")
def brightest_spots(spark, sf_dir):
    """SRT04, SRT10: the top 30."""
    return B.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(30)


@query()
def sampled_cells(spark, sf_dir):
    """SRT11: 100 rows without replacement, the same ones each time (in order of a hash)."""
    return B.table(spark, sf_dir, "customer").select("c_custkey").orderBy(F.xxhash64("c_custkey", F.lit(7)), "c_custkey").limit(100)


@query("SELECT c_nationkey AS fov, count(*) FILTER (WHERE c_acctbal >= 0) AS kept, count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS typed FROM customer GROUP BY 1")
def typed_cells(spark, sf_dir):
    """FLT09, FLT12, FLT01: assigned cells and cells of a real type in each field of view."""
    real = ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_mktsegment").isNotNull()
    return B.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("fov")).agg(F.count_if(F.col("c_acctbal") >= 0).alias("kept"), F.count_if(real).alias("typed"))


@query(f"WITH {B.EXPR} SELECT cell, coalesce(sum(value) FILTER (WHERE gene = 0), 0) AS \"0\", coalesce(sum(value) FILTER (WHERE gene = 1), 0) AS \"1\", coalesce(sum(value) FILTER (WHERE gene = 2), 0) AS \"2\" FROM expr GROUP BY cell")
def exported_matrix(spark, sf_dir):
    """SNK05: a wide matrix over known genes."""
    return sinks.wide_matrix(B.expression(spark, sf_dir), [0, 1, 2])
