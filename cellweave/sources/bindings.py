"""The engine's logical tables as views over the star schema, each as a DataFrame and as a SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPOTS = """spots AS (SELECT c_custkey AS read, c_nationkey::BIGINT % 3 AS section, ((c_custkey * 37) % 1000)::DOUBLE AS x, ((c_custkey * 91) % 1000)::DOUBLE AS y,
  (c_custkey % 8)::DOUBLE AS z, c_mktsegment AS gene FROM customer)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ADJ = "adj AS (SELECT l_suppkey AS rbp, l_partkey AS tg, sum(l_extendedprice) AS importance FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)"
RAPID = "rapid AS (SELECT l_suppkey AS rbp, l_partkey AS tg, sum(l_quantity) AS score FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)"
PRIOR = "prior AS (SELECT s_suppkey AS gene, s_acctbal AS score FROM supplier)"
EXPR = "expr AS (SELECT l_suppkey AS cell, l_partkey % 64 AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
LAYERS = """layers AS (SELECT l_suppkey AS cell, l_partkey % 64 AS gene, sum(l_quantity) AS total,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0::DOUBLE END) AS rb FROM lineitem GROUP BY 1, 2)"""
EMB = "emb AS (SELECT vec_id AS cell, list_transform(embedding, lambda x: x::DOUBLE) AS v, label::BIGINT AS label FROM embeddings)"
COORDS = """coords AS (SELECT vec_id AS cell, round(embedding[1]::DOUBLE * 1000, 3) AS x, round(embedding[2]::DOUBLE * 1000, 3) AS y,
  label::BIGINT AS section FROM embeddings)"""
READS = "reads AS (SELECT event_id AS read_id, user_id AS cell, event_type AS gene, value FROM events)"
FOVS = "fovs AS (SELECT n_nationkey::BIGINT AS fov, (n_nationkey % 5)::DOUBLE * 900 AS x0, (n_nationkey // 5)::DOUBLE * 900 AS y0 FROM nation)"
CELLS = """cells AS (SELECT c_custkey AS cell, c_nationkey::BIGINT AS fov, ((c_custkey * 37) % 1000)::DOUBLE AS x, ((c_custkey * 91) % 1000)::DOUBLE AS y
  FROM customer)"""


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adj(rbp, tg, importance)"""
    rows = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    return rows.groupBy(F.col("l_suppkey").alias("rbp"), F.col("l_partkey").alias("tg")).agg(F.sum("l_extendedprice").alias("importance"))


def support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rapid(rbp, tg, score)"""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    return rows.groupBy(F.col("l_suppkey").alias("rbp"), F.col("l_partkey").alias("tg")).agg(F.sum("l_quantity").alias("score"))


def prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prior(gene, score)"""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gene"), F.col("s_acctbal").alias("score"))


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """expr(cell, gene, value); an absent row is zero."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 64).alias("gene")).agg(F.sum("l_quantity").alias("value"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layers(cell, gene, total, rb)"""
    rows = table(spark, sf_dir, "lineitem")
    bound = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    return rows.groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 64).alias("gene")).agg(F.sum("l_quantity").alias("total"), bound.alias("rb"))


def embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """emb(cell, v array<double>, label)"""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coords(cell, x, y, section)"""
    at = lambda k: F.round(F.col("embedding")[k].cast("double") * 1000, 3)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), at(0).alias("x"), at(1).alias("y"), F.col("label").cast("long").alias("section"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reads(read_id, cell, gene, value)"""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("read_id"), F.col("user_id").alias("cell"), F.col("event_type").alias("gene"), "value")


def fields_of_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fovs(fov, x0, y0): a grid of five columns, neighbours overlap"""
    fov = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(fov.alias("fov"), ((fov % 5).cast("double") * 900).alias("x0"), (F.floor(fov / 5).cast("double") * 900).alias("y0"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells(cell, fov, x, y): places within each field of view"""
    place = lambda k: ((F.col("c_custkey") * k) % 1000).cast("double")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").cast("long").alias("fov"), place(37).alias("x"), place(91).alias("y"))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spots(read, section, x, y, z, gene): decoded reads of three sections"""
    place = lambda k, m: ((F.col("c_custkey") * k) % m).cast("double")
    rows = table(spark, sf_dir, "customer").withColumn("section", F.col("c_nationkey").cast("long") % 3)
    return rows.select(F.col("c_custkey").alias("read"), "section", place(37, 1000).alias("x"), place(91, 1000).alias("y"), place(1, 8).alias("z"), F.col("c_mktsegment").alias("gene"))
