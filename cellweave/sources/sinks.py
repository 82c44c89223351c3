"""Writers. Spark's committer makes each of them all-or-nothing (SNK06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """SNK01, SNK03, SNK07, SNK08: Parquet by key; only the partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def regulon_json(edges: DataFrame) -> DataFrame:
    """SNK02: one row (rbp, json) per regulator, its targets and weights as an object in order of the target."""
    entry = F.struct(F.col("target").cast("string").alias("key"), F.col("weight").alias("value"))
    return edges.groupBy("rbp").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))


def wide_matrix(expr: DataFrame, genes: list) -> DataFrame:
    """SNK05: cells x genes for export, over given genes, 0 where nothing was measured."""
    return expr.groupBy("cell").pivot("gene", genes).agg(F.sum("value")).fillna(0.0)


def significant(report: DataFrame, column: str = "p_adjusted", level: float = 0.05) -> DataFrame:
    """SNK09: the significant part of a report."""
    return report.where(F.col(column) < level)
