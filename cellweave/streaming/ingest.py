"""Incremental ingestion of finished fields of view: an extension, which the batch operators do not need.

Each new file is read once; the checkpoint is the list of what is done, so a restart skips it and repeats a failed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_reads(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append per-file (fov, cell, gene, n) counts of newly arrived Parquet read tables to `target`."""
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("fov", "cell", "gene").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cell_counts(spark: SparkSession, target: str) -> DataFrame:
    """Counts over all batches written so far."""
    return spark.read.parquet(target).groupBy("fov", "cell", "gene").agg(F.sum("n").alias("n"))
