"""Places, ranks and quantiles over all rows, without a task that sees them all.

Rows are dealt into ranges of the order; each range is sorted and counted by itself, and only the ranges' counts, one row
each, are summed in one place. The dealt rows are written once, so that ranges are the same wherever they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.sources.shared import materialised


def _before(dealt: DataFrame, size: Column) -> DataFrame:
    """(_part, _before, _total): what lies in earlier ranges and in all, one row per range."""
    sums = dealt.groupBy("_part").agg(size.alias("_size"))
    order = W.orderBy("_part")
    before = F.coalesce(F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sums.select("_part", before.alias("_before"), F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_total"))


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """rows with their place in the order, from 1; the order should end in a unique column, which also splits ties."""
    made = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    made = materialised(made.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    joined = made.join(F.broadcast(_before(made, F.count(F.lit(1)))), "_part")  # one row per range
    return joined.withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before", "_total")


def running(rows: DataFrame, value: str, *order: Column | str, name: str = "running", total: str = "total") -> DataFrame:
    """rows with the sum of `value` up to and with each row of the order, and the sum of all."""
    made = rows.repartitionByRange(*order)
    made = materialised(made.select("*", F.spark_partition_id().alias("_part")))
    joined = made.join(F.broadcast(_before(made, F.sum(value))), "_part")
    upto = F.sum(value).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return joined.withColumn(name, F.col("_before") + upto).withColumn(total, F.col("_total")).drop("_part", "_before", "_total")


def _value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(v, c, upto, n): each value, its rows, the rows up to and with it, and all rows; nulls do not count."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return running(counts, "c", "v", name="upto", total="n")


def quantiles(rows: DataFrame, column: str, shares: list[float], out: str = "q") -> DataFrame:
    """One row with the array `out` of the exact quantiles, interpolated linearly; nulls if there is no value."""
    counted = _value_counts(rows, column)
    at = [(F.col("n") - 1) * F.lit(float(s)) for s in shares]
    reach = lambda place: F.min(F.when(F.col("upto") > place, F.col("v").cast("double")))
    got = counted.agg(F.max("n").alias("n"), *[reach(F.floor(p)).alias(f"lo{k}") for k, p in enumerate(at)], *[reach(F.ceil(p)).alias(f"hi{k}") for k, p in enumerate(at)])
    return got.select(F.array(*[F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (p - F.floor(p)) for k, p in enumerate(at)]).alias(out))


def average_ranks(rows: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """(column, out): each value and its rank among all rows, the mean of its places where it stands several times."""
    return _value_counts(rows, column).select(F.col("v").alias(column), (F.col("upto") - (F.col("c") - 1) / 2).alias(out))


def running_by(rows: DataFrame, key: str, value: str, *order: Column | str, name: str = "running") -> DataFrame:
    """As running(), within each key: the sum of `value` up to and with each row in the key's order. A key of many rows is
    dealt into ranges like any other; only its ranges' sums, one row each, meet in one task."""
    made = materialised(rows.repartitionByRange(key, *order).select("*", F.spark_partition_id().alias("_part")))
    sums = made.groupBy(key, "_part").agg(F.sum(value).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = made.join(sums.select(key, "_part", before.alias("_before")), [key, "_part"])
    upto = F.sum(value).over(W.partitionBy(key, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return joined.withColumn(name, F.col("_before") + upto).drop("_part", "_before")
