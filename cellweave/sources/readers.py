"""Readers that repair what they read: names, separators, missing columns, wide matrices, stage positions, ranges."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_columns(df: DataFrame) -> DataFrame:
    """SRC02, STR01: column names without a byte-order mark and blanks."""
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, separators: str = ",\t;|") -> DataFrame:
    """SRC02, SRC03: a delimited file whose separator is the one that occurs most in its first line."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    sep = max(separators, key=line.count) if line else ","
    reader = spark.read.option("header", True).option("sep", sep)
    return clean_columns(reader.schema(schema).csv(path) if schema is not None else reader.csv(path))


def read_gene_sequences(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: (gene, seq) without a header; a header line is dropped if its second field is not made of bases."""
    rows = spark.read.schema("gene string, seq string").csv(path)
    return rows.where(F.upper(F.trim("seq")).rlike("^[ACGTN]+$")).select(F.trim("gene").alias("gene"), F.upper(F.trim("seq")).alias("seq"))


def read_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """SRC04: a genes x cells matrix with gene names in front as (gene, cell, value); values that are no numbers are 0."""
    wide = clean_columns(spark.read.option("header", True).option("sep", sep).csv(path))
    names = wide.columns
    long = wide.withColumnRenamed(names[0], "gene").unpivot("gene", names[1:], "cell", "value")
    return long.select("gene", "cell", F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)).alias("value"))


def with_schema(df: DataFrame, schema: T.StructType, aliases: dict[str, str] | None = None) -> DataFrame:
    """SRC18: the columns of a schema, renamed from aliases, cast, and null where they are missing."""
    named = df.withColumnsRenamed({old: new for old, new in (aliases or {}).items() if old in df.columns and new not in df.columns})
    have = set(named.columns)
    return named.select(*[(F.col(f.name) if f.name in have else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema])


def read_stage_positions(spark: SparkSession, path: str) -> DataFrame:
    """SRC16: (position, x_um, y_um) of stage positions in metres, from the least x and y on."""
    rows = spark.read.format("xml").option("rowTag", "XYZStagePointDefinition").load(path)
    um = rows.select(F.col("PositionID").cast("long").alias("position"), (F.col("StageXPos").cast("double") * 1e6).alias("x"), (F.col("StageYPos").cast("double") * 1e6).alias("y"))
    low = um.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    return um.join(F.broadcast(low)).select("position", (F.col("x") - F.col("x0")).alias("x_um"), (F.col("y") - F.col("y0")).alias("y_um"))  # one row


def read_positions(spark: SparkSession, pattern: str, schema: T.StructType | str, expected: list[str]) -> tuple[DataFrame, DataFrame]:
    """SRC17: all files of a glob with their position name, and the expected names for which there is no file."""
    rows = spark.read.schema(schema).option("header", True).csv(pattern)
    rows = rows.withColumn("position", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    wanted = spark.createDataFrame([(e,) for e in expected], "position string")
    return rows, wanted.join(rows.select("position").distinct(), "position", "left_anti")


def image_index(spark: SparkSession, path: str) -> DataFrame:
    """SRC10, SRC11: (fov, round, channel, path) of image files named like round001/Position001_ch00.tif; an ambiguous
    (fov, round, channel) raises when the table is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    part = lambda p: F.regexp_extract("path", p, 1).try_cast("int")
    found = files.select(part(r"Position(\d+)").alias("fov"), part(r"round(\d+)").alias("round"), part(r"ch(\d+)\.").alias("channel"), "path").dropna()
    grouped = found.groupBy("fov", "round", "channel").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))
    message = F.concat(F.lit("several files for "), F.concat_ws("/", "fov", "round", "channel"))
    return grouped.select("fov", "round", "channel", F.when(F.col("n") == 1, F.col("path")).otherwise(F.raise_error(message).cast("string")).alias("path"))


def expand_ranges(df: DataFrame, column: str, out: str) -> DataFrame:
    """SRC20, SRC22: rows with ranges such as "1-3,7" become one row per number, each number once."""
    parts = df.withColumn("_part", F.explode(F.split(F.regexp_replace(column, r"\s", ""), "[,;]")))
    ends = F.split("_part", "-")
    low = ends[0].try_cast("int")
    high = F.coalesce(F.try_element_at(ends, F.lit(2)).try_cast("int"), low)
    return parts.where(low.isNotNull()).withColumn(out, F.explode(F.sequence(low, high))).drop("_part").dropDuplicates()


def expand_template(text: str, values: dict[str, str]) -> str:
    """SRC20: "{name}" and "{name | basename}" in configuration text; an unknown name raises KeyError."""
    return re.sub(r"\{\s*(\w+)\s*(\|\s*basename\s*)?\}", lambda m: values[m[1]].rstrip("/").rsplit("/", 1)[-1] if m[2] else values[m[1]], text)


def parameter_grid(spark: SparkSession, **values: list) -> DataFrame:
    """SRC21, SRC24: every combination of the given values, numbered; a grid is as large as what the caller writes."""
    grid = spark.createDataFrame([(0,)], "_one int")
    for name, options in values.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(o) for o in options])))
    return grid.drop("_one").withColumn("run", F.concat_ws("_", *[F.concat(F.lit(n), F.col(n).cast("string")) for n in values]))


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """SRC06: the first n rows by key, with the names of all columns; the limit is what is asked for."""
    return df.orderBy(key).limit(n)


def one_sample(cells: DataFrame, sample_col: str, sample, label_col: str) -> DataFrame:
    """SRC09: the cells of one sample that have a label."""
    return cells.where((F.col(sample_col) == sample) & F.col(label_col).isNotNull())


def slices_of(slices: DataFrame, fov, round_: int, channel: int) -> DataFrame:
    """SRC13: the slices of one field of view, round and channel; on a table partitioned by them only its files are read."""
    return slices.where((F.col("fov") == fov) & (F.col("round") == round_) & (F.col("channel") == channel))
