"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination and packing, each over all of `documents`.

All stages but the last return the columns of documents (COLUMNS) of the documents that stay; other columns of docs are not
read and do not come out. An empty table gives an empty table in every stage. Repeated rows are rows of their own until the
third stage. Ids may be null or repeated; what a null text means is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import decontaminate, labels, language_id, line_dedup, packing, shared, simhash_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _own(docs: DataFrame) -> DataFrame:
    """docs with the columns of documents alone; a table that has no others stays as it was read."""
    return docs if tuple(docs.columns) == COLUMNS else docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model can tell stay, with a score of 0.5 at least; those without letters go.

    So a null or empty text goes. The language column teaches where it is not null; without any, all documents go."""
    docs = _own(docs)
    model = language_id.train(docs.where(labels.crc_mod("doc_id", 4) != 2))
    told = language_id.predict(docs, model)
    return told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= 0.5)).select(*COLUMNS)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; a document of which no word is left goes, and n_chars is counted anew.

    A text that loses no line stays as it is, null and empty ones too. Of repeated rows one keeps its lines."""
    out = line_dedup.dedup_lines(_own(docs), grams=True)
    left = (F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]")
    return out.where(left).withColumn("n_chars", F.when(F.col("n_removed_lines") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, by the smallest id; texts without words, null ones too, are a group."""
    return simhash_dedup.keep_first(_own(docs)).select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none. A benchmark without items removes nothing."""
    return decontaminate.clean(_own(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens; a null or empty text is its end token alone."""
    import public_tokenizers

    return packing.pack(_own(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", remove_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: SQL has no SimHash groups of lines or texts and no tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
