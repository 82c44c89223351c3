"""Bounded samples of labelled documents, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm import shared


def crc_mod(id_col: str, n: int) -> Column:
    """The remainder of the CRC32 of an id as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, allowed: Column, most_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of labelled documents that `allowed` (an expression of the id) admits, written once to the shared folder.

    Of more than most_rows labels about that many are taken, by a hash of the id. Null labels and ids are left out, of
    several labels of an id the largest counts, and of repeated documents each is a row.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & allowed)
    rows = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    n = rows.count()
    if n > most_rows:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return shared.cut(texts.join(F.broadcast(rows), "id"))  # at most about most_rows rows of 12 bytes
