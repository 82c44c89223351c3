"""Quality rules: lines that too many documents of one host share are boilerplate; documents that lose too much go.

Base rules look at a document alone (too few words, too much repetition). The method's own verdict looks across
documents: every line is normalised and hashed, the distinct documents of each (host, line) are counted, lines above
the limit are removed, and a document that is depleted by that is rejected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import kernels as K
from cellweave.llm import shared

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, hashes array<long>, sizes array<long>"


def measure(data: np.ndarray, offsets: np.ndarray, window: int = 5):
    """Per row the measures of FIELDS; hashes and sizes: its distinct normalised lines with a word, and their words.

    A normalised line is its words, A-Z lower-cased, with one space between.
    """
    rows = len(offsets) - 1
    in_word = K.IS_WORD[data]
    starts, ends, first = K.words(data, offsets)
    n_words = np.diff(first)
    word_chars = K.per_row(in_word & ((data & 0xC0) != 0x80), offsets)
    n_symbols = K.per_row(SYMBOLS[data], offsets)

    line_start, line_end, first_line = K.lines(data, offsets)
    line_row = np.repeat(np.arange(rows), np.diff(first_line))
    line_word = np.searchsorted(starts, np.append(line_start, len(data)))  # of each line, its first word
    has_word = line_word[1:] > line_word[:-1]
    exact = K.hash_spans(data, line_start, line_end)
    salt = K.mix(np.arange(1, rows + 1, dtype=np.uint64))
    _, seen = np.unique(K.mix(exact[has_word] ^ salt[line_row[has_word]]), return_index=True)
    again = np.zeros(int(has_word.sum()), bool)
    again[:] = True
    again[seen] = False
    n_dup_lines = np.bincount(line_row[has_word][again], minlength=rows)

    n_windows = np.maximum(n_words - window + 1, 0)
    _, place = K.positions(n_windows)
    begin = np.repeat(first[:-1], n_windows) + place
    prefix = K.rolling(K.hash_spans(data, starts, ends))
    content = K.mix(K.hash_between(prefix, begin, begin + window) ^ np.repeat(salt, n_windows))
    order = np.argsort(content, kind="stable")
    same = content[order][1:] == content[order][:-1]
    twice = np.zeros(len(content), bool)
    twice[order] = np.append(same, False) | np.append(False, same) if len(content) else twice
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, begin[twice], 1)
    np.add.at(cover, begin[twice] + window, -1)
    n_repeat_words = K.per_row(np.cumsum(cover)[:-1] > 0, first)

    lower = K.rolling(K.hash_spans(data, starts, ends, K.BYTE_MIX_LOWER))
    normal = K.hash_between(lower, line_word[:-1], line_word[1:])[has_word].view(np.int64)
    row, size = line_row[has_word], np.diff(line_word)[has_word]
    order = np.lexsort((normal, row))
    new = np.append(True, (normal[order][1:] != normal[order][:-1]) | (row[order][1:] != row[order][:-1])) if len(order) else np.empty(0, bool)
    group = np.flatnonzero(new)
    words_of = np.add.reduceat(size[order], group) if len(group) else group
    distinct_first = np.searchsorted(row[order][group], np.arange(rows + 1))
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, shared.lists(normal[order][group], distinct_first), shared.lists(words_of, distinct_first)


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    most_documents: int = 200, least_share: float = 0.3, least_words: int = 10, most_repeated: int = 20,
) -> DataFrame:
    """One row per document: its measures, base_failed, removed_words and kept.

    base_failed: fewer than least_words words, or over most_repeated per cent of them in five-word windows found twice.
    A line is removed where over most_documents distinct documents of one host have it; a null host is a host of its
    own. kept: not base_failed, and at least least_share of the words are left. A null or empty text has no words and
    fails. Repeated rows are judged each for itself; they count once in a line's documents if they share an id, and rows
    without an id do not count. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    made = shared.cut(shared.append(rows, "text", measure, FIELDS, ["row", "doc", "host"]))
    pairs = F.explode(F.arrays_zip("hashes", "sizes")).alias("line")
    lines = made.select("row", "doc", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), pairs)
    lines = lines.select("row", "doc", "host", "no_host", F.col("line.hashes").alias("hash"), F.col("line.sizes").alias("size"))
    key = ["host", "no_host", "hash"]
    frequent = lines.groupBy(*key).agg(F.count_distinct("doc").alias("documents")).where(F.col("documents") > most_documents).select(*key)
    removed = lines.join(shared.cut(frequent), key, "left_semi").groupBy("row").agg(F.sum("size").alias("removed_words"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = made.join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long")).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= least_share * F.col("n_words"))
    return out.select(
        F.col("doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "removed_words"
    )
