"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import kernels as K
from cellweave.llm import shared

BUCKETS = 1 << 16
LONGEST = 3
UNKNOWN = "und"
_fold: np.ndarray | None = None


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of the letters of each row, all between two letters folded to one space:
    (code points, row offsets, letters of each row)."""
    global _fold
    if _fold is None:
        _fold = np.full(1 << 21, 32, np.int32)
        alpha = [c for c in range(0x110000) if chr(c).isalpha()]
        _fold[alpha] = [ord(low) if len(low := chr(c).lower()) == 1 else c for c in alpha]
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[lead].astype(np.int32)
    wide = np.flatnonzero(code >= 0xC0)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        at, b0 = lead[wide], code[wide]
        b1, b2, b3 = ((padded[at + k] & 63).astype(np.int32) for k in (1, 2, 3))
        three, four = ((b0 & 15) << 12) | (b1 << 6) | b2, ((b0 & 7) << 18) | (b1 << 12) | (b2 << 6) | b3
        code[wide] = np.where(b0 < 0xE0, ((b0 & 31) << 6) | b1, np.where(b0 < 0xF0, three, four))
    code = _fold[code]
    row = np.searchsorted(lead, offsets)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    keep[row[:-1][row[:-1] < len(code)]] = True
    count = np.concatenate([[0], np.cumsum(keep)])
    letter = np.concatenate([[0], np.cumsum(code != 32)])
    return code[keep], count[row], np.diff(letter[row])


def ngrams(code: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams that lie within a row, and their row offsets."""
    c = code.astype(np.uint32)
    size = max(len(c) - n + 1, 0)
    h = np.full(size, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for k, factor in zip(range(n), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
        h = (h ^ c[k : k + size]) * np.uint32(factor)
    inside = np.ones(size, bool)
    for k in range(1, n):  # a gram that starts less than n before a row's end runs into the next row
        ends = first[1:] - k
        inside[ends[(ends >= 0) & (ends < size)]] = False
    if n == 1:
        inside &= code[:size] != 32
    count = np.concatenate([[0], np.cumsum(inside)])
    return (h[inside] >> np.uint32(16)).astype(np.int64), count[np.minimum(first, size)]


@dataclass
class Model:
    languages: list[str]
    #: (BUCKETS, languages) log probabilities, and the languages' log priors.
    table: np.ndarray
    prior: np.ndarray


@K.releasing
def count_batches(batches):
    """mapInArrow function from (lang, text) to (lang, bucket, n); bucket -1 counts documents."""
    counts: dict[str, np.ndarray] = {}

    def out():
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at - 1), pa.array(n[at])], ["lang", "bucket", "n"])
        counts.clear()

    for batch in batches:
        names = np.array(batch.column(0).to_pylist(), object)
        for lo, hi, data, offsets in K.text_slices(batch.column(1), 1 << 20):
            code, first, _ = letters(data, offsets)
            own = names[lo:hi]
            for lang in set(own.tolist()):
                total = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                total[0] += int((own == lang).sum())
            for n in range(1, LONGEST + 1):
                bucket, start = ngrams(code, first, n)
                size = np.diff(start)
                for lang in set(own.tolist()):
                    counts[lang][1:] += np.bincount(bucket[np.repeat(own == lang, size)], minlength=BUCKETS)
            if len(counts) > 64:
                yield from out()
    yield from out()


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most_rows: int = 20_000, most_languages: int = 500, smoothing: float = 0.5) -> Model:
    """Fit on rows with a language: on all, or beyond most_rows on about that many, chosen by a hash of the id.

    Rows without a language are left out, and null texts count as empty. No row at all gives a model without languages.
    Counts of (language, bucket) reach the driver: at most most_languages x 65,537 rows.
    """
    rows = labelled.where(F.col(lang_col).isNotNull())
    n = rows.count()
    if n > most_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    counts = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    found = counts.mapInArrow(count_batches, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found.lang.unique())
    if len(languages) > most_languages:
        raise ValueError(f"{len(languages)} languages; at most {most_languages} are expected")
    table, docs = np.full((BUCKETS, len(languages)), smoothing), np.zeros(len(languages))
    for k, lang in enumerate(languages):
        own = found[found.lang == lang]
        docs[k] = own.n[own.bucket < 0].sum()
        table[own.bucket[own.bucket >= 0], k] += own.n[own.bucket >= 0]
    return Model(languages, np.log(table / table.sum(0)).astype(np.float32), np.log(np.maximum(docs, 1) / max(docs.sum(), 1)))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with lang_pred string and score double, the posterior of that language.

    A text that is null, empty or has no letter, and any text under a model without languages, is "und" with score 0.
    Whole texts are read. Ties go to the first language by name.
    """
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(data, offsets):
        model = shared_model.value
        names = np.array([*model.languages, UNKNOWN], object)
        rows = len(offsets) - 1
        code, first, n_letters = letters(data, offsets)
        known = (n_letters > 0) & bool(model.languages)
        best, score = np.full(rows, len(names) - 1), np.zeros(rows)
        if known.any():
            logs = np.tile(model.prior, (rows, 1))
            for n in range(1, LONGEST + 1):
                bucket, start = ngrams(code, first, n)
                full = np.flatnonzero(np.diff(start) > 0)
                if len(full):
                    logs[full] += np.add.reduceat(model.table[bucket], start[full], axis=0, dtype=np.float64)
            top = logs.argmax(1)
            best[known] = top[known]
            score[known] = (1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1))[known]
        return names[best], score

    return shared.append(docs, text_col, kernel, "lang_pred string, score double", keep)
