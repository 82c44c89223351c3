"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word stems (the first 4 to 6 bytes) that labelled toxic documents have far more often
than others. While the trees are trained, a document's own contribution is taken out of the lexicon's counts, so that
rare words of the training rows do not look better than they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import kernels as K
from cellweave.llm import shared

STEMS = (4, 5, 6)
# Second-person pronouns in English, German, French and Spanish.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu toi te ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros os vuestro"
).split()
#: Characters that stand for letters in obfuscated words.
LOOKALIKE = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}
_MIX = K.BYTE_MIX_LOWER.copy()
for _sign, _letter in LOOKALIKE.items():
    _MIX[ord(_sign)] = _MIX[ord(_letter)]
_EDGE = np.isin(np.arange(256), list(b".,;:!?\"'()[]{}*#%&|<>-_"))
_ALPHA = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_PUNCT = np.array([33 <= b <= 126 and not chr(b).isalnum() for b in range(256)])
_ODD = np.array([chr(b) in LOOKALIKE or chr(b) in "*#%&" for b in range(256)])
NAMES = ("log_hits", "hit_density", "log_stem_hits", "stem_density", "window_hits", "near_second_person", "second_person", "capitals", "exclamations", "questions", "punctuation", "obfuscation", "log_words")


def fold_accents(data: np.ndarray) -> np.ndarray:
    """UTF-8 with Latin-1 capitals in lower case; ASCII is left to the hash table."""
    out = data.copy()
    at = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.empty(0, np.int64)
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 0x20
    return out


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words' starts, ends and first of each row, hash of each word without outer marks, hashes of its stems)."""
    starts, ends, first = K.words(data, offsets)
    lo, hi = K.without_marks(data, starts, ends, _EDGE)
    prefix = K.rolling(_MIX[fold_accents(data)])
    word = K.hash_between(prefix, lo, hi)
    stems = np.stack([K.mix(K.hash_between(prefix, lo, np.minimum(lo + n, hi)) ^ np.uint64(n)) * (hi - lo >= n).astype(np.uint64) for n in STEMS])
    return starts, ends, first, word, stems


@dataclass
class Lexicon:
    """Sorted term hashes with the numbers of toxic and other training documents that have them."""

    term: np.ndarray
    toxic: np.ndarray
    other: np.ndarray
    n_toxic: int
    n_other: int

    def odds(self, toxic, other):
        return np.log((toxic + 0.5) / (self.n_toxic + 1)) - np.log((other + 0.5) / (self.n_other + 1))

    def hits(self, hashes: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        """Which hashes are toxic terms; own: the label of each one's document, whose contribution is taken out."""
        if not len(self.term):
            return np.zeros(hashes.shape, bool)
        at = np.minimum(np.searchsorted(self.term, hashes), len(self.term) - 1)
        toxic, other = self.toxic[at], self.other[at]
        if own is not None:
            toxic, other = np.maximum(toxic - own, 0), np.maximum(other - (1 - own), 0)
        return (self.term[at] == hashes) & (toxic >= 2) & (self.odds(toxic, other) >= 2.3)


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, labels: np.ndarray | None = None) -> np.ndarray:
    """(rows, NAMES) dense features of whole texts."""
    starts, ends, first, word, stems = terms(data, offsets)
    n = np.diff(first)
    words, chars = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
    own = np.repeat(labels, n) if labels is not None else None
    whole = lexicon.hits(word, own)
    stem = lexicon.hits(stems, own).any(0)
    hit = whole | stem
    second = np.isin(word, _second_person())
    total = np.concatenate([[0], np.cumsum(hit)])
    spot = np.concatenate([[0], np.cumsum(second)])
    row_lo, row_hi = np.repeat(first[:-1], n), np.repeat(first[1:], n)
    place = np.arange(len(word))
    window = total[np.minimum(place + 50, row_hi)] - total[place]
    densest = np.zeros(len(n))
    full = np.flatnonzero(n > 0)
    if len(full):
        densest[full] = np.maximum.reduceat(window, first[full])
    near = hit & (spot[np.minimum(place + 6, row_hi)] > spot[np.maximum(place - 5, row_lo)])
    letters = np.concatenate([[0], np.cumsum(_ALPHA[data])])
    odd = np.concatenate([[0], np.cumsum(_ODD[data])])
    inner_lo, inner_hi = np.minimum(starts + 1, ends), np.maximum(ends - 1, np.minimum(starts + 1, ends))
    obscured = (odd[inner_hi] > odd[inner_lo]) & (letters[ends] - letters[starts] >= 2)
    count = lambda flags: K.per_row(flags, first)
    of_bytes = lambda table: K.per_row(table[data], offsets)
    hits, stem_hits = count(whole), count(stem)
    return np.stack(
        [
            np.log1p(hits), hits / words, np.log1p(stem_hits), stem_hits / words, densest, count(near) / words, count(second) / words,
            of_bytes(_UPPER) / np.maximum(of_bytes(_ALPHA), 1), K.per_row(data == 33, offsets) / words, K.per_row(data == 63, offsets) / words,
            of_bytes(_PUNCT) / chars, count(obscured) / words, np.log1p(n),
        ],
        axis=1,
    )


_pronouns: np.ndarray | None = None


def _second_person() -> np.ndarray:
    global _pronouns
    if _pronouns is None:
        raw = [w.encode() for w in SECOND_PERSON]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(w) for w in raw])
        _pronouns = K.hash_between(K.rolling(_MIX[data]), ends - [len(w) for w in raw], ends)
    return _pronouns


def term_batches(batches):
    """mapInArrow function from (y, text) to (term, toxic, other): in how many documents of each label a term is."""
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in K.text_slices(batch.column(1)):
            _, _, first, word, stems = terms(data, offsets)
            row = np.repeat(np.arange(hi - lo), np.diff(first))
            term, row = np.concatenate([word, *stems]), np.tile(row, 1 + len(STEMS))
            order = np.lexsort((row, term))
            term, row = term[order], row[order]
            new = (term != 0) & np.append(True, (term[1:] != term[:-1]) | (row[1:] != row[:-1]))[: len(term)]
            term, label = term[new], y[lo:hi][row[new]]
            begin = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
            if len(begin):
                toxic, every = np.add.reduceat(label, begin, dtype=np.int64), np.diff(np.append(begin, len(term)))
                yield pa.record_batch([pa.array(term[begin].view(np.int64)), pa.array(toxic), pa.array(every - toxic)], ["term", "toxic", "other"])


@dataclass
class Model:
    lexicon: Lexicon
    trees: object
    calibration: object
    base_rate: float


def train(rows: DataFrame, trees: int = 40, depth: int = 3, seed: int = 7) -> Model:
    """Fit on a bounded sample (id, text, y), y being 0 or 1.

    All terms that toxic rows have far more often are in the lexicon: those of at least a 200th of the toxic rows, so at
    most 800 times the number of different words of an average one. Calibration is fitted on raw probabilities rounded to
    a thousandth, of which there are 1,001 at most.

    Three quarters of the rows (by a hash of the id) train the trees, the rest the calibration. Without rows of both
    labels in both parts there are no trees, and every score is the share of label 1 (0 without rows).
    """
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0
    n = {(r["y"], r["part"]): r["n"] for r in rows.groupBy("y", part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = (sum(v for (y, _), v in n.items() if y == k) for k in (1, 0))
    found = rows.select("y", "text").mapInArrow(term_batches, "term long, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    least = max(3, n_toxic // 200)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") - 0.5) / (n_other + 1))
    odds = F.when(F.col("other") <= 1, F.lit(1e9)).otherwise(odds)
    kept = found.where((F.col("toxic") >= least) & (odds >= 2.3)).toPandas()
    term = kept.term.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(term)
    lexicon = Lexicon(term[order], kept.toxic.to_numpy(np.int64)[order], kept.other.to_numpy(np.int64)[order], n_toxic, n_other)
    rate = n_toxic / max(n_toxic + n_other, 1)
    if len({k for k, v in n.items() if v}) < 4:
        return Model(lexicon, None, None, rate)
    given = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in K.text_slices(batch.column(2), 1 << 20):
                x = features(data, offsets, given.value, y[lo:hi].astype(np.int64))
                values = shared.lists(x.ravel(), np.arange(len(x) + 1) * len(NAMES))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), values], ["y", "part", "x"])

    table = shared.cut(rows.select("y", part.alias("part"), "text").mapInArrow(run, "y int, part boolean, x array<double>"))
    table = table.select(F.col("y").cast("double").alias("label"), "part", array_to_vector("x").alias("features"))
    least_rows = max(1, min(10, n_toxic // 20))  # leaves of single rows would learn noise
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, minInstancesPerNode=least_rows).fit(table.where("not part").repartition(8))
    held = fitted.transform(table.where("part")).groupBy("label", F.round(vector_to_array("probability")[1], 3).alias("raw")).agg(F.count(F.lit(1)).cast("double").alias("rows"))
    return Model(lexicon, fitted, IsotonicRegression(featuresCol="raw", weightCol="rows").fit(held), rate)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id_col, score, predicted): a calibrated probability, and whether it is at least 0.5.

    Whole texts are read; a null or empty text has zero features. Repeated rows and null ids are scored like any other.
    """
    if model.trees is None:
        return docs.select(id_col, F.lit(float(model.base_rate)).alias("score"), F.lit(int(model.base_rate >= 0.5)).alias("predicted"))
    given = docs.sparkSession.sparkContext.broadcast(model.lexicon)

    def kernel(data, offsets):
        x = features(data, offsets, given.value)
        return (shared.lists(x.ravel(), np.arange(len(x) + 1) * len(NAMES)),)

    rows = shared.append(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), "body", kernel, "x array<double>", ["id"])
    out = model.trees.transform(rows.select("id", array_to_vector("x").alias("features"))).select("id", vector_to_array("probability")[1].alias("raw"))
    out = model.calibration.transform(out).select(F.col("id").alias(id_col), F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
