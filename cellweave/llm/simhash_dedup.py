"""SimHash near-duplicates by anchor-point covering.

The 64 fingerprint bits form three blocks of 23, 23 and 18 bits. The anchors of a block are the 4,096 code words of the
perfect binary Golay code, whose covering radius is 3: every 23-bit word has exactly one anchor within 3. If two
fingerprints differ in at most 4 bits, then in one pair of blocks they differ in at most 2, so a word halfway between
them differs from both in at most 1 bit, and the anchors of that halfway word lie within 3 + 1 of both. Each fingerprint
is therefore copied to all anchor pairs within covering radius plus that share of the threshold (about 29 copies over
the three block pairs), and only fingerprints at the same anchor pair are compared. No link is missed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import kernels as K
from cellweave.llm import shared

MOST_BITS = 4
BLOCKS = ((0, 23), (23, 23), (46, 18))
_GENERATOR = 0b101011100011


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of all 23-bit words by their high and low part, coset leaders, and weight-4 errors by syndrome (-1: none)."""

    def residue(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= _GENERATOR << (k - 11)
        return x

    unit = [residue(1 << k) for k in range(23)]
    syndrome = lambda x: np.bitwise_xor.reduce([u for k, u in enumerate(unit) if x >> k & 1] or [0])
    low = np.array([syndrome(x) for x in range(1 << 12)], np.int64)
    high = np.array([syndrome(x << 12) for x in range(1 << 11)], np.int64)
    leader, fours = np.zeros(2048, np.int64), [[] for _ in range(2048)]
    for weight in range(5):
        for chosen in combinations(range(23), weight):
            error = sum(1 << k for k in chosen)
            s = int(low[error & 4095] ^ high[error >> 12])
            if weight < 4:
                leader[s] = error
            else:
                fours[s].append(error)
    near = np.full((2048, max(map(len, fours))), -1, np.int64)
    for s, errors in enumerate(fours):
        near[s, : len(errors)] = errors
    return np.concatenate([low, high]), leader, near


_tables: tuple | None = None


def anchors(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each 23-bit word: its anchor within 3 (12 bits), and those at distance 4, one column each (-1: none)."""
    global _tables
    _tables = _tables or _golay()
    syndromes, leader, near = _tables
    s = syndromes[word & 4095] ^ syndromes[4096 + (word >> 12)]
    far = near[s]
    return (word ^ leader[s]) >> 11, np.where(far < 0, -1, (word[:, None] ^ far) >> 11)


def fingerprint_batches(shingle: int):
    """mapInArrow function from (id, text, ...) to (id, fp): the text column becomes its 64-bit SimHash."""

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = []
            for _, _, data, offsets in K.text_slices(batch.column(1), 1 << 20):
                data = K.LOWER[data]
                starts, ends, first = K.words(data, offsets)
                lengths = ends - starts + 1
                begin, place = K.positions(lengths)
                joined = data[np.minimum(place + np.repeat(starts, lengths), len(data) - 1)] if len(data) else data
                joined[begin + lengths - 1] = 32
                text = joined.tobytes()
                n_words = np.diff(first)
                n = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
                _, place = K.positions(n)
                i = np.repeat(first[:-1], n) + place
                j = np.minimum(i + shingle, np.repeat(first[1:], n)) - 1
                lo, hi = begin[i].tolist(), (begin + lengths - 1)[j].tolist()
                hashes = np.fromiter((digest(text[a:b], 42) for a, b in zip(lo, hi, strict=True)), np.uint64, len(lo))
                out.append(K.majority_bits(hashes, np.concatenate([[0], np.cumsum(n)])))
            fp = np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(fp)], ["id", "fp"])

    return K.releasing(run)


def anchor_batches(batches):
    """mapInArrow function from (fp, id) to (key, fp, id), one row for each anchor pair."""
    for batch in batches:
        fp, ident = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        home, far = zip(*(anchors((fp.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1)) for at, n in BLOCKS), strict=True)
        keys, rows = [], []
        for table, (p, q) in enumerate(combinations(range(3), 2)):
            for first, second, each in [(home[p][:, None], home[q], 1), (far[p], home[q], 1), (far[q], home[p], 0)]:
                i, k = np.nonzero(first >= 0)
                pair = (first[i, k], second[i]) if each else (second[i], first[i, k])
                keys.append((table << 24) | (pair[0] << 12) | pair[1])
                rows.append(i)
        i = np.concatenate(rows)
        yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(fp[i]), pa.array(ident[i])], ["key", "fp", "id"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = MOST_BITS) -> DataFrame:
    """One row per document: (id_col, fp long, component_id long, copies long: documents with its very fingerprint).

    The fingerprint is made of the XXH64 (seed 42) of all shingles of `shingle` words of the text with A-Z lower-cased,
    repeats included; a text of fewer words is one shingle, and one without words (empty, null) has fingerprint zero and
    is linked like any other. component_id is the least id in reach over fingerprints that differ in at most max_bits.
    A row whose id is null takes part with its fingerprint only if a row with an id has the same one; else its
    component_id is null. Repeated rows come out repeated; other columns are not read. An empty table gives no rows.
    """
    if not 0 <= max_bits <= MOST_BITS:
        raise ValueError(f"these anchors cover distances up to {MOST_BITS}")
    prints = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = shared.cut(prints.mapInArrow(fingerprint_batches(shingle), "id long, fp long"))
    each = shared.cut(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    keyed = each.where("rep is not null").select("fp", F.col("rep").alias("id")).mapInArrow(anchor_batches, "key long, fp long, id long")
    found = shared.components(shared.linked_in_buckets(keyed, max_bits))
    placed = each.join(found, each.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component"), "copies")
    # Only fingerprints that gather several documents need a look-up; the others keep their own id.
    gathered = shared.cut(placed.join(each.select("fp", "rep"), "fp").where("copies > 1 or component <> rep").select("fp", "component", "copies"))
    return prints.join(gathered, "fp", "left").select(
        F.col("id").alias(id_col), "fp", F.coalesce("component", "id").alias("component_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without all but one document of each component: that with the least id stays, as all its columns were.

    Rows with a null id stay, since they can't be told apart; of repeated rows with the id that stays, all stay.
    """
    out = near_duplicates(docs, id_col, **options).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(out, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
