"""Counts by 64-bit hash inside tasks, fixed-size filters of the hashes that are left, and strings of distinct spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import kernels as K

HASHED = "h long, n long"
#: A second set of byte hashes, so that equal spans are told by 128 bits within a slice.
OTHER_MIX = K.mix(K.BYTE_MIX + np.uint64(1)) | np.uint64(1)
SLICE_BYTES = 1 << 21


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sum of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts


class Tally:
    """Sums of counts by key within a task. At most about `most` keys are held; beyond that, partial sums go out."""

    def __init__(self, most: int = 1 << 19):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > 2 * self.most:
            self._merge()
            if self.size > self.most:
                yield from self.rest()

    def _merge(self) -> None:
        self.parts = [summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.size = len(self.parts[0][0])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._merge()
            keys, counts = self.parts[0]
            for at in range(0, len(keys), 1 << 16):
                yield pa.record_batch([pa.array(keys[at : at + (1 << 16)].view(np.int64)), pa.array(counts[at : at + (1 << 16)])], ["h", "n"])
        self.parts, self.size = [], 0


class Filter:
    """A set of hashes in 2**bits bits, whatever their number: has() is never wrong about a member, and may be about others."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits, self.words = bits, np.zeros(1 << (bits - 6), np.uint64) if words is None else words

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(1)) & np.uint64((1 << self.bits) - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    @classmethod
    def of(cls, hashes: DataFrame, bits: int) -> Filter:
        """The filter of a column h (long). The bits of a word are joined by Spark; at most 2**(bits - 6) words arrive."""
        at = F.shiftrightunsigned("h", 1).bitwiseAND(F.lit((1 << bits) - 1))
        words = hashes.select(F.shiftrightunsigned(at, 6).alias("word"), F.expr("1L").alias("one"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow()
        out = cls(bits)
        out.words[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        return out

    def union(self, other: Filter) -> Filter:
        return Filter(self.bits, self.words | other.words)


def of_values(column: pa.Array, absent: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(hash of each row's value, its number, the distinct values); a null counts as `absent`."""
    coded = column.cast(pa.string()).fill_null(absent).dictionary_encode()
    values = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(v.encode(), 7) for v in values], np.uint64)
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return (hashes[number] if len(values) else np.empty(0, np.uint64)), number, values


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of valid UTF-8 bytes as an Arrow string column."""
    lengths = ends - starts
    _, place = K.positions(lengths)
    body = data[np.repeat(starts, lengths) + place] if len(place) else np.empty(0, np.uint8)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(body.tobytes()))
