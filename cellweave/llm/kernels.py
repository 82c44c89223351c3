"""Vectorised text kernels that run inside Arrow tasks.

Every kernel works on the raw UTF-8 buffer of an Arrow string column, so no Python object is made per word.
A word is a run of bytes other than space and 0x09-0x0D; those bytes never occur inside a multi-byte character.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240607)
BYTE_MIX = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: As BYTE_MIX, but A-Z hash as a-z.
BYTE_MIX_LOWER = BYTE_MIX.copy()
BYTE_MIX_LOWER[65:91] = BYTE_MIX[97:123]
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[32, *range(9, 14)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def release() -> None:
    """Give free memory of the Arrow pool and, under glibc, of the C heap back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The mapInArrow function `run`, which releases memory at a task's end: Spark keeps the worker, with all that it holds."""

    @functools.wraps(run)
    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return released


def text_slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, row offsets) in pieces of about max_bytes; a null is an empty text.

    A single row longer than max_bytes is a piece of its own, so memory follows the longest text, not the batch.
    """
    texts = pc.fill_null(column, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offset_buffer, data_buffer = texts.buffers()
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(offset_buffer, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes where `inside` holds, none across rows: (starts, ends, first run of each row and the total)."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(data, offsets, IS_WORD[data])


def without_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without outer bytes that are marks, however many; of a span of marks the first one is left."""
    inner = np.flatnonzero(~marks[data])
    lo, hi = np.searchsorted(inner, starts), np.searchsorted(inner, ends)
    inner = np.append(inner, 0)
    has = hi > lo
    return np.where(has, inner[lo], starts), np.where(has, inner[hi - 1] + 1, starts + 1)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lines of each row, empty ones too: (starts, ends, first line of each row and the total)."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.empty(0, bool)
    ends = ends[: len(starts)]
    ends[last] = offsets[1:][row[last]]
    return starts, ends, np.searchsorted(row, np.arange(len(offsets)))


def positions(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these lengths laid end to end: (where each begins, each element's place in its group)."""
    begin = np.cumsum(lengths) - lengths
    return begin, np.arange(int(lengths.sum())) - np.repeat(begin, lengths)


_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
_series = {MULTIPLIER: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def powers(n: int, base: np.uint64 = MULTIPLIER) -> np.ndarray:
    """The first n powers of base modulo 2**64."""
    if len(_series[base]) < n:
        steps = np.full(max(n, 4096), base)
        steps[0] = 1
        _series[base] = np.multiply.accumulate(steps)
    return _series[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times rising powers, from which hash_between() takes any run's hash."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.multiply(values, powers(len(values)), out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def hash_between(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values from each start to each end; order counts, an empty run gives 0."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), _INVERSE)[starts])


def combine(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """hash_between() of consecutive groups of values."""
    return hash_between(rolling(values), first[:-1], first[1:])


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_MIX) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    return hash_between(rolling(table[data]), starts, ends)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def majority_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash: bit b of a group's result is 1 if b is set in over half of its hashes; 0 for an empty group."""
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts > 0)
    step = 0
    while step < len(full):
        stop = max(step + 1, int(np.searchsorted(first[full], first[full[step]] + 200_000)))
        group = full[step:stop]
        lo, hi = first[group[0]], first[group[-1] + 1]
        bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if len(group) == 1 or int(counts[group].max()) >= 65536:
            ones = np.stack([bits[first[g] - lo : first[g + 1] - lo].sum(0, dtype=np.int64) for g in group])
        else:
            ones = np.add.reduceat(bits, first[group] - lo, axis=0, dtype=np.uint16)
        set_bits = (2 * ones.astype(np.int64) > counts[group][:, None]).astype(np.uint8)
        out[group] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()
        step = stop
    return out
