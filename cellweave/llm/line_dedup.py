"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups.

A line is normalised to its words, A-Z in lower case, with one space between. Lines of fewer than `least_words` words are
never touched. Equal normalised lines collapse first; of the rest, those whose fingerprints differ in at most 3 of 64 bits
agree in two of five blocks, so they meet under at least one of ten pairs of blocks. Pairs that also have the edit
similarity are linked, and of each connected group only its first occurrence stays.

With grams=True every line with a word is deduplicated exactly, and lines of at least LEAST_CHARS characters, in any script,
also by edit similarity: two lines meet where four minima of hashes of their 5-byte grams agree, in one of 6 bands, or of
12 or 24 if both are short. The chance to meet depends on the share of common grams and not on whole words. It is a chance: of
pairs at the edge of the edit similarity many do not meet. Those that do, and whose fingerprints differ in at most
GRAM_BITS bits, are linked by their edit distance alone.

Lines are equal if two independent 64-bit hashes agree, so that chance does not remove a line even among 10^12 of them.
"""

from __future__ import annotations

import os
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm import kernels as K
from cellweave.llm import shared

BITS = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Bits of the set of wanted lines that is sent to the tasks (512 kB); a false hit costs a row, never a result.
FILTER_BITS = 1 << 22
#: Of grams: bytes; how many a line gives, by hash, if it has more; and the fewest characters of a fuzzy comparison.
GRAM, SAMPLE, LEAST_CHARS = 5, 64, 16
#: Of 24 minima four make a band. Two or three bits of each make a fingerprint, which differs in at most GRAM_BITS bits
#: before the edit check.
MINIMA = 24
_mixed = [np.random.default_rng(k).permutation(MINIMA).reshape(6, 4).tolist() for k in (1, 2)]
BANDS = [[4 * k, 4 * k + 1, 4 * k + 2, 4 * k + 3] for k in range(6)] + [[k, k + 6, k + 12, k + 18] for k in range(6)] + _mixed[0] + _mixed[1]
GRAM_BITS = 14
#: Lines of at most so many bytes get so many bands, since one edit changes more of their grams; fingerprints of
#: those up to SHORT_PRINT bytes have SHORT_BITS bits.
SHORT, SHORT_BITS = ((96, 24), (192, 12), (1 << 62, 6)), 52
SHORT_PRINT = 192
#: Slots of a task's memory of lines whose keys it has given; a line that it forgets gives its keys again.
SLOTS = 1 << 18
#: Lines whose distances are taken together: how many, and the entries of the table of symbols of 64 rows of them and
#: of the table of their other lines' symbols. The larger, the less a step costs for each.
LANES, BATCH, CELLS = 1 << 12, 1 << 19, 1 << 22
_CHECK = np.uint64(0x5851F42D4C957F2D)
_SPACED = np.where(K.IS_WORD, K.LOWER, np.uint8(32))
_FACTORS = np.random.default_rng(64).integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel over the shorter text (Myers, 1999; Hyyrö, 2003)."""
    lo, end = 0, min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    a, b = a[lo:], b[lo:]
    cut, end = 0, min(len(a), len(b))
    while cut < end and a[-1 - cut] == b[-1 - cut]:
        cut += 1
    a, b = (a[:-cut], b[:-cut]) if cut else (a, b)
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | x
        plus, minus = down | ~(d | up), up & d
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = (minus | ~(d | plus)) & full, plus & d
    return score


def _aligned_cost(u: list[str], v: list[str], most: int) -> int:
    """An upper bound of the edit distance of two lists of words joined by spaces, by a greedy alignment; stops beyond `most`."""
    i = j = cost = 0
    while i < len(u) and j < len(v) and cost <= most:
        if u[i] == v[j]:
            i, j = i + 1, j + 1
            continue
        for x, y in _STEPS:
            if i + x < len(u) and j + y < len(v) and u[i + x] == v[j + y]:
                break
        else:
            x, y = 1, 1
        cost += max(sum(map(len, u[i : i + x])) + x, sum(map(len, v[j : j + y])) + y) - bool(x and y)
        i, j = i + x, j + y
    return cost + max(sum(map(len, u[i:])) + len(u) - i, sum(map(len, v[j:])) + len(v) - j)


_STEPS = ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2), (2, 2), (2, 0), (0, 2))


def _close_words(u: list[str], v: list[str], most: int) -> bool:
    """Whether an alignment of words shows that the edit distance is at most `most`."""
    if len(u) == len(v) and sum([max(len(x), len(y)) for x, y in zip(u, v, strict=True) if x != y]) <= most:
        return True
    known, other = set(v), set(u)  # an alignment pays at least for the words of one line that the other one lacks
    if sum([len(x) for x in u if x not in known]) > most or sum([len(x) for x in v if x not in other]) > most:
        return False
    return _aligned_cost(u, v, most) <= most


def similar(a: str, b: str, least: float, least_common: float = 0.0) -> bool:
    """Whether 1 - edit distance / longer length is at least `least`.

    Lines that an alignment of words shows to be close enough need no edit distance. With least_common, pairs with a
    smaller Jaccard similarity of 5-grams, or under a third of it in common pairs of words, are taken as dissimilar.
    """
    longest = max(len(a), len(b))
    most = int((1 - least) * longest + 1e-9)
    if longest - min(len(a), len(b)) > most:
        return False
    u, v = a.split(" "), b.split(" ")
    if _close_words(u, v, most):
        return True
    if least_common:
        if min(len(u), len(v)) >= 8:
            x, y = set(zip(u, u[1:], strict=False)), set(zip(v, v[1:], strict=False))
            if 3 * len(x & y) < least_common * max(len(x), len(y)):
                return False
        x, y = ({t[k : k + GRAM] for k in range(max(len(t) - GRAM + 1, 1))} for t in (a, b))
        if len(x & y) < least_common * len(x | y):
            return False
    return edit_distance(a, b) <= most


def _deltas(same: np.ndarray, text: np.ndarray, plus_in: np.ndarray, minus_in: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where 64 rows of edit distances rise and fall from column to column, a bit for each row, in many tables at once.

    text has a row for each column and tells in `same` which rows of the table hold its symbol; plus_in and minus_in tell
    where the row above rises and falls.
    """
    size = text.shape[1]
    plus, minus, one = np.empty(text.shape, np.uint64), np.empty(text.shape, np.uint64), np.uint64(1)
    up, down = np.full(size, ~np.uint64(0)), np.zeros(size, np.uint64)
    eq, x, y = (np.empty(size, np.uint64) for _ in range(3))
    for t, p, d, p_in, d_in in zip(text, plus, minus, plus_in, minus_in, strict=True):
        same.take(t, out=eq, mode="clip")
        np.bitwise_or(eq, down, out=y)
        eq |= d_in
        np.bitwise_and(eq, up, out=x)
        x += up
        x ^= up
        x |= eq
        np.bitwise_and(up, x, out=d)
        x |= up
        np.invert(x, out=x)
        np.bitwise_or(down, x, out=p)
        np.left_shift(p, one, out=x)
        x |= p_in
        np.bitwise_and(x, y, out=down)
        x |= y
        np.invert(x, out=x)
        np.left_shift(d, one, out=up)
        up |= d_in
        up |= x
    return plus, minus


def _least_run(same: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The least distance of 64 symbols to any run of the text, in many tables of _deltas()'s form at once."""
    size, one, top = text.shape[1], np.uint64(1), np.uint64(63)
    up, down, score = np.full(size, ~np.uint64(0)), np.zeros(size, np.uint64), np.full(size, 64, np.uint64)
    least, eq, x, y, d = score.copy(), *(np.empty(size, np.uint64) for _ in range(4))
    for t in text:
        same.take(t, out=eq, mode="clip")
        np.bitwise_or(eq, down, out=y)
        np.bitwise_and(eq, up, out=x)
        x += up
        x ^= up
        x |= eq
        np.bitwise_and(up, x, out=d)
        x |= up
        np.invert(x, out=x)
        x |= down
        np.right_shift(x, top, out=eq)
        score += eq
        np.right_shift(d, top, out=eq)
        score -= eq
        np.minimum(least, score, out=least)
        x <<= one
        np.bitwise_and(x, y, out=down)
        x |= y
        np.invert(x, out=x)
        np.left_shift(d, one, out=up)
        up |= x
    return least.astype(np.int64)


def _columns(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, symbols: int) -> np.ndarray:
    """A row for each column of many tables: its symbols' places in _deltas()'s `same`; `symbols` behind a text's end."""
    row = np.arange(int(size.max()))[:, None]
    text = codes.take(begin + row, mode="clip")
    text[row >= size] = symbols
    text += np.arange(len(begin)) * (symbols + 1)
    return text


def _reach(m: np.ndarray, n: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far columns may lie before and behind their row where `most` edits lead from length m to n: who goes off must come back."""
    spare = (most - np.abs(n - m)) // 2
    return spare + np.maximum(m - n, 0), spare + np.maximum(n - m, 0)


def _one_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`, bit-parallel over the rows within _reach() of each column (Hyyrö, 2003).

    Bit t stands for row column - ahead + t; rows outside of the text match nothing. Now and then it is looked whether any
    cell can still lead there.
    """
    m, n = len(a), len(b)
    spare = (most - abs(n - m)) // 2
    back, ahead = spare + max(m - n, 0), spare + max(n - m, 0)
    top, full = back + ahead, (1 << back + ahead + 1) - 1
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") << ahead for c in set(a) & set(b)}
    slant = np.abs(np.arange(top + 1) - ahead - (m - n))  # of a cell, as many edits lie ahead at least
    up, down, last = full ^ (1 << ahead) - 1, 0, back
    look = step = max(128, n // 16)
    for j, c in enumerate(b):
        x = at.get(c, 0) >> j & full
        d = (((x & up) + up) ^ up) & full | x | down
        plus, minus = down | full ^ (d | up), d & up
        last += 1 - (d >> top)
        d >>= 1
        up, down = minus | full ^ (d | plus), d & plus
        if j == look:
            look += step
            rise, fall = (np.unpackbits(np.frombuffer(z.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")[:top].astype(np.int64) for z in (up, down))
            cells = np.append(0, np.cumsum(rise - fall))
            if (last - cells[-1] + cells + slant).min() > most:
                return False
    behind = (1 << top) - (1 << m - n + ahead)
    return last - (up & behind).bit_count() + (down & behind).bit_count() <= most


def _far_apart(codes: np.ndarray, begin: np.ndarray, m: np.ndarray, n: np.ndarray, most: np.ndarray, symbols: int) -> np.ndarray:
    """Of some pairs of _band_within()'s form, whose distance is over `most`, that it is.

    Each 64 symbols of a line stand, in the other one, within _reach() of their own place, or the distance is larger
    anyway; the least distances of every second 64 to any run there add up to no more than the whole distance.
    """
    back, ahead = _reach(m, n, most)
    width, total = symbols + 1, np.zeros(len(m), np.int64)
    parts = (m // 64 + 1) // 2
    pair, place = np.repeat(np.arange(len(m)), parts), K.positions(parts)[1] * 128
    lo = np.maximum(place - back[pair], 0)
    w = np.minimum(place + 64 + ahead[pair], n[pair]) - lo
    order = np.argsort(w, kind="stable")
    while len(order):
        now = order[: min(LANES, max(1, BATCH // width))]
        now = now[: max(1, int(np.count_nonzero(w[now] * np.arange(1, len(now) + 1) <= CELLS)))]
        order = order[len(now) :]
        lane, of = np.arange(len(now)), pair[now]
        row = np.tile(np.arange(64), len(now))
        same = np.zeros(len(now) * width, np.uint64)
        np.add.at(same, np.repeat(lane * width, 64) + codes[np.repeat(begin[0, of] + place[now], 64) + row], np.uint64(1) << row.astype(np.uint64))
        text = _columns(codes, begin[1, of] + lo[now], w[now], symbols)
        np.add.at(total, of, _least_run(same, text))
    return total > most


def _band_within(codes: np.ndarray, begin: np.ndarray, m: np.ndarray, n: np.ndarray, most: np.ndarray, symbols: int) -> np.ndarray:
    """Whether the edit distances of pairs are at most `most`, bit-parallel over all pairs and 64 rows at once (Hyyrö, 2003).

    codes holds all lines' symbols (under `symbols`), those of the two of a pair from begin[0] and begin[1]; their lengths
    m and n, 1 at least, differ by at most `most`. Only cells within the largest _reach() of the diagonal are visited, 64
    rows after 64 rows; cells at the border are taken for at least what they are. A pair is left when all cells of its last
    row are over its `most`. Behind the end of a text stands a symbol that no line has, from which no cell gets less.
    """
    width, one, done = symbols + 1, np.uint64(1), 0
    back, ahead = (int(x.max()) for x in _reach(m, n, most))
    out, live, lane = np.zeros(len(m), bool), np.arange(len(m)), np.arange(len(m))
    text = _columns(codes, begin[1], n, symbols)
    corner, before, plus, minus = np.zeros(len(m), np.int64), 0, None, None
    while len(live):
        lo, hi = max(0, done - back), min(len(text), done + 64 + ahead)
        rows = np.clip(m[live] - done, 1, 64)
        row = K.positions(rows)[1]
        same = np.zeros(len(live) * width, np.uint64)
        np.add.at(same, np.repeat(lane * width, rows) + codes[np.repeat(begin[0, live] + done, rows) + row], one << row.astype(np.uint64))
        plus_in, minus_in = np.ones((hi - lo, len(live)), np.uint64), np.zeros((hi - lo, len(live)), np.uint64)
        if plus is not None:
            known = len(plus) - (lo - before)
            plus_in[:known], minus_in[:known] = plus[lo - before :], minus[lo - before :]
        plus, minus = _deltas(same, text[lo:hi], plus_in, minus_in)
        last = (rows - 1).astype(np.uint64)
        for bits in (plus, minus):
            bits >>= last
            bits &= one
        step = plus.astype(np.int8)
        step -= minus.astype(np.int8)
        cells = np.cumsum(step, axis=0, dtype=np.int32)
        first = corner + rows  # where this row begins, before its first column
        ends = np.flatnonzero(m[live] <= done + 64)
        out[live[ends]] = first[ends] + cells[n[live[ends]] - 1 - lo, ends] <= most[live[ends]]
        least = first + np.minimum(cells.min(0), 0)
        done, before = done + 64, lo
        shift = min(max(0, done - back) - lo, len(cells))  # less only when no pair is left
        corner = first + (cells[shift - 1] if shift else 0)
        stay = (m[live] > done) & (least <= most[live])
        if not stay.all():
            live, corner, plus, minus = live[stay], corner[stay], plus[:, stay], minus[:, stay]
            text = text[:, stay] - (lane[stay] - np.arange(len(live))) * width
            lane = np.arange(len(live))
    return out


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each two lines is at most `most`."""
    size = np.array([[len(x) for x in a], [len(x) for x in b]], np.int64).reshape(2, -1)
    out = size.max(0, initial=0) <= most
    order = np.flatnonzero(~out & (size.min(0) > 0) & (np.abs(size[0] - size[1]) <= most))
    if not len(order):
        return out
    codes = np.frombuffer("".join([*a, *b]).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.flatnonzero(np.bincount(codes))
    rank = np.zeros(int(symbols[-1]) + 1, np.int64)
    rank[symbols] = np.arange(len(symbols))
    codes, begin = rank[codes], (np.cumsum(size.ravel()) - size.ravel()).reshape(2, -1)
    longest = size.max(0)
    if len(long := order[size[0, order] >= 512]):
        order = np.setdiff1d(order, long[_far_apart(codes, begin[:, long], size[0, long], size[1, long], most[long], len(symbols))])
    order = order[np.argsort(longest[order], kind="stable")]
    while len(order):  # lines of about one length, as many as fit
        now = order[: max(1, min(LANES, BATCH // len(symbols)))]
        alike, rather = np.searchsorted(longest[now], [max(64, longest[now[0]] * 5 // 4), longest[now[0]] * 2], "right").tolist()
        now = now[: max(alike, min(rather, 192))]  # a few more lines cost nothing
        now = now[: max(1, CELLS // int(longest[now[-1]]))]
        order = order[len(now) :]
        n, band = int(longest[now[-1]]), 64 + int(most[now].max())
        # Microseconds that both ways take; few or very long lines are compared one by one.
        if len(now) * n * (1.2 + band / 5000) < (n // 64 + 1) * min(n, band) * (16 + len(now) / 64):
            out[now] = [_one_within(a[i], b[i], k) for i, k in zip(now.tolist(), most[now].tolist(), strict=True)]
        else:
            out[now] = _band_within(codes, begin[:, now], size[0, now], size[1, now], most[now], len(symbols))
    return out


def similar_pairs(a: list[str], b: list[str], least: float) -> list[bool]:
    """similar() of each two lines; those that no alignment of words shows to be close are compared many at once."""
    most = [int((1 - least) * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)]
    out = [abs(len(x) - len(y)) <= k for x, y, k in zip(a, b, most, strict=True)]
    unsure = []
    for i in (i for i, near in enumerate(out) if near):
        if not _close_words(a[i].split(" "), b[i].split(" "), most[i]):
            unsure.append(i)
    for at in range(0, len(unsure), 1 << 13):
        now = unsure[at : at + (1 << 13)]
        for i, near in zip(now, within([a[i] for i in now], [b[i] for i in now], np.array([most[i] for i in now], np.int64)).tolist(), strict=True):
            out[i] = near
    return out


def normal_lines(data: np.ndarray, offsets: np.ndarray):
    """All lines of all rows: the normalised text, where each line begins and ends in it, and its words; the words' places; and each row's first line."""
    starts, ends, _ = K.words(data, offsets)
    line_start, _, first_line = K.lines(data, offsets)
    word = np.searchsorted(starts, np.append(line_start, len(data)))
    text, before = _SPACED[data], np.append(0, ends)
    gap = np.maximum(np.append(starts, len(data)) - before - 1, 0)  # one byte between words stays
    out = np.repeat(before + 1, gap) + K.positions(gap)[1]
    has = np.flatnonzero(np.diff(word))
    lo, hi = np.zeros((2, len(word) - 1), np.int64)
    lo[has], hi[has] = starts[word[has]], ends[word[has + 1] - 1]
    if len(out):
        text = np.delete(text, out)
        lo, hi = lo - np.searchsorted(out, lo), hi - np.searchsorted(out, hi)
    return text, lo, hi, word, starts, ends, first_line


def line_hashes(text: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each line, over eight bytes at a time and the length; 0 where `wanted` is false."""
    out, of = np.zeros((2, len(lo)), np.uint64), np.flatnonzero(wanted)
    n = (hi - lo)[of]
    size = (n + 7) // 8
    begin, place = K.positions(size)
    chunk = _eights(text)[np.repeat(lo[of], size) + 8 * place]
    rest = (8 * size - n).astype(np.uint64) * np.uint64(8)
    chunk[begin + size - 1] <<= rest  # without what comes behind the line
    for k, factor in enumerate((K.MULTIPLIER, _CHECK)):
        out[k, of] = K.mix(K.hash_between(K.rolling(K.mix(chunk ^ factor)), begin, begin + size) ^ n.astype(np.uint64) * factor)
    return out[0].view(np.int64), out[1].view(np.int64)


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of the text on, zeros behind its end."""
    return np.ndarray((len(text),), "<u8", np.append(text, np.zeros(8, np.uint8)), strides=(1,))


def fingerprints(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """SimHash of each line over its distinct words, so that one word which fills half of a line does not decide it."""
    line = np.repeat(np.arange(len(word) - 1), np.diff(word))
    hashes = hashes[word[0] : word[-1]]
    order = np.lexsort((hashes, line))
    hashes, line = hashes[order], line[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1]))[: len(hashes)]
    return K.majority_bits(hashes[new], np.searchsorted(line[new], np.arange(len(word))))


def gram_keys(text: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each wanted line that is long enough: its place, a fingerprint of its grams, and its bands' keys (0: no band)."""
    lo, hi = lo[wanted], hi[wanted]
    long_enough = hi - lo >= LEAST_CHARS
    doubt = np.flatnonzero(long_enough & (hi - lo < 4 * LEAST_CHARS))  # a character has one to four bytes
    if len(doubt):
        n = (hi - lo)[doubt]
        begin, place = K.positions(n)
        long_enough[doubt] = np.add.reduceat((text[np.repeat(lo[doubt], n) + place] & 0xC0) != 0x80, begin, dtype=np.int64) >= LEAST_CHARS
    wanted, lo, hi = wanted[long_enough], lo[long_enough], hi[long_enough]
    if not len(wanted):
        return wanted, np.empty(0, np.uint64), np.empty((0, len(BANDS)), np.uint64)
    n = hi - lo - GRAM + 1
    edges = np.stack([lo, lo + n], axis=1).ravel()
    spread = np.diff(edges, prepend=0)
    most = np.zeros(len(edges), np.uint32)
    most[1::2] = np.minimum(SAMPLE / n, 1.0) * 2**31
    h = gram_hashes(text)[: edges[-1]]
    use = h < np.repeat(most, spread)
    begin = np.add.reduceat(use, edges[:-1], dtype=np.int32)[::2]
    if not begin.all():
        most[1::2][begin == 0] = 2**31
        use = h < np.repeat(most, spread)
    use = np.flatnonzero(use)
    h, begin = h[use], np.searchsorted(use, lo)
    low, x, y = np.empty((MINIMA, len(wanted)), np.uint32), np.empty_like(h), np.empty_like(h)
    for k, factor in enumerate(_FACTORS):
        np.multiply(h, factor, out=x)
        np.right_shift(x, np.uint32(15), out=y)
        x ^= y
        x *= np.uint32(0x846CA68B)
        np.minimum.reduceat(x, begin, out=low[k])
    mixed = (low ^ low >> np.uint32(16)) * np.uint32(0x7FEB352D)
    bits = np.concatenate([mixed >> np.uint32(k) & np.uint32(1) for k in (31, 30, 29)])[:64]
    size = hi - lo
    bits[SHORT_BITS:, size <= SHORT_PRINT] = 0
    prints = np.packbits(np.ascontiguousarray(bits.T.astype(np.uint8)), axis=1, bitorder="little").view(np.uint64).ravel()
    bands = np.zeros((len(wanted), len(BANDS)), np.uint64)
    n_bands = np.array([n for _, n in SHORT])[np.searchsorted([most for most, _ in SHORT], size)]
    for first, last in ((0, 6), (6, 12), (12, 24)):
        of = np.flatnonzero(n_bands > first)
        wide = low[:, of].astype(np.uint64)
        for k in range(first, last):
            band = np.full(len(of), k + 1, np.uint64)
            for m in BANDS[k]:
                band ^= wide[m]
                band *= K.MULTIPLIER
                band ^= band >> np.uint64(29)
            bands[of, k] = K.mix(band)
    return wanted, prints, bands


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 31-bit hash of the GRAM (up to 8) bytes from each place of the text on."""
    out = np.empty(len(text), np.uint32)
    grams = _eights(text)
    for at in range(0, len(text), 1 << 15):  # what fits in a core's cache
        h = grams[at : at + (1 << 15)] << np.uint64(64 - 8 * GRAM)
        h *= K.MULTIPLIER
        h ^= h >> np.uint64(32)
        h *= K.MULTIPLIER
        h >>= np.uint64(33)
        out[at : at + (1 << 15)] = h
    return out


def block_keys(prints: np.ndarray) -> np.ndarray:
    """The keys of all pairs of pigeonhole blocks of each fingerprint."""
    block = [prints >> np.uint64(at) & np.uint64((1 << n) - 1) for at, n in BLOCKS]
    pairs = combinations(range(len(BLOCKS)), 2)
    return np.stack([np.uint64((k + 1) << 26) + (block[i] << np.uint64(13)) + block[j] for k, (i, j) in enumerate(pairs)], axis=1)


_LONGS = T.ArrayType(T.LongType())
FIELDS = (("ids", _LONGS), ("checks", _LONGS), ("fresh", T.ArrayType(T.IntegerType())), ("prints", _LONGS), ("keys", T.ArrayType(_LONGS)))


def line_batches(least_words: int, grams: bool):
    """mapInArrow function from (file, row, doc, text) to (file, row, doc) and FIELDS.

    ids and checks are both hashes of every line; fresh has the places of lines to compare that this task has not met
    before (as far as it remembers), and prints and keys are theirs.
    """

    def run(batches):
        met = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for lo, hi, data, offsets in K.text_slices(batch.column(3), 1 << 19):
                text, begin, end, word, starts, ends, first = normal_lines(data, offsets)
                ids, checks = line_hashes(text, begin, end, np.diff(word) >= max(least_words, 1))
                new = np.flatnonzero(ids != 0)
                new = new[np.sort(np.unique(ids[new], return_index=True)[1])]
                new = new[met[ids[new] & (SLOTS - 1)] != ids[new]]
                met[ids[new] & (SLOTS - 1)] = ids[new]
                if grams:
                    new, prints, keys = gram_keys(text, begin, end, new)
                else:
                    prints = fingerprints(K.hash_spans(data, starts, ends, K.BYTE_MIX_LOWER), word)[new]
                    keys = block_keys(prints)
                at = np.searchsorted(new, first).astype(np.int32)
                of = np.searchsorted(first, new, "right") - 1
                places = pa.ListArray.from_arrays(pa.array(at), pa.array((new - first[of]).astype(np.int32)))
                inner = shared.lists(keys[keys != 0].view(np.int64), np.append(0, np.cumsum((keys != 0).sum(1))))
                columns = [shared.lists(ids, first), shared.lists(checks, first), places, shared.lists(prints.view(np.int64), at), pa.ListArray.from_arrays(pa.array(at), inner)]
                own = [batch.column(k).slice(lo, hi - lo) for k in range(3)]
                yield pa.record_batch(own + columns, ["file", "row", "doc", *[f for f, _ in FIELDS]])

    return K.releasing(run)


def wanted_batches(bitmap, least_words: int):
    """mapInArrow function from (text) to (id, check, line): normalised lines whose hash is in the bitmap, mostly once a task."""

    def run(batches):
        bits, met = bitmap.value, np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, data, offsets in K.text_slices(batch.column(0)):
                text, lo, hi, word, *_ = normal_lines(data, offsets)
                ids, checks = line_hashes(text, lo, hi, np.diff(word) >= max(least_words, 1))
                at = np.flatnonzero((ids != 0) & bits[ids & (FILTER_BITS - 1)])
                at = at[np.unique(ids[at], return_index=True)[1]]
                at = at[met[ids[at] & (SLOTS - 1)] != ids[at]]
                met[ids[at] & (SLOTS - 1)] = ids[at]
                lines = pa.array([text[a:b].tobytes().decode(errors="replace") for a, b in zip(lo[at].tolist(), hi[at].tolist(), strict=True)], pa.string())
                yield pa.record_batch([pa.array(ids[at]), pa.array(checks[at]), lines], ["id", "check", "line"])

    return K.releasing(run)


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A set of ids as FILTER_BITS flags, whatever their number."""
    at = F.expr(f"id & {FILTER_BITS - 1}") + 1
    parts = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros((FILTER_BITS // 32768 + 1, 4096), np.uint8)
    for row in parts.collect():  # FILTER_BITS / 32,768 rows of 4 kB
        out[row["part"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return np.unpackbits(out.ravel(), bitorder="little")[:FILTER_BITS].astype(bool)


def _verify_pairs(least: float):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            keep = pa.array(similar_pairs(x.to_pylist(), y.to_pylist(), least), pa.bool_())
            yield pa.record_batch([a.filter(keep), b.filter(keep)], ["a", "b"])

    return K.releasing(run)


def _verify_groups(bits: int, least: float, most_rows: int = 1 << 14):
    """mapInArrow function from (near, key, fp, id, line), sorted by near and key, to links that span each group's connected parts.

    Groups that are likely to have members in common have one `near`. The groups of about most_rows rows grow their parts
    side by side, so that many lines are compared at once, and a pair of lines once.
    """

    def parts(prints, ids):
        """Asks for pairs (ids, ids) to compare, gets whether they are linked, and at last returns links that span the group's parts.

        Members go in turn, each against all later ones that it is not connected with yet: as many at once as seldom find any.
        """
        root, out, at, step = np.arange(len(ids)), [], 0, 1
        while at < len(ids) - 1:
            now = [(i, i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= bits))) for i in range(at, min(at + step, len(ids) - 1))]
            pairs = [(i, k) for i, rest in now for k in rest.tolist()]
            at += step
            if pairs:
                hit = yield [(min(ids[i], ids[k]), max(ids[i], ids[k])) for i, k in pairs]
                linked = [p for p, near in zip(pairs, hit, strict=True) if near]
                for i, k in linked:
                    if root[i] != root[k]:
                        out.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
                        root[root == root[k]] = root[i]
                step = min(2 * step, 64) if 8 * len(linked) <= len(pairs) else 1
        return out

    def links(groups):
        text = {i: line for _, ids, lines in groups for i, line in zip(ids, lines, strict=True)}
        known, out, waiting = {}, [], [(parts(np.array(fp, np.int64).view(np.uint64), ids), None) for fp, ids, _ in groups]
        while waiting:
            asked = []
            for group, hit in waiting:
                try:
                    asked.append((group, group.send(hit)))
                except StopIteration as end:
                    out += end.value
            new = list(dict.fromkeys(p for _, pairs in asked for p in pairs if p not in known))
            known.update(zip(new, similar_pairs([text[x] for x, _ in new], [text[y] for _, y in new], least), strict=True))
            waiting = [(group, [known[p] for p in pairs]) for group, pairs in asked]
        return pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        now, groups, held = None, [], 0
        for batch in batches:
            for near, key, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (near, key) != now:
                    if held >= most_rows:
                        yield links(groups)
                        groups, held = [], 0
                    now = (near, key)
                    groups.append(([], [], []))
                held += 1
                for column, value in zip(groups[-1], row, strict=True):
                    column.append(value)
        yield links(groups)

    return K.releasing(run)


def _groups(table: DataFrame, texts: DataFrame, least_words: int, similarity: float, grams: bool) -> DataFrame:
    """(id, check, component) of the fresh lines of `table` that are linked with others."""
    bits = GRAM_BITS if grams else BITS

    def run(rows):
        return shared.bucket_links(shared.without_repeats(rows), bits, small=16, large=20_000, defer_all=True, sparse=2_000 if grams else 0)

    each = table.select(F.explode(F.arrays_zip(F.transform("fresh", lambda no: F.get("ids", no)).alias("id"), F.col("prints").alias("fp"), "keys")).alias("line")).select("line.*")
    keyed = each.select(F.explode("keys").alias("key"), "fp", "id").repartition("key").sortWithinPartitions("key", "id")
    met = shared.cut(keyed.mapInArrow(K.releasing(run), shared.LINKS), large=True)
    pairs = met.where("key is null").select("a", "b").distinct()
    crowd = met.where("key is not null").select("key", F.col("b").alias("fp"), F.col("a").alias("id"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(crowd.select("id"))
    bitmap = table.sparkSession.sparkContext.broadcast(_bitmap(wanted))
    lines = texts.mapInArrow(wanted_batches(bitmap, least_words), "id long, check long, line string").groupBy("id").agg(F.min(F.struct("check", "line")).alias("line"))
    lines = lines.select("id", "line.check", "line.line")
    a, b = (lines.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}")) for x in "ab")
    # The checks take time and not space, so that their tasks are dealt by the number of pairs and not by bytes.
    sizes = met.agg(F.count_if(F.col("key").isNull()), F.count("key")).first()
    least_tasks = 4 * table.sparkSession.sparkContext.defaultParallelism
    found = pairs.hint("merge").join(a, "a").repartition(max(least_tasks, sizes[0] // 20_000), "b").join(b.hint("merge"), "b")
    found = found.select("a", "b", "line_a", "line_b").mapInArrow(_verify_pairs(similarity), "a long, b long")
    if sizes[1]:
        # Groups with one least member are much the same in several bands; those of over 4,000 are dealt in tiles.
        least = crowd.groupBy("key").agg(F.when(F.count(F.lit(1)) <= 2000, F.min("id")).alias("least"))
        crowd = shared.in_tiles(crowd.join(least, "key"), 4000).withColumn("near", F.coalesce("least", "key")).join(lines, "id")
        crowd = crowd.select("near", "key", "fp", "id", "line").repartition(max(least_tasks, sizes[1] // 20_000), "near").sortWithinPartitions("near", "key")
        found = found.union(crowd.mapInArrow(_verify_groups(bits, similarity), "a long, b long"))
    found = shared.cut(found, large=True)
    shared.drop(met)
    checks = each_check(table).join(found.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
    return shared.components(found).withColumnRenamed("node", "id").join(checks, "id").select("id", "check", "component")


def each_check(table: DataFrame) -> DataFrame:
    """(id, check) of the lines that were compared; of different lines that share the first hash, one."""
    both = F.arrays_zip(F.transform("fresh", lambda no: F.get("ids", no)).alias("id"), F.transform("fresh", lambda no: F.get("checks", no)).alias("check"))
    return table.select(F.explode(both).alias("line")).select("line.*").groupBy("id").agg(F.min("check").alias("check"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 5, similarity: float = 0.8, grams: bool = False) -> DataFrame:
    """docs without repeated lines, with two more columns: n_lines and n_removed_lines (long).

    Of each connected group of lines the first occurrence stays, in order of (id, row, line number); null ids come first.
    The other lines of a text keep their order. A null text stays null, an empty one empty, and a text all of whose lines
    go becomes empty. A repeated row loses the lines that its twin keeps. An empty table gives no rows. Rows are told
    apart by their places in their files or, if docs is not a table of Parquet files, in a copy of it in the shared folder.
    Extra columns pass through, and ValueError is raised if one of them is named n_lines, n_removed_lines, _file, _row or
    _gone. With grams, lines meet by their 5-byte grams
    and lines of any length are deduplicated, short ones exactly; least_words has no effect. Of different lines that share
    their first 64-bit hash one is compared with others; whether lines are equal is told by both hashes.
    """
    least_words = 1 if grams else least_words
    if clash := {"n_lines", "n_removed_lines", "_file", "_row", "_gone"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns already there: {sorted(clash)}")
    numbered = shared.numbered(docs)
    texts = numbered.select(F.col("_file").alias("file"), F.col("_row").alias("row"), F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = texts.drop("text").schema
    for name, kind in FIELDS:
        schema.add(name, kind)
    table = shared.cut(texts.mapInArrow(line_batches(least_words, grams), schema))
    grouped = shared.cut(_groups(table, texts.select("text"), least_words, similarity, grams))
    lines = table.select("file", "row", "doc", F.posexplode(F.arrays_zip("ids", "checks")).alias("no", "line"))
    lines = lines.select("file", "row", "doc", "no", F.col("line.ids").alias("id"), F.col("line.checks").alias("check")).where("id <> 0")
    each = lines.groupBy("id", "check").agg(F.min(F.struct("doc", "file", "row", "no")).alias("first"), F.count(F.lit(1)).alias("n"))
    each = shared.cut(each.join(grouped, ["id", "check"], "left").where("n > 1 or component is not null"), large=True)
    best = each.where("component is not null").groupBy("component").agg(F.min("first").alias("group_first"), F.count(F.lit(1)).alias("lines"))
    linked = _joined(each.where("component is not null"), best, ["component"], "lines")
    alone = each.where("component is null").select("id", "check", "n", "first")
    kept = linked.select("id", "check", "n", F.col("group_first").alias("first")).union(alone)
    kept = shared.cut(kept.select("id", "check", "n", *[F.col(f"first.{c}").alias(f"kept_{c}") for c in ("file", "row", "no")]))
    gone = _joined(lines.select("file", "row", "no", "id", "check"), kept, ["id", "check"], "n").where("file <> kept_file or row <> kept_row or no <> kept_no")
    gone = gone.groupBy(F.col("file").alias("_file"), F.col("row").alias("_row")).agg(F.collect_list("no").alias("_gone"))
    # Both sides grow with docs, so the plan is the same at every size.
    out = numbered.join(shared.cut(gone, large=True).hint("merge"), ["_file", "_row"], "left")
    split = F.split(F.col(text_col).cast("string"), "\n")
    cleaned = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    columns = [F.when(F.col("_gone").isNull(), F.col(c)).otherwise(cleaned).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split))
    return out.select(*columns, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed_lines"))


def _joined(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str, parts: int = 1000) -> DataFrame:
    """rows joined with keyed, which has each key once, with its number n of rows; keys that make up more than a part of
    all rows are joined without a shuffle.

    There are at most `parts` such keys, so theirs is a broadcast of proven size, and no other key is hot.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * parts > total
    often = F.broadcast(keyed.where(hot))
    rest = rows.join(often, keys, "left_anti").join(keyed.where(~hot).hint("merge"), keys)
    return rows.join(often, keys).select(rest.columns).union(rest)
