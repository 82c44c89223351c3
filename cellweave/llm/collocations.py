"""Phrase collocations: phrases of 2 to 5 words that occur often, and far more often than their parts would let one expect.

Frequent phrases come from mergeable Misra-Gries summaries. The occurrences of all n-grams are dealt by hash into
partitions; a partition's summary holds more counters than its mass divided by the threshold, so what it takes off any
counter stays under the threshold and every frequent n-gram is still there at the end. Tasks send their own summaries
(exact while they fit), which merge as they arrive. It goes by rising n: an n-gram is counted only where both its
(n - 1)-grams survived, since it cannot be more frequent than they are. The survivors reach the next pass as a filter of a
fixed number of bits, and a last pass counts exactly, as text, what every summary has let through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.llm import counting as C
from cellweave.llm import kernels as K
from cellweave.llm import shared

LONGEST = 5
UNKNOWN = "und"
#: Bytes that end a piece, and those that part words within one.
ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
IN_WORD = ~ENDS_PIECE
IN_WORD[[32, 9]] = False
#: Counters that a summary may hold in a task beyond which more partitions are used.
COUNTERS_A_PARTITION = 1 << 20


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes; start, end, row of each word; and how many words follow it in its piece (at most LONGEST - 1)."""
    data = K.LOWER[data]
    starts, ends, first = K.spans(data, offsets, IN_WORD[data])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    breaks = np.cumsum(ENDS_PIECE[data])
    piece = breaks[starts] if len(starts) else starts
    goes_on = np.zeros(len(starts), bool)
    goes_on[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
    follow = np.zeros(len(starts), np.int8)
    for _ in range(LONGEST - 1):
        follow[:-1] = np.where(goes_on[:-1], np.minimum(follow[1:] + 1, LONGEST - 1), 0)
    return data, starts, ends, row, follow


def _grams(words: np.ndarray, langs: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """A hash of language and the n words from each place."""
    prefix = K.rolling(words)
    return K.mix(K.hash_between(prefix, at, at + n) ^ langs[at])


def _open(words: np.ndarray, langs: np.ndarray, follow: np.ndarray, n: int, left) -> np.ndarray:
    """Places of the n-grams whose both (n - 1)-grams are in the filter `left`."""
    if n == 1:
        return np.arange(len(words))
    at = np.flatnonzero(follow >= n - 2)
    stay = np.zeros(len(words) + 1, bool)
    stay[at] = left.has(_grams(words, langs, n - 1, at))
    return np.flatnonzero((follow >= n - 1) & stay[:-1] & stay[1:])


def _occurrences(n: int, left):
    """mapInArrow function from (lang, text) to (h, n): the n-grams of a task that may still be frequent, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = C.Tally()
        for batch in batches:
            langs = C.of_values(batch.column(0), UNKNOWN)[0]
            for lo, _, data, offsets in K.text_slices(batch.column(1), C.SLICE_BYTES):
                data, starts, ends, row, follow = _words(data, offsets)
                words, lang = K.hash_spans(data, starts, ends), langs[lo + row]
                at = _open(words, lang, follow, n, left and left.value)
                keys, counts = C.summed(_grams(words, lang, n, at), np.ones(len(at), np.int64))
                yield from tally.add(keys, counts)
        yield from tally.rest()

    return run


class MisraGries:
    """A mergeable summary of (hash, count): every key's true count is at most its counter plus `off`, and off < threshold.

    It starts with `capacity` counters. Where they do not suffice, the (capacity + 1)-th largest count is taken off all;
    where that would bring `off` to the threshold the capacity doubles instead, which a capacity over the mass divided by
    the threshold never needs.
    """

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.off = max(1, capacity), threshold, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = C.summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        while len(self.keys) > self.capacity:
            take = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            if self.off + take >= self.threshold:
                self.capacity *= 2
                continue
            self.off += take
            left = self.counts > take
            self.keys, self.counts = self.keys[left], self.counts[left] - take

    def frequent(self) -> np.ndarray:
        """All keys whose true count may reach the threshold."""
        return self.keys[self.counts + self.off >= self.threshold]


def _summarised(capacity: int, threshold: int):
    """mapInArrow function from the (h, n) of one hash partition to the (h) that may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, parts, held = MisraGries(capacity, threshold), [], 0
        for batch in batches:
            parts.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            held += batch.num_rows
            if held > max(1 << 20, capacity):
                summary.merge(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                parts, held = [], 0
        if parts:
            summary.merge(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        keys = summary.frequent().view(np.int64)
        for at in range(0, len(keys), 1 << 16):
            yield pa.record_batch([pa.array(keys[at : at + (1 << 16)])], ["h"])

    return run


class Phrases:
    """Sums of counts by phrase within a task, told apart by two hashes; a phrase becomes text once, when it is new.

    At most about `most` phrases are held; beyond that, partial sums go out.
    """

    def __init__(self, most: int = 1 << 19):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        none = np.empty(0, np.int64)
        self.h, self.other, self.counts = none.view(np.uint64), none.view(np.uint64), none
        self.rows, self.fresh, self.size = None, [], 0

    def add(self, h: np.ndarray, other: np.ndarray, counts: np.ndarray, rows: Callable[[np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct (h, other) with their counts; rows(which) gives the (lang, phrase, size) of those that are not held."""
        at = np.searchsorted(self.h, h)
        held = at < len(self.h)
        held[held] = (self.h[at[held]] == h[held]) & (self.other[at[held]] == other[held])
        self.counts[at[held]] += counts[held]
        new = np.flatnonzero(~held)
        if len(new):
            self.fresh.append((h[new], other[new], counts[new], rows(new)))
            self.size += len(new)
        if self.size > self.most // 4:
            self._merge()
            if len(self.h) > self.most:
                yield from self.rest()

    def _merge(self) -> None:
        kept = [(self.h, self.other, self.counts, self.rows)] if len(self.h) else []
        h, other, counts, rows = zip(*kept, *self.fresh, strict=True)
        h, other, counts = np.concatenate(h), np.concatenate(other), np.concatenate(counts)
        order = np.lexsort((other, h))
        begin = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (other[order][1:] != other[order][:-1])))
        head = order[begin]
        self.h, self.other, self.counts = h[head], other[head], np.add.reduceat(counts[order], begin)
        self.rows = pa.Table.from_batches(rows).combine_chunks().take(pa.array(head)).combine_chunks().to_batches()[0]
        self.fresh, self.size = [], 0

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.fresh:
            self._merge()
        for at in range(0, len(self.h), 1 << 16):
            part = self.rows.slice(at, 1 << 16)
            yield pa.record_batch([*part.columns, pa.array(self.counts[at : at + (1 << 16)])], ["lang", "phrase", "size", "f"])
        self._clear()


def _exact(filters):
    """mapInArrow function from (lang, text) to (lang, phrase, size, f): occurrences of all n-grams that survived, with
    those of all words of a language under a null phrase of size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases()
        for batch in batches:
            langs, lang_of, names = C.of_values(batch.column(0), UNKNOWN)
            named = lambda number, names=names: pa.DictionaryArray.from_arrays(pa.array(number.astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
            for lo, _, data, offsets in K.text_slices(batch.column(1), C.SLICE_BYTES):
                data, starts, ends, row, follow = _words(data, offsets)
                if not len(starts):
                    continue
                words, lang = K.hash_spans(data, starts, ends), langs[lo + row]
                check = K.hash_spans(data, starts, ends, C.OTHER_MIX)
                all_words = np.bincount(lang_of[lo + row], minlength=len(names))
                seen = np.flatnonzero(all_words)
                yield pa.record_batch([named(seen), pa.nulls(len(seen), pa.string()), pa.array(np.zeros(len(seen), np.int32)), pa.array(all_words[seen])], ["lang", "phrase", "size", "f"])
                lengths = ends - starts + 1  # each word and one space
                begin, place = K.positions(lengths)
                joined = data[np.minimum(np.repeat(starts, lengths) + place, len(data) - 1)]
                joined[begin + lengths - 1] = 32
                stop = begin + lengths - 1
                for n in range(1, LONGEST + 1):
                    at = _open(words, lang, follow, n, filters.value[n - 2] if n > 1 else None)
                    h = _grams(words, lang, n, at)
                    left = filters.value[n - 1].has(h)
                    at, h = at[left], h[left]
                    if not len(at):
                        break
                    other = _grams(check, lang, n, at)
                    order = np.argsort(h, kind="stable")
                    new = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (other[order][1:] != other[order][:-1])))
                    head = at[order[new]]

                    def texts(which, head=head, n=n, lo=lo, row=row, joined=joined, begin=begin, stop=stop, lang_of=lang_of, named=named):
                        of = head[which]
                        return pa.record_batch([named(lang_of[lo + row[of]]), C.strings(joined, begin[of], stop[of + n - 1]), pa.array(np.full(len(of), n, np.int32))], ["lang", "phrase", "size"])

                    yield from phrases.add(h[order[new]], other[order[new]], np.diff(np.append(new, len(order))), texts)
        yield from phrases.rest()

    return run


def frequent_phrases(docs: DataFrame, least: int = 100, filter_bits: int = 26, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, size, f): all phrases of 1 to 5 words that occur at least `least` times in a language, and under a null
    phrase of size 0 the number of all its words.

    A-Z count as a-z; words are runs of bytes other than space and tab within pieces, which end at . , ; : ! ? and line
    breaks. Null texts are empty, null languages `und`; a repeated row counts again. An empty table gives no rows.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    context, filters, left = docs.sparkSession.sparkContext, [], None
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for n in range(1, LONGEST + 1):
        found = rows.mapInArrow(_occurrences(n, left), C.HASHED)
        # An upper bound of the mass: every byte but separators starts at most one n-gram.
        if n == 1:
            mass = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            parts = max(parts, -(-mass // (least * COUNTERS_A_PARTITION)))
        stay = shared.cut(found.repartition(parts, "h").mapInArrow(_summarised(mass // (least * parts) + 1, least), "h long"))
        filters.append(C.Filter.of(stay, filter_bits))
        shared.drop(stay)
        left = context.broadcast(filters[-1])
    # A task gives each phrase it holds once: few large tasks send fewer rows than many, which would each repeat the same phrases.
    counts = rows.coalesce(2 * context.defaultParallelism).mapInArrow(_exact(context.broadcast(filters)), "lang string, phrase string, size int, f long")
    counts = counts.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return counts.where((F.col("f") >= least) | (F.col("size") == 0))


def mine(docs: DataFrame, least: int = 100, top: int = 2000, filter_bits: int = 26, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), all numbers long: the `top` phrases of 2 to 5 words of each language.

    a is the phrase's count (at least `least`), n that of all words of the language. A cut after k words has the counts l and
    r of its two parts and the score floor(1000 a n / (l r)), in decimal integers; the lowest score counts, on ties the
    least k. A phrase that lies within a longer frequent one of the same count is dropped, be that one dropped or not. Ranks
    go by score and a descending, then phrase in byte order. See frequent_phrases() for words, nulls and repeated rows.
    """
    counts = shared.cut(frequent_phrases(docs, least, filter_bits, lang_col, text_col))
    phrases = counts.where("size > 0").select("lang", "phrase", "size", "f")
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    candidates = phrases.where("size > 1").withColumn("words", F.split("phrase", " "))
    run = lambda at, size: F.array_join(F.slice("words", at, size), " ")

    inner = candidates.where("size > 2").select("lang", "f", "words", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("k"))
    inner = inner.select("lang", "f", F.explode(F.expr("transform(sequence(1, size - k + 1), i -> array_join(slice(words, i, k), ' '))")).alias("phrase"))
    covers = inner.groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    left = candidates.join(covers, ["lang", "phrase"], "left").where("cover is null or cover < f")

    cuts = left.select("lang", "phrase", F.col("f").alias("a"), "words", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("first"), run(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (F.col("a") * 1000).cast("decimal(19,0)") * wide("n"), wide("l") * wide("r"))
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    out = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
