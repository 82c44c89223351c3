"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND, then an overlap check.

Every text is cut into overlapping passages, each long enough to hold any item whole, and every passage is a query. An
item's score is the sum of the BM25 weights of its terms that the passage has, as a share of the sum over all its terms.
Document frequencies, the number of items and their mean length are those of all items, however these are dealt.
A passage is skipped if the largest weights of its terms do not sum to the threshold. Items lie in blocks: of the other
passages, a block is skipped if the largest weights in it do not sum to the threshold (block-max WAND), and only the
postings of blocks that are left are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import kernels as K
from cellweave.llm import shared

BLOCK = 16
#: Words, and entries of the index, that are looked at together; a text or an index of more is taken in pieces.
STEP = 1 << 17
FIELDS = "items array<long>, scores array<double>, question_overlaps array<double>, answer_overlaps array<double>"
_EDGE = np.isin(np.arange(256), list(b".,;:!?\"'()[]{}"))


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word without outer marks and case, first word of each row)."""
    starts, ends, first = K.words(data, offsets)
    starts, ends = K.without_marks(data, starts, ends, _EDGE)
    return K.hash_spans(data, starts, ends, K.BYTE_MIX_LOWER), first


@dataclass
class Index:
    """An inverted index of items in blocks; weights are shares of an item's whole score.

    Postings are sorted by (term, item). An entry is a term's run of postings in one block, with their largest weight.
    """

    item_ids: list[int]
    term: np.ndarray
    #: The largest weight of each term, and its first entry.
    top: np.ndarray
    entries: np.ndarray
    entry_block: np.ndarray
    entry_top: np.ndarray
    #: The first posting of each entry.
    postings: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    n_blocks: int


def term_batches(batches):
    """mapInArrow function from (deal, text) to (deal, term): the terms of each item, each once."""
    for batch in batches:
        for lo, hi, data, offsets in K.text_slices(batch.column(1)):
            words, first = term_hashes(data, offsets)
            row = np.repeat(np.arange(hi - lo), np.diff(first))
            order = np.lexsort((words, row))
            words, row = words[order], row[order]
            new = np.append(True, (words[1:] != words[:-1]) | (row[1:] != row[:-1]))[: len(words)]
            deal = batch.column(0).slice(lo, hi - lo).take(pa.array(row[new]))
            yield pa.record_batch([deal, pa.array(words[new].view(np.int64))], ["deal", "term"])


def build_index(items: list[tuple[int, str]], frequency: tuple[np.ndarray, np.ndarray], n_items: int, mean_length: float, block: int = BLOCK, k1: float = 1.2, b: float = 0.75) -> Index:
    """An index of `items`; frequency (sorted terms, numbers of items that have them), n_items and mean_length are those of all items."""
    raw = [t.encode() for _, t in items]
    words, first = term_hashes(np.frombuffer(b"".join(raw), np.uint8) if raw else np.empty(0, np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]))
    length = np.diff(first)
    item = np.repeat(np.arange(len(items)), length)
    term, code = np.unique(words, return_inverse=True)
    pair, tf = np.unique(code * max(len(items), 1) + item, return_counts=True)
    of_term, of_item = pair // max(len(items), 1), pair % max(len(items), 1)
    df = frequency[1][np.searchsorted(frequency[0], term)]
    idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
    weight = idf[of_term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[of_item] / mean_length))
    weight /= np.bincount(of_item, weight, len(items))[of_item]
    n_blocks = -(-len(items) // block)
    key = of_term * max(n_blocks, 1) + of_item // block
    postings = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    entry_top = np.maximum.reduceat(weight, postings) if len(postings) else weight
    entries = np.searchsorted(of_term[postings], np.arange(len(term) + 1))
    top = np.maximum.reduceat(entry_top, entries[:-1]) if len(term) else entry_top
    question, answer = [], []
    for k, (_, text) in enumerate(items):
        own = words[first[k] : first[k + 1]]
        ends = [i + 1 for i, w in enumerate(text.encode().split()) if w[-1:] in b".?!:"]
        inner = [e for e in ends if 0 < e < len(own)]
        split = inner[-1] if inner else max(1, len(own) * 2 // 3)
        question.append(own[:split])
        answer.append(own[split:])
    blocks = of_item[postings] // block
    return Index([i for i, _ in items], term, top, entries, blocks, entry_top, np.append(postings, len(pair)), of_item, weight, question, answer, n_blocks)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of fewer words, of the whole."""
    n = min(n, len(words))
    at = np.arange(len(words) - n + 1) if n else np.empty(0, np.int64)
    return K.hash_between(K.rolling(words), at, at + n)


def overlap(part: np.ndarray, passage: np.ndarray, n: int) -> float:
    """Share of the part's word shingles that the passage has; an empty part has all."""
    own = shingles(part, n)
    return float(np.isin(own, shingles(passage, min(n, max(len(part), 1)))).mean()) if len(own) else 1.0


def _pieces(sizes: np.ndarray, most: int):
    """Consecutive ranges (lo, hi) whose sizes sum to about `most`; one that is larger stands alone."""
    total, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _expand(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the groups `which` of a list of groups that begin at `first`: (place, number in which)."""
    size = first[which + 1] - first[which]
    return np.repeat(first[which], size) + K.positions(size)[1], np.repeat(np.arange(len(which)), size)


def _score(passage: np.ndarray, term: np.ndarray, index: Index, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of scores of at least the threshold, for passages given by their terms (sorted by passage and term)."""
    entry, of = _expand(index.entries, term)
    own, number = np.unique(passage, return_inverse=True)
    block = number[of] * index.n_blocks + index.entry_block[entry]
    open_block = np.bincount(block, index.entry_top[entry], len(own) * index.n_blocks) >= threshold - 1e-9
    kept = open_block[block]
    posting, of_entry = _expand(index.postings, entry[kept])
    pair, at = np.unique(number[of][kept][of_entry] * len(index.item_ids) + index.item[posting], return_inverse=True)
    score = np.bincount(at, index.weight[posting], len(pair))
    hit = score >= threshold - 1e-9
    return own[pair[hit] // len(index.item_ids)], pair[hit] % len(index.item_ids), score[hit]


def retrieve(words: np.ndarray, first: np.ndarray, index: Index, stride: int, threshold: float) -> list[tuple[int, int, int, float]]:
    """(row, first word, item, score) of all passages and items whose score is at least the threshold."""
    n = np.diff(first)
    chunks = np.maximum(-(-n // stride), 1)
    base = np.cumsum(chunks) - chunks
    row = np.repeat(np.arange(len(n)), chunks)
    begin = first[:-1][row] + (np.arange(len(row)) - base[row]) * stride
    end = np.minimum(begin + stride, first[1:][row])
    # A passage is two chunks in a row.
    until = np.append(np.where(row[1:] == row[:-1], end[1:], end[:-1]), end[-1:])
    out = []
    for lo, hi in _pieces(until - begin, STEP):
        size = until[lo:hi] - begin[lo:hi]
        w = words[np.repeat(begin[lo:hi], size) + K.positions(size)[1]]
        at = np.minimum(np.searchsorted(index.term, w), len(index.term) - 1)
        known = index.term[at] == w
        key = np.unique(np.repeat(np.arange(lo, hi), size)[known] * len(index.term) + at[known])
        passage, term = key // len(index.term), key % len(index.term)
        enough = np.bincount(passage - lo, index.top[term], hi - lo) >= threshold - 1e-9
        passage, term = passage[enough[passage - lo]], term[enough[passage - lo]]
        group = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])[: len(passage)])
        if not len(group):
            continue
        weight = np.add.reduceat(index.entries[term + 1] - index.entries[term], group) + index.n_blocks
        for x, y in _pieces(weight, 8 * STEP):
            part = slice(group[x], group[y] if y < len(group) else len(passage))
            for p, item, score in zip(*_score(passage[part], term[part], index, threshold), strict=True):
                out.append((int(row[p]), int(begin[p]), int(item), float(score)))
    return out


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, item_col: str = "item_id", item_text: str = "text",
         threshold: float = 0.6, least_overlap: float = 0.5, shingle: int = 5, most_words: int = 1 << 21, block: int = BLOCK) -> DataFrame:
    """docs (or its columns `keep`) with the columns of FIELDS: the benchmark items found in each row's text, by rising id.

    An item counts if a passage reaches the threshold and holds at least least_overlap of the word shingles of the item's
    question and of its answer. The answer is the last sentence; an item of one sentence is split two thirds in. A null or
    empty text has none; items that are null or have no word are left out, repeated items count once, and of items with
    one id the best match counts. Whole texts are read, whatever their length. The index goes to every task, so a
    benchmark of over most_words words (about 100 bytes each) is dealt by a hash over several passes; neither that nor
    the size of a block changes an item or a score. Scores within 1e-9 of the threshold count.
    """
    items = benchmark.where(F.col(item_text).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    items = items.where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).distinct()
    n_words = F.size(F.split(F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " ")), " "))
    n, total, longest = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(n_words), F.lit(0)), F.coalesce(F.max(n_words), F.lit(0))).first()
    passes = -(-2 * total // most_words) if total > most_words else 1
    kept, out, made = docs.columns if keep is None else keep, docs, []
    names = [f.split()[0] for f in FIELDS.split(", ")]
    items = items.withColumn("deal", F.pmod(F.xxhash64("id", "text"), F.lit(passes)))
    terms = items.select("deal", "text").mapInArrow(term_batches, "deal long, term long")
    terms = shared.cut(terms) if passes > 1 else terms
    frequency = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    frequency = shared.cut(frequency) if passes > 1 else frequency
    for k in range(passes):
        texts = sorted((r["id"], r["text"]) for r in items.where(F.col("deal") == k).select("id", "text").collect())  # about most_words words at most
        own = frequency if passes == 1 else frequency.join(terms.where(F.col("deal") == k).select("term").distinct(), "term")
        known = own.toPandas()
        hashes = known.term.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        stride = max(32, longest)
        index = docs.sparkSession.sparkContext.broadcast((build_index(texts, (hashes[order], known.df.to_numpy(np.int64)[order]), n, total / max(n, 1), block), stride))

        def kernel(data, offsets, index=index):
            own, stride = index.value
            words, first = term_hashes(data, offsets)
            found: dict[tuple[int, int], tuple] = {}
            for row, at, item, score in retrieve(words, first, own, stride, threshold) if len(own.term) else []:
                passage = words[at : min(at + 2 * stride, first[row + 1])]
                q, a = (overlap(x[item], passage, shingle) for x in (own.question, own.answer))
                ident = own.item_ids[item]
                if min(q, a) >= least_overlap and (score, q, a) > found.get((row, ident), (0.0,)):
                    found[row, ident] = (score, q, a)
            keys = sorted(found)
            start = np.searchsorted([r for r, _ in keys], np.arange(len(offsets)))
            values = [[i for _, i in keys], *([found[x][c] for x in keys] for c in range(3))]
            return tuple(shared.lists(np.array(v, np.int64 if c == 0 else np.float64), start) for c, v in enumerate(values))

        fields = ", ".join(f"__{k}_{f}" for f in FIELDS.split(", "))
        out = shared.append(out, text_col, kernel, fields, [*(kept if k == passes - 1 else docs.columns), *made])
        made += [f"__{k}_{x}" for x in names]
    if clash := {c.lower() for c in kept} & set(names):
        raise ValueError(f"columns already there: {sorted(clash)}")
    if passes == 1:
        return out.select(*[out[c] for c in kept], *[F.col(f"__0_{x}").alias(x) for x in names])
    # An id may have items in several passes: the best match of each counts.
    every = F.flatten(F.array(*[F.arrays_zip(*[F.col(f"__{k}_{x}").alias(x) for x in names]) for k in range(passes)]))
    best = F.transform(F.array_sort(F.array_distinct(F.transform(every, lambda h: h["items"]))), lambda i: F.array_max(F.transform(F.filter(every, lambda h: h["items"] == i), lambda h: F.struct(*[h[x].alias(x) for x in [*names[1:], names[0]]]))))
    return out.select(*[out[c] for c in kept], best.alias("__best")).select(*kept, *[F.col(f"__best.{x}").alias(x) for x in names])


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows in which find() finds an item; no shuffle takes place."""
    return find(docs, benchmark, **options).where(F.size("items") == 0).select(*docs.columns)
