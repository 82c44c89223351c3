"""Source divergence audit: how far each source's use of a language's terms is from the other sources' and from the language's.

The terms that count are those in enough documents of their language. They are found by iceberg refinement of byte prefixes:
level by level the first 4, 8, 16, ... bytes of the terms are taken, and the distinct documents that hold each prefix are
counted. A term is in no more documents than any of its prefixes, so what starts with a prefix under the threshold is never
looked at again; a term that ends within a level is complete there. It ends when no prefix is left that goes on. Only the
complete terms that are left are counted by source.

A level is one pass over the texts and one grouped sum by a hash of the prefix. The prefixes that stay reach the next pass
as a filter of a fixed number of bits: a prefix that it lets through by mistake is counted like any other, and the last
step counts whole terms as text, so the filter's size and the hashes change the work and never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.llm import counting as C
from cellweave.llm import kernels as K
from cellweave.llm import shared

#: Bytes of a term: ASCII letters and all bytes of other characters.
IN_TERM = np.arange(256) >= 128
IN_TERM[97:123] = True
FIRST_LEVEL = 4
TERMS_A_SLICE, SOURCES_A_BLOCK = 4096, 256


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, and the start, end and row of each term."""
    data = K.LOWER[data]
    starts, ends, first = K.spans(data, offsets, IN_TERM[data])
    return data, starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def _hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray, level: int) -> np.ndarray:
    """Hash of language and the first `level` bytes; its last bit tells that the term ends there."""
    whole = ends - starts <= level
    h = K.mix(K.hash_between(prefix, starts, np.where(whole, ends, starts + level)) ^ lang)
    return h & ~np.uint64(1) | whole.astype(np.uint64)


def _documents(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the number of distinct rows of each; rows rise."""
    order = np.argsort(h)
    h, row = h[order], row[order]
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h))))
    pair = group * (int(row.max()) + 1 if len(row) else 1) + row
    pair.sort()
    new = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
    return h[begin], np.add.reduceat(new.astype(np.int64), begin) if len(begin) else begin


def _level(level: int, before: int, open_prefixes):
    """mapInArrow function from (lang, text) to (h, n): documents of each prefix of `level` bytes, among the terms that
    are longer than `before` bytes and whose prefix of that length is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = C.Tally()
        for batch in batches:
            langs = C.of_values(batch.column(0), "")[0]
            for lo, _, data, offsets in K.text_slices(batch.column(1), C.SLICE_BYTES):
                data, starts, ends, row = _terms(data, offsets)
                prefix, lang = K.rolling(K.BYTE_MIX[data]), langs[lo + row]
                if before:
                    at = np.flatnonzero(ends - starts > before)
                    at = at[open_prefixes.value.has(_hashes(prefix, starts[at], ends[at], lang[at], before))]
                    starts, ends, lang, row = starts[at], ends[at], lang[at], row[at]
                yield from tally.add(*_documents(_hashes(prefix, starts, ends, lang, level), row))
        yield from tally.rest()

    return run


class Terms:
    """Counts by (language, term, source) within a task; rest() gives them, one row for each language and term.

    Terms are told apart by two hashes with the language in both. At most about `most` counts are held.
    """

    def __init__(self, most: int = 1 << 20):
        self.most, self.sources, self.held = most, {}, 0
        self.parts: list = []
        self.rows: list[pa.RecordBatch] = []

    def add(self, h: np.ndarray, other: np.ndarray, source: np.ndarray, n: np.ndarray, docs: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Counts by distinct (h, other, source); rows has (lang, term) of each."""
        self.parts.append((h, other, source, n, docs))
        self.rows.append(rows)
        self.held += len(h)
        if self.held - len(self.parts[0][0]) > self.most // 4:
            self._merge()
            if self.held > self.most * 3 // 4:
                yield from self.rest()

    def _merge(self) -> None:
        h, other, source, n, docs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(K.mix(h ^ source.astype(np.uint64) * K.MULTIPLIER))
        differs = np.zeros(len(order) - 1, bool)
        for x in (h, other, source):
            differs |= x[order][1:] != x[order][:-1]
        begin = np.flatnonzero(np.append(True, differs))
        head = order[begin]
        self.parts = [(h[head], other[head], source[head], np.add.reduceat(n[order], begin), np.add.reduceat(docs[order], begin))]
        self.rows = pa.Table.from_batches(self.rows).combine_chunks().take(pa.array(head)).combine_chunks().to_batches()
        self.held = len(head)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            order = np.lexsort((self.parts[0][1], self.parts[0][0]))
            h, other, source, n, docs = (x[order] for x in self.parts[0])
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (other[1:] != other[:-1])))
            names = pa.array(list(self.sources), pa.string())
            for at in range(0, len(first), 1 << 13):
                lo = first[at : at + (1 << 13)]
                hi = int(first[at + (1 << 13)]) if at + (1 << 13) < len(first) else len(h)
                offsets = pa.array(np.append(lo, hi).astype(np.int32) - np.int32(lo[0]))
                own = self.rows[0].take(pa.array(order[lo]))
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (names.take(pa.array(source[lo[0] : hi])), pa.array(n[lo[0] : hi]), pa.array(docs[lo[0] : hi]))]
                yield pa.record_batch([*own.columns, *lists], ["lang", "term", "sources", "n", "docs"])
        self.parts, self.rows, self.held = [], [], 0


def _numbers(values: list[str], known: dict[str, int]) -> np.ndarray:
    """A number for each value, new ones in order."""
    return np.array([known.setdefault(v, len(known)) for v in values], np.int64)


def _counted(complete, level: int):
    """mapInArrow function from (lang, source, text) to (lang, term, sources, n, docs) of the terms that may be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            langs, lang_of, lang_names = C.of_values(batch.column(0), "")
            _, source_of, source_names = C.of_values(batch.column(1), "")
            source_of = _numbers(source_names, terms.sources)[source_of] if len(source_names) else source_of
            for lo, _, data, offsets in K.text_slices(batch.column(2), C.SLICE_BYTES):
                data, starts, ends, row = _terms(data, offsets)
                prefix = K.rolling(K.BYTE_MIX[data])
                at = np.flatnonzero(ends - starts <= level)
                h = _hashes(prefix, starts[at], ends[at], langs[lo + row[at]], level)
                left = complete.value.has(h)
                at, h = at[left], h[left]
                if not len(at):
                    continue
                starts, ends, row = starts[at], ends[at], row[at]
                source = source_of[lo + row]
                check = K.mix(K.hash_spans(data, starts, ends, C.OTHER_MIX) ^ langs[lo + row])
                key = K.mix(h ^ source.astype(np.uint64) * K.MULTIPLIER)
                order = np.argsort(key, kind="stable")  # rows rise within equal keys
                differs = lambda x, o=order: x[o][1:] != x[o][:-1]
                new = np.append(True, differs(key) | differs(check) | differs(source))
                begin = np.flatnonzero(new)
                n = np.diff(np.append(begin, len(order)))
                docs = np.add.reduceat((new | np.append(True, differs(row))).astype(np.int64), begin)
                head = order[begin]
                lang = pa.DictionaryArray.from_arrays(pa.array(lang_of[lo + row[head]].astype(np.int32)), pa.array(lang_names, pa.string())).cast(pa.string())
                rows = pa.record_batch([lang, C.strings(data, starts[head], ends[head])], ["lang", "term"])
                yield from terms.add(h[head], check[head], source[head], n.astype(np.int64), docs, rows)
        yield from terms.rest()

    return run


def _by_source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function that adds up the rows of _counted() by (lang, source, term), as far as a task meets them."""
    held, size = [], 0

    def out():
        table = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return table.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])

    for batch in batches:
        of = batch.column(2)
        row = pc.list_parent_indices(of)
        names = [batch.column(0).take(row), pc.list_flatten(of), batch.column(1).take(row), pc.list_flatten(batch.column(3)), pc.list_flatten(batch.column(4))]
        held.append(pa.table(names, ["lang", "source", "term", "n", "docs"]))
        size += len(row)
        if size > 1 << 20:
            held = [out()]
            size = held[0].num_rows
            if size > 1 << 19:
                yield from held[0].to_batches(1 << 16)
                held, size = [], 0
    if held:
        yield from out().to_batches(1 << 16)


def kept_counts(docs: DataFrame, least_docs: int = 30, filter_bits: int = 26, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n): occurrences, over 0, of each term that is in at least least_docs documents of its language.

    A document is a row, repeated or not. Nulls in any of the three columns count as ''; other columns are not read.
    """
    named = lambda c, name: F.col(c).cast("string").alias(name)
    rows = docs.select(named(lang_col, "lang"), named(source_col, "source"), named(text_col, "text"))
    context = docs.sparkSession.sparkContext
    complete, left, before, level = C.Filter(filter_bits), None, 0, FIRST_LEVEL
    while True:
        found = rows.select("lang", "text").mapInArrow(_level(level, before, left), C.HASHED)
        stay = shared.cut(found.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).select("h"))
        ends = F.col("h").bitwiseAND(F.lit(1)) == 1
        complete = complete.union(C.Filter.of(stay.where(ends), filter_bits))
        going_on = C.Filter.of(stay.where(~ends), filter_bits)
        shared.drop(stay)
        if not going_on.words.any():
            break
        left, before, level = context.broadcast(going_on), level, 2 * level
    given = context.broadcast(complete)
    counts = rows.mapInArrow(_counted(given, level), "lang string, term string, sources array<string>, n array<long>, docs array<long>")
    counts = counts.repartition("lang", "term").mapInArrow(_by_source, "lang string, source string, term string, n long, docs long")
    counts = shared.cut(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term")
    return shared.cut(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))


def _share(n, total, kept):
    """1 + floor(10^9 (n + 5) / (total + 5 kept)), in decimal integers, as a long; null if nothing is kept."""
    wide = lambda x: x.cast("decimal(20,0)")
    return 1 + F.call_function("div", wide(F.lit(1_000_000_000)) * wide(n + 5), F.nullif((total + 5 * kept).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")))


def _gaps(key, rows, groups):
    """Of one pair of blocks of sources and one slice of terms: for each two sources the sum of |p - q| over these terms,
    less what it would be if neither had any of them."""
    import pandas as pd

    lang, one, other, _ = key
    terms, at = np.unique(rows["term"].to_numpy(), return_inverse=True)
    base = groups["base"].to_numpy(np.int64)
    place = pd.Series(np.arange(len(groups)), index=pd.MultiIndex.from_arrays([groups["source"]]))
    shares = np.repeat(base[:, None], len(terms), axis=1)
    if len(terms):
        shares[place.reindex(pd.MultiIndex.from_arrays([rows["source"]])).to_numpy(), at] = rows["p"].to_numpy(np.int64)
    block, names = groups["block"].to_numpy(), groups["source"].to_numpy()
    left, right = np.flatnonzero(block == one), np.flatnonzero(block == other)
    out = []
    for i in left:
        gap = np.abs(shares[right] - shares[i]).sum(1) - len(terms) * np.abs(base[right] - base[i])
        pairs = pd.DataFrame({"source": names[i], "item": names[right], "value": gap})[right != i]
        out += [pairs] if one == other else [pairs, pairs.rename(columns={"source": "item", "item": "source"})]
    return pd.concat(out, ignore_index=True).assign(lang=lang)[["lang", "source", "item", "value"]] if out else pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, filter_bits: int = 26, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value long, rank int) for every (lang, source) that occurs.

    A source's share of a kept term is p = 1 + floor(10^9 (n + 5) / (N + 5 V)), with n its occurrences there, N their sum over
    the V kept terms of the language; q is the same over the whole language. Part `pair`: item is each other source of the
    language, value the sum of |p - p'| over all kept terms, 0 if there are none. Part `term`: item is a term that the
    source has and uses more than the language does (p > q), value p - q, the `top` largest. Ranks go by value descending,
    then item in byte order. A source without terms takes part in pairs; an empty table gives no rows. Ties, repeated rows,
    nulls ('' in all three columns) and other columns (not read) change nothing else.

    Pairs of sources are compared by slices of terms and, where a language has many sources, by pairs of blocks of sources,
    so a task holds at most two blocks and one slice; the number of pairs is the size of the result.
    """
    counts = kept_counts(docs, least_docs, filter_bits, lang_col, source_col, text_col)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_lang").alias("total_lang"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "total_lang"])
    blocks = F.ceil(F.count(F.lit(1)).over(W.partitionBy("lang")) / F.lit(SOURCES_A_BLOCK))
    groups = groups.withColumn("base", F.coalesce(_share(F.lit(0).cast("long"), F.col("total"), F.col("kept")), F.lit(0).cast("long"))).withColumn("blocks", blocks)
    groups = shared.cut(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))))

    shares = counts.join(groups.select("lang", "source", "total", "kept", "total_lang", "blocks", "block"), ["lang", "source"])
    shares = shares.withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept")))
    used = shares.join(terms, ["lang", "term"]).withColumn("q", _share(F.col("n_lang"), F.col("total_lang"), F.col("kept"))).where("p > q")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    used = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    used = used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    slices = F.ceil(F.greatest("kept", F.lit(1)) / F.lit(TERMS_A_SLICE))
    meets = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    rows = meets(shares.withColumn("slice", F.pmod(F.xxhash64("term"), slices))).select("lang", "one", "two", "slice", "source", "term", "p")
    sides = meets(groups.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))).select("lang", "one", "two", "slice", "source", "base", "block")
    key = ("lang", "one", "two", "slice")
    gaps = rows.groupBy(*key).cogroup(sides.groupBy(*key)).applyInPandas(_gaps, "lang string, source string, item string, value long")
    ends = [groups.select("lang", F.col("source").alias(c), F.col("base").alias(f"base_{c}"), *more) for c, more in (("source", ["kept"]), ("item", []))]
    pairs = gaps.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).join(ends[0], ["lang", "source"]).join(ends[1], ["lang", "item"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + F.col("kept") * F.abs(F.col("base_source") - F.col("base_item"))).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(used)
