"""Source divergence, collocations and vector near-dedup against brute force, and their defined results at the edges."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave.llm import collocations, counting, divergence, vector_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, n):
    """Documents with shared words, long common stems, other scripts, nulls, repeated rows and ties."""
    rng = random.Random(seed)
    words = [f"{stem}{end}" for stem in ("Prefixprefixprefix", "word", "größe", "語彙語彙語彙語彙", "a") for end in ("", "s", "sx", "ß", "彙", "longerlongerlongerlonger")] + list("bcd")
    out = [(0, None, "en", "x", 1), (1, "", "en", "y", 1), (2, "word word", None, None, 1), (3, "12 34 -- ??", "zz", "only", 1), (4, "word", "", "", 1)]
    for k in range(5, n):
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", "1"]) for w in rng.choices(words, k=rng.randint(0, 12)))
        out.append((k, text, rng.choice(["en", "en", "de", None]), rng.choice(["x", "x", "y", "z", None]), 1))
    return out + out[-3:]


def divergences(docs, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    rows = [(lang or "", source or "", term.findall(lowered(text))) for _, text, lang, source, _ in docs]
    langs, out = defaultdict(set), []
    for lang, source, _ in rows:
        langs[lang].add(source)
    for lang, sources in langs.items():
        held = Counter(t for own, _, ts in rows if own == lang for t in set(ts))
        kept = {t for t, k in held.items() if k >= least}
        n = {s: Counter(t for own, src, ts in rows if (own, src) == (lang, s) for t in ts if t in kept) for s in sources}
        n[None] = sum(n.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in n.items()}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-(p[s][t] - p[None][t]), t.encode()) for t in kept if n[s][t] and p[s][t] > p[None][t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize("least,bits", [(3, 26), (30, 8), (100_000, 12)])
def test_divergence_equals_brute_force(spark, least, bits):
    docs = prose(1, 400)
    frame = spark.createDataFrame(docs, DOCS).withColumnRenamed("n_chars", "term")  # a column of a name used inside
    got = divergence.audit(frame, least_docs=least, top=7, filter_bits=bits)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == divergences(docs, least, 7)


def test_divergence_in_blocks_of_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES_A_BLOCK", 2)
    monkeypatch.setattr(divergence, "TERMS_A_SLICE", 5)
    rng = random.Random(3)
    docs = [(k, t, "en", f"s{rng.randrange(7)}", n) for k, t, _, _, n in prose(2, 300)]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(docs, DOCS), least_docs=2, top=3).collect())) == divergences(docs, 2, 3)


def test_divergence_of_nothing_and_of_very_long_texts(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    docs = [(k, "x" * 70_000 + "yz"[k % 2] * 3 + " long " * 50_000, "en", "ab"[k % 2], 1) for k in range(4)]
    got = divergence.audit(spark.createDataFrame(docs, DOCS), least_docs=2)
    assert sorted(map(tuple, got.collect())) == divergences(docs, 2, 50)


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_a_task_gives_each_term_once(monkeypatch, most):
    """One row a language and term with the counts of all its sources, however many slices the texts take."""
    monkeypatch.setattr(counting, "SLICE_BYTES", 60)
    monkeypatch.setattr(divergence.Terms.__init__, "__defaults__", (most,))
    rng = random.Random(7)
    rows = [(rng.choice(["en", "de", None]), rng.choice("xyz"), " ".join(rng.choices("ab bc c Ab größe".split(), k=rng.randint(0, 9)))) for _ in range(200)]
    batches = [pa.record_batch([pa.array(x, pa.string()) for x in zip(*part, strict=True)], ["lang", "source", "text"]) for part in (rows[:90], rows[90:])]
    everything = type("", (), {"value": type("", (), {"has": staticmethod(lambda h: np.ones(len(h), bool))})})
    out = list(divergence._counted(everything, 64)(iter(batches)))
    want, docs = Counter(), Counter()
    for lang, source, text in rows:
        want.update((lang or "", source, w) for w in lowered(text).split())
        docs.update((lang or "", source, w) for w in set(lowered(text).split()))
    n, d = Counter(), Counter()
    for r in (r for b in divergence._by_source(iter(out)) for r in b.to_pylist()):
        n[r["lang"], r["source"], r["term"]] += r["n"]
        d[r["lang"], r["source"], r["term"]] += r["docs"]
    assert n == want and d == docs
    assert most == 50 or sum(b.num_rows for b in out) == len({(lang, w) for lang, _, w in want})


def collocated(docs, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, _, _ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 6):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, all_counts in counts.items():
        f = {p: k for p, k in all_counts.items() if k >= least}
        rows = []
        for p, a in f.items():
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if len(p) < 2 or any(len(q) > len(p) and k >= a and inside(q) for q, k in f.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,bits", [(2, 26), (20, 8), (100_000, 12)])
def test_collocations_equal_brute_force(spark, least, bits):
    docs = prose(4, 300)
    got = collocations.mine(spark.createDataFrame(docs, DOCS).withColumnRenamed("n_chars", "phrase"), least=least, top=40, filter_bits=bits)
    got = got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert {t for _, t in got.dtypes[3:]} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == collocated(docs, least, 40)


def test_collocations_of_nothing_and_of_one_very_long_text(spark):
    assert collocations.mine(spark.createDataFrame([], DOCS)).count() == 0
    docs = [(1, "In the very same place " * 30_000 + "end", "en", None, 1), (2, None, None, None, 1)]
    got = collocations.mine(spark.createDataFrame(docs, DOCS)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == collocated(docs, 100, 2000) != []


class Everything:
    value = [type("", (), {"has": staticmethod(lambda h: np.ones(len(h), bool))})] * collocations.LONGEST


@pytest.mark.parametrize("most", [1 << 19, 40])
def test_a_task_gives_each_phrase_once(monkeypatch, most):
    """However many slices its texts take; with room for few phrases, partial sums that add up."""
    monkeypatch.setattr(counting, "SLICE_BYTES", 60)
    monkeypatch.setattr(collocations.Phrases.__init__, "__defaults__", (most,))
    rng = random.Random(6)
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choices("ab bc c Ab größe".split(), k=rng.randint(0, 9)))) for _ in range(200)]
    batches = [pa.record_batch([pa.array(x, pa.string()) for x in zip(*part, strict=True)], ["lang", "text"]) for part in (rows[:90], rows[90:])]
    got = [(r["lang"], r["phrase"], r["size"], r["f"]) for b in collocations._exact(Everything)(iter(batches)) for r in b.to_pylist() if r["size"]]
    want = Counter()
    for lang, text in rows:
        w = lowered(text).split()
        want.update((lang or "und", " ".join(w[i : i + n]), n) for n in range(1, 6) for i in range(len(w) - n + 1))
    sums = Counter()
    for lang, phrase, size, f in got:
        sums[lang, phrase, size] += f
    assert sums == want
    assert most == 40 or len(got) == len(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6)), max_size=30), max_size=6), st.integers(1, 8), st.integers(1, 12))
def test_summaries_keep_every_frequent_key(batches, capacity, threshold):
    """However the stream is cut, and even where the capacity is too small for its mass."""
    summary, truth = collocations.MisraGries(capacity, threshold), Counter()
    for batch in batches:
        for k, n in batch:
            truth[k] += n
        summary.merge(np.array([k for k, _ in batch], np.uint64), np.array([n for _, n in batch], np.int64))
    assert {k for k, n in truth.items() if n >= threshold} <= set(summary.frequent().tolist())
    assert summary.off < threshold or not truth
    if capacity > sum(truth.values()) / threshold:
        assert summary.capacity == capacity


def test_filters_hold_their_members(spark):
    h = np.random.default_rng(1).integers(-(2**63), 2**63, 3000)
    some = counting.Filter.of(spark.createDataFrame([(int(x),) for x in h], "h long"), 16)
    assert some.has(h.view(np.uint64)).all()
    assert some.has(np.random.default_rng(2).integers(0, 2**63, 3000).astype(np.uint64)).mean() < 0.06


VECTORS = "vec_id long, embedding array<float>, label int, v string, node long"


def heaps(seed, n, width=16):
    """Vectors apart, a heap of near copies, chains of links, copies, copies of another length, and unusable ones."""
    rng = np.random.default_rng(seed)
    x = list(rng.normal(size=(n, width)))
    x += list(rng.normal(size=width) + 0.03 * rng.normal(size=(n // 2, width)))
    for _ in range(20):
        step = rng.normal(size=width)
        x += [x[0] + 0.12 * k * step for k in range(6)]
    x += [2.5 * x[5], x[5], x[5]]
    rows = [(k * 3 + 1, [float(np.float32(c)) for c in v], int(rng.integers(0, 2)), "a", 1) for k, v in enumerate(x)]
    last = rows[-1][1]
    odd = [(900_001, None, 0), (900_002, [], 0), (900_003, [0.0] * width, 0), (900_004, [float("nan"), *last[1:]], 0), (900_005, [float("inf"), *last[1:]], 0), (900_006, [None, *last[1:]], 0)]
    odd += [(900_007, last, None), (900_008, last[:-1], 0), (900_009, last[:-1], 0), (None, last, 0), (900_010, last, 1), (900_010, last, 1)]
    return rows + [(*r, "b", 2) for r in odd]


def linked(rows, least):
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) and label is not None and ident is not None for ident, v, label, *_ in rows]
    parts, edges = defaultdict(list), set()
    for k, (_, v, label, *_) in enumerate(rows):
        if ok[k]:
            parts[label, len(v)].append(k)
    for members in parts.values():
        x = np.array([rows[k][1] for k in members], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        i, j = np.nonzero(x @ x.T >= least)
        edges |= {(members[a], members[b]) for a, b in zip(i, j, strict=True) if a != b}
    root = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if root[b] < root[a]:
                root[a], changed = root[b], True
    n = Counter(a for a, _ in edges)
    return edges, sorted(((r[0], n[k], root[k], None if r[0] is None else root[k] == r[0]) for k, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("shard_rows", [8192, 150])
def test_vector_links_against_all_pairs(spark, shard_rows):
    """With small shards the vectors are parted by centres, with copies, and the heap is dealt into tiles."""
    rows = heaps(5, 500)
    edges, want = linked(rows, 0.98)
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), shard_rows=shard_rows, beam=32)
    assert got.dtypes[:4] == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    rows_got = got.collect()
    assert len(edges) > 20_000
    found = sum(r.n_links for r in rows_got)
    assert 0.98 * len(edges) <= found <= len(edges)
    assert len(rows_got) == len(rows)
    assert sorted(((r.vec_id, r.component_id, r.kept) for r in rows_got), key=repr) == sorted(((a, c, d) for a, _, c, d in want), key=repr)
    audited = [(r.audited_found, r.audited_links) for r in rows_got if r.audited_links]
    assert audited and sum(a for a, _ in audited) >= 0.97 * sum(b for _, b in audited)


def test_vectors_of_the_smallest_tables(spark):
    empty = vector_dedup.near_duplicates(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0
    one = vector_dedup.near_duplicates(spark.createDataFrame([(7, [1.0, 2.0], 1, "", 0)], VECTORS)).select("vec_id", "n_links", "component_id", "kept")
    assert list(map(tuple, one.collect())) == [(7, 0, 7, True)]
    tiny = [(k, [1e-40 * (1 + k), 1e-40], 1, "", 0) for k in range(2)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(tiny, VECTORS), least=0.9).collect()
    assert sorted((r.vec_id, r.n_links) for r in got) == [(0, 1), (1, 1)]
    with pytest.raises(ValueError):
        vector_dedup.near_duplicates(spark.createDataFrame([], VECTORS), least=1.5)


def test_pruning_keeps_the_nearest_and_what_it_does_not_shadow():
    x = np.array([[1, 0], [0.99, 0.14], [0.98, 0.2], [0, 1], [-1, 0]], np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    kept = vector_dedup.pruned(x, x[:1], np.array([[4, 2, 1, 3, -1]], np.int32), 3)[0].tolist()
    assert kept[0] == 1 and 2 not in kept and 3 in kept


def test_phrases_are_counted_exactly_in_few_tasks(spark, monkeypatch):
    """Each task gives all phrases it holds, so their rows must not grow with the number of input partitions."""
    tasks, plain = spark.sparkContext.accumulator(0), collocations._exact

    def counted(filters):
        run = plain(filters)

        def out(batches):
            tasks.add(1)
            yield from run(batches)

        return out

    monkeypatch.setattr(collocations, "_exact", counted)
    most = 2 * spark.sparkContext.defaultParallelism
    docs = [(k, "in the very same place", "en", None, 1) for k in range(8 * most)]
    got = collocations.frequent_phrases(spark.createDataFrame(docs, DOCS).repartition(4 * most), least=5)
    assert {r.f for r in got.where("size between 1 and 5").collect()} == {8 * most} and tasks.value <= most
