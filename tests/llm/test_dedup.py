"""SimHash near-dedup and line dedup against brute force, and their defined results at the edges."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave.llm import kernels, line_dedup, shared, simhash_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, seed=42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def groups(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 7))) for _ in range(300)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, words * 6))))
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = [*corpus(1, 250), "", None, "One", "one", "Zwölf Boxkämpfer jagen  Viktor\tquer", "zwölf boxkämpfer jagen viktor quer"]
    ids = random.Random(2).sample(range(10_000), len(texts))
    rows = sorted(zip(ids, texts, strict=True))
    prints = [fingerprint(t) for _, t in rows]
    root = groups(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(root)) < len(rows) - 30
    for k, (ident, _) in enumerate(rows):
        assert got[ident].fp % 2**64 == prints[k]
        assert got[ident].component_id == rows[root[k]][0]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_close_fingerprints_share_an_anchor(x, flips):
    import pyarrow as pa

    y = x
    for b in flips:
        y ^= 1 << b
    batch = pa.record_batch([pa.array(np.array([x, y], np.uint64).view(np.int64)), pa.array([0, 1])], ["fp", "id"])
    (out,) = list(simhash_dedup.anchor_batches([batch]))
    key, ident = out.column(0).to_numpy(), out.column(2).to_numpy()
    assert set(key[ident == 0]) & set(key[ident == 1])


def test_near_duplicates_at_the_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash_dedup.near_duplicates(empty).count() == 0
    assert simhash_dedup.keep_first(empty).count() == 0
    rows = [(3, "", None, None, None), (2, None, None, None, None), (None, "a b c d e", None, None, None), (7, "a b c d e", None, None, None), (7, "a b c d e", None, None, None), (None, "else", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("source", "component_id")
    got = sorted(((r.doc_id, r.component_id, r.copies) for r in simhash_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 2, 2), (2, 2, 2), (None, 7, 3), (7, 7, 3), (7, 7, 3), (None, None, 1)], key=str)
    assert sorted(str(r.doc_id) for r in simhash_dedup.keep_first(docs).collect()) == ["2", "7", "7", "None", "None"]
    with pytest.raises(ValueError):
        simhash_dedup.near_duplicates(docs, max_bits=5)


def test_very_long_text(spark):
    text = " ".join(corpus(5, 1, 60)) + " x" * 300_000
    got = simhash_dedup.near_duplicates(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")).where("doc_id = 1").first()
    assert got.fp % 2**64 == fingerprint(text)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(300)]
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    linked = {(max(at[a], at[b]), min(at[a], at[b])) for a, b in edges}
    root = groups(len(nodes), lambda i, j: (i, j) in linked)
    expected = {x: nodes[root[i]] for x, i in at.items()}
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    single = {x for x in nodes if x not in got}
    assert got == {x: c for x, c in expected.items() if x in got} and all(expected[x] == x for x in single)
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bucket_links_in_every_size_of_group(spark):
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2**62, 4)
    fp = np.array([int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centre for a, b in rng.integers(0, 60, (150, 2))])
    rows = [(int(k), int(f), int(i)) for i, (k, f) in enumerate(zip(rng.choice([1, 2], len(fp), p=[0.95, 0.05]), fp, strict=True))]
    keyed = spark.createDataFrame(rows, "key long, fp long, id long")
    root = groups(len(rows), lambda i, j: rows[i][0] == rows[j][0] and (rows[i][1] ^ rows[j][1]).bit_count() <= 3)
    for small, large in ((4, 10_000), (1000, 10_000), (4, 60)):
        links = [(r.a, r.b) for r in shared.linked_in_buckets(keyed, 3, small, large).distinct().collect()]
        assert groups(len(rows), lambda i, j, s=set(links): (j, i) in s) == root


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=40), st.text("abcé ", max_size=40))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert line_dedup.edit_distance(a, b) == row[-1]


def line_fingerprint(line):
    data = np.frombuffer(line.encode(), np.uint8)
    starts, ends, _ = kernels.words(data, np.array([0, len(data)]))
    h = set(kernels.hash_spans(data, starts, ends, kernels.BYTE_MIX_LOWER).tolist())
    return sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h))


def deduped(rows):
    """Plain Python version of dedup_lines for rows (id, text) with distinct ids."""
    rows = sorted(rows)
    lines = [(k, n, " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), line).split())) for k, (_, t) in enumerate(rows) for n, line in enumerate(t.split("\n"))]
    first = {}
    for k, n, line in lines:
        if len(line.split()) >= 5:
            first.setdefault(line, (k, n))
    distinct = list(first)
    prints = [line_fingerprint(x) for x in distinct]
    root = groups(len(distinct), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3 and line_dedup.similar(distinct[i], distinct[j], 0.8))
    keep = {first[distinct[r]] for r in root} | {(k, n) for k, n, x in lines if x not in first}
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) in keep) for k, (i, t) in enumerate(rows)}


def deduped_by_edits(rows, least=0.8):
    """Plain version of dedup_lines with grams for rows (id, text) with distinct ids: every line with a word exactly, lines
    of 16 characters by edit similarity to any other."""
    rows = sorted(rows)
    lines = [(k, n, " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), line).split())) for k, (_, t) in enumerate(rows) for n, line in enumerate(t.split("\n"))]
    first = {}
    for k, n, line in lines:
        if line:
            first.setdefault(line, (k, n))
    distinct = list(first)
    counts = np.array([np.bincount(np.frombuffer(x.encode("utf-16-le"), np.uint16) % 64, minlength=64) for x in distinct])
    sizes = np.array([len(x) for x in distinct])
    linked = set()
    for i in range(len(distinct)):
        j = np.arange(i)
        most = (1 - least) * np.maximum(sizes[j], sizes[i])
        far = np.maximum(np.maximum(counts[j] - counts[i], 0).sum(1), np.maximum(counts[i] - counts[j], 0).sum(1))  # a lower bound
        near = j[(far <= most) & (np.minimum(sizes[j], sizes[i]) >= 16)]
        linked |= {(i, k) for k in near.tolist() if line_dedup.similar(distinct[i], distinct[k], least, 0.2)}
    root = groups(len(distinct), lambda i, j: (i, j) in linked)
    keep = {first[distinct[r]] for r in root} | {(k, n) for k, n, x in lines if not x}
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) in keep) for k, (i, t) in enumerate(rows)}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    lines = corpus(6, 60, 8) + ["", "short one", "All Rights  Reserved by the owner", "all rights reserved by the owner"]
    base = " ".join(f"word{i}" for i in range(120))
    family = [base.replace(f"word{i} ", f"other{i} ") for i in range(40)]  # many lines in one bucket
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 8)) + rng.choices(family, k=rng.randint(0, 2)))) for i in range(120)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = deduped(rows)
    assert {i: r.text for i, r in got.items()} == expected
    assert sum(r.n_removed_lines for r in got.values()) > 300


def test_line_dedup_at_the_edges(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    line = "a line of five words"
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (4, line, None, None, None), (4, line, None, None, None), (None, line, None, None, None), (9, f"{line}\nx", None, None, None)]
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "id")).collect()]
    expected = [(1, None, 0, 0), (2, "", 1, 0), (4, "", 1, 1), (4, "", 1, 1), (None, line, 1, 0), (9, "x", 2, 1)]
    assert sorted(got, key=str) == sorted(expected, key=str)
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "n_lines"))


def test_line_dedup_by_grams_finds_what_edit_similarity_alone_finds(spark):
    """Recall against all pairs, whatever their fingerprints: one or two words of a line of 8-30 words are replaced."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(2000)]
    lines = [" ".join(rng.choices(vocabulary, k=rng.randint(8, 30))) for _ in range(250)]
    for base in lines[:250]:
        w = base.split(" ")
        for _ in range(rng.choice([1, 1, 2]) if len(w) > 14 else 1):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        lines.append(" ".join(w))
    lines = list(dict.fromkeys(lines))
    root = groups(len(lines), lambda i, j: line_dedup.similar(lines[i], lines[j], 0.8))
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(rows, grams=True).where("n_removed_lines = 1").collect()}
    expected = {i for i, r in enumerate(root) if r != i}
    assert len(expected) > 200 and gone <= expected
    assert len(gone) >= 0.95 * len(expected)
    by_words = line_dedup.dedup_lines(rows).where("n_removed_lines = 1").count()
    assert by_words < 0.5 * len(expected)


def test_line_dedup_by_grams_in_large_groups(spark):
    base = " ".join(f"word{i}" for i in range(60))
    family = [base.replace(f"word{i} ", f"other{i} ") for i in range(58)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(family * 2)], "doc_id long, text string")
    assert line_dedup.dedup_lines(rows, grams=True).where("n_removed_lines = 0").count() == 1


def test_line_dedup_by_grams_takes_short_lines_and_lines_without_spaces(spark):
    chinese = "版权所有未经许可不得以任何方式复制或转载本网站的全部或部分内容"
    rows = [(1, "All rights reserved.\nx\n\n"), (2, f"all  rights reserved.\ny\n\n{chinese}"), (3, f"x\n{chinese}"), (4, chinese.replace("全部", "所有"))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), grams=True).collect()}
    assert got == {1: "All rights reserved.\nx\n\n", 2: f"y\n\n{chinese}", 3: "", 4: ""}


def plain_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def test_recall_of_line_dedup_over_the_given_documents(spark):
    """All pairs of lines of 300 documents with edit similarity 0.8, found by plain comparison: at least 0.9 are joined."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(300)
    lines = sorted({" ".join(re.sub("[A-Z]", lambda m: m[0].lower(), x).split()) for r in docs.collect() for x in (r.text or "").split("\n")}, key=len)
    lines = [x for x in lines if 16 <= len(x) <= 300]
    counts = np.array([np.bincount(np.frombuffer(x.encode("utf-16-le"), np.uint16) % 64, minlength=64) for x in lines])
    sizes = np.array([len(x) for x in lines])
    pairs = []
    for i in range(len(lines)):  # letters that differ bound the edit distance from below
        j = np.arange(i + 1, len(lines))
        j = j[np.maximum(counts[j] - counts[i], 0).sum(1) <= 0.2 * sizes[j]]
        words = set(lines[i].split())
        pairs += [(i, k) for k in j.tolist() if len(words & set(lines[k].split())) >= 0.3 * len(words) and plain_similarity(lines[i], lines[k]) >= 0.8]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(rows, grams=True).where("n_removed_lines = 1").collect()}
    root = groups(len(lines), lambda i, j, s=set(pairs): (j, i) in s)
    joined = sum(i in gone or k in gone for i, k in pairs)
    assert len(pairs) >= 20 and joined >= 0.9 * len(pairs)
    assert gone <= {i for i, r in enumerate(root) if r != i}  # nothing else goes


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab cd efg h ijkl mn".split()), max_size=14), st.lists(st.sampled_from("ab cd efg h ijkl mn".split()), max_size=14), st.floats(0.5, 0.95))
def test_similar_equals_plain_edit_similarity(a, b, least):
    a, b = " ".join(a), " ".join(b)
    if a or b:
        want = line_dedup.edit_distance(a, b) <= int((1 - least) * max(len(a), len(b)) + 1e-9)
        assert line_dedup.similar(a, b, least) == want


def test_rows_are_told_apart_by_their_files(spark, tmp_path):
    rows = [(k % 7, f"line {k % 5} of the text that is repeated\nown line number {k} {'abcdefghij'[k % 10] * 9}", None, None, k) for k in range(60)]
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    files = shared.numbered(read)
    assert files.select("_file", "_row").distinct().count() == 60 and files.select("_file").distinct().count() == 5
    by_file = sorted((r.n_chars, r.text) for r in line_dedup.dedup_lines(read, grams=True).collect())
    assert sum("that is repeated" in t for _, t in by_file) == 1 or sum(t.startswith("line") for _, t in by_file) <= 5
    long = spark.createDataFrame([(1, "word " * 60_000 + "\nsame line here\n" + "x" * 300_000), (2, "same  line here\n" + "x" * 300_000)], "doc_id long, text string")
    assert [(r.n_lines, r.n_removed_lines) for r in line_dedup.dedup_lines(long, grams=True).orderBy("doc_id").collect()] == [(3, 0), (2, 2)]
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(read.withColumnRenamed("lang", "_gone"))


def test_queries_deduplicate_lines_by_grams(spark, tmp_path):
    from cellweave.llm import queries

    rows = [(1, "all rights reserved.", None, None, 20), (2, "all rights reserved.", None, None, 20)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert sum(r.n_removed_lines for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()) == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("abc d\u00e9\u6f22", max_size=150), st.text("abc d\u00e9\u6f22", max_size=150)), min_size=1, max_size=60), st.floats(0.5, 0.95))
def test_similar_pairs_equal_single_ones(pairs, least):
    rng = random.Random(len(pairs))
    near = [(x, "".join(rng.choice("ab ") if rng.random() < 0.15 else c for c in x)) for x, _ in pairs]
    a, b = zip(*(pairs + near) * 3, strict=True)
    want = [line_dedup.edit_distance(x, y) <= int((1 - least) * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)]
    assert line_dedup.similar_pairs(list(a), list(b), least) == want


def test_line_dedup_by_grams_links_by_edit_distance_alone(spark):
    """Lines of edit similarity 0.8 that have few 5-grams in common: those that meet are linked, however few they are."""
    rng = random.Random(4)
    rows, pairs = [], []
    for k in range(300):
        a = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=80))
        b = "".join(rng.choice("0123456789") if i % 12 == 0 else c for i, c in enumerate(a))
        x, y = ({t[i : i + 5] for i in range(76)} for t in (a, b))
        assert plain_similarity(a, b) >= 0.8 and len(x & y) < 0.45 * len(x | y)
        rows += [(2 * k, a), (2 * k + 1, b)]
        pairs.append(2 * k + 1)
    gone = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), grams=True).where("n_removed_lines = 1").collect()}
    assert gone <= set(pairs) and len(gone) >= 0.25 * len(pairs)


def test_within_equals_edit_distance_on_long_lines():
    """Lines of one or many 64 rows, near and far, with common parts moved about, at the border of what is asked for."""
    rng = random.Random(8)
    a, b = [], []
    for size in [1, 3, 63, 64, 65, 127, 128, 129, 300, 511, 512, 513, 640, 900, 1400] * 6:
        x = "".join(rng.choices("abcdefgh é漢", k=size))
        y = "".join(rng.choice("ab c") * rng.randint(0, 2) if rng.random() < rng.choice([0.05, 0.15, 0.3]) else c for c in x) or "a"
        a += [x, x, x]
        b += [y, x[size // 3 :] + x[: size // 3], "".join(rng.choices("abcdefgh ", k=size))]
    true = [line_dedup.edit_distance(x, y) for x, y in zip(a, b, strict=True)]
    for more in (-1, 0, 1, 40):
        most = np.array([max(0, d + more) for d in true])
        assert line_dedup.within(a, b, most).tolist() == [d <= k for d, k in zip(true, most.tolist(), strict=True)]


def test_groups_are_compared_side_by_side(monkeypatch):
    """Links span the parts of each group, and the lines of all groups are compared in few calls."""
    calls, plain = [], line_dedup.similar_pairs
    monkeypatch.setattr(line_dedup, "similar_pairs", lambda a, b, least: calls.append(len(a)) or plain(a, b, least))
    rng = random.Random(9)
    rows, want = [], set()
    for key in range(60):
        kinds = ["".join(rng.choices("abcdefghij ", k=60)) for _ in range(4)]
        lines = [k[:i] + "#" * rng.randint(1, 3) + k[i + 2 :] for k in kinds for i in rng.sample(range(58), 5)]
        ids = rng.sample(range(key * 100, key * 100 + 100), len(lines))
        rows += [(key // 3, key, 0, i, line) for i, line in zip(ids, lines, strict=True)]
        root = groups(len(lines), lambda i, j, lines=lines: line_dedup.similar(lines[i], lines[j], 0.8))
        want |= {frozenset(ids[i] for i in range(len(ids)) if root[i] == r) for r in set(root)}
    batches = [pa.record_batch([pa.array(c) for c in zip(*part, strict=True)], ["near", "key", "fp", "id", "line"]) for part in (rows[:500], rows[500:])]
    links = [(r["a"], r["b"]) for batch in line_dedup._verify_groups(14, 0.8)(iter(batches)) for r in batch.to_pylist()]
    ids = [r[3] for r in rows]
    place = {i: k for k, i in enumerate(ids)}
    near = {(place[a], place[b]) for a, b in links} | {(place[b], place[a]) for a, b in links}
    root = groups(len(ids), lambda i, j: (i, j) in near)
    assert {frozenset(ids[i] for i in range(len(ids)) if root[i] == r) for r in set(root)} == want
    assert len(links) == sum(len(x) - 1 for x in want) and len(calls) <= 20


def test_edit_check_visits_only_cells_from_which_the_end_is_near(monkeypatch):
    """Who leaves the diagonal must come back within the same edits, so a block of 64 rows needs 64 + most columns, not 64 + 2 * most."""
    seen, plain = [], line_dedup._deltas
    monkeypatch.setattr(line_dedup, "_deltas", lambda same, text, *borders: seen.append(text.size) or plain(same, text, *borders))
    rng = random.Random(12)
    a = ["".join(rng.choices("abcdefgh ", k=480)) for _ in range(300)]
    b = ["".join(rng.choice("xy") if rng.random() < 0.18 else c for c in x) for x in a]
    most = [96 if k % 2 else line_dedup.edit_distance(x, y) - 1 for k, (x, y) in enumerate(zip(a, b, strict=True))]
    assert line_dedup.within(a, b, np.array(most)).tolist() == [line_dedup.edit_distance(x, y) <= k for x, y, k in zip(a, b, most, strict=True)]
    assert seen and sum(seen) <= 300 * 8 * (64 + 2 + max(most))


@settings(max_examples=200, deadline=None)
@given(st.text("ab dé漢", min_size=1, max_size=300), st.text("ab dé漢", min_size=1, max_size=300), st.integers(-3, 3), st.booleans())
def test_one_pair_within_equals_edit_distance(a, b, more, near):
    b = a[: len(a) // 3] + b[:20] + a[len(a) // 2 :] if near else b
    true = line_dedup.edit_distance(a, b)
    most = max(true + more, abs(len(a) - len(b)))
    assert line_dedup._one_within(a, b, most) == (true <= most)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aB \t\n\x0b\x00é漢", max_size=30), min_size=1, max_size=8))
def test_normalised_lines_and_their_hashes(texts):
    """Lines of all rows as split() gives them; equal hashes for equal ones alone, whatever stands around them."""
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    text, lo, hi, word, _, _, first = line_dedup.normal_lines(data, offsets)
    lines = [" ".join(x.translate({b: b + 32 for b in range(65, 91)}).split()) for t in texts for x in t.replace("\x0b", " ").split("\n")]
    assert first.tolist() == np.cumsum([0, *[t.count("\n") + 1 for t in texts]]).tolist()
    assert [text[a:b].tobytes().decode() for a, b in zip(lo, hi, strict=True)] == lines
    both = list(zip(*(x.tolist() for x in line_dedup.line_hashes(text, lo, hi, np.diff(word) > 0)), strict=True))
    assert all((h == (0, 0)) == (x == "") for h, x in zip(both, lines, strict=True))
    assert len(set(both)) == len(set(lines)) == len({h for h, _ in both}) == len({h for _, h in both})
