"""Models of the text operators against plain Python that goes through the texts character by character."""

import collections
import math
import re

import numpy as np
import pytest

from cellweave.llm import language_id, quality_rank

MASK = 0xFFFFFFFF
ODD = ["", "7 + 8", "x", "ÄÖÜ ẞtraße İstanbul ǅ", "日本語のテキスト", "  padded\t\ttext \n\n again  ", "a" * 5000 + " b" * 3000, "🙂 smile 🙂 smile", "é combining", None]


@pytest.fixture(scope="module")
def docs(spark, small):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    top = max(r[0] for r in rows)
    return rows + [(top + 1 + i, t, None) for i, t in enumerate(ODD)]


def grams(text):
    """Buckets of all 1- to 3-grams of the lower-case letters, what lies between two letters being one space."""
    folded = []
    for c in text or "":
        if not c.isalpha():
            c = " "
        elif len(c.lower()) == 1:
            c = c.lower()
        if c != " " or not folded or folded[-1] != " ":
            folded.append(c)
    for n in (1, 2, 3):
        for i in range(len(folded) - n + 1):
            if n == 1 and folded[i] == " ":
                continue
            h = n * 0x27D4EB2F & MASK
            for c, factor in zip(folded[i : i + n], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
                h = ((h ^ ord(c)) * factor) & MASK
            yield h >> 16


def test_language_is_that_of_plain_sums_of_logarithms(spark, docs):
    learn = [d for d in docs if d[0] % 3]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(frame(learn))
    counts, n_docs = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in learn:
        if lang is not None:
            n_docs[lang] += 1
            counts[lang].update(grams(text))
    names = sorted(n_docs)
    assert model.languages == names
    log = {lang: (math.log(n_docs[lang] / n_docs.total()), math.log(counts[lang].total() + 0.5 * 65536)) for lang in names}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(frame(docs), model).collect()}
    assert len(got) == len(docs)
    for ident, text, _ in docs:
        if not any(c.isalpha() for c in text or ""):
            assert got[ident] == ("und", 0.0)
            continue
        held = collections.Counter(grams(text))
        sums = [log[lang][0] + sum(n * (math.log(counts[lang][g] + 0.5) - log[lang][1]) for g, n in held.items()) for lang in names]
        best = max(range(len(names)), key=lambda k: (sums[k], -k))
        share = 1 / sum(math.exp(s - sums[best]) for s in sums)
        runner_up = sorted(sums)[-2]
        if sums[best] - runner_up > 1e-2:  # the operator's table is in single precision
            assert got[ident][0] == names[best]
        assert got[ident][1] == pytest.approx(share, abs=5e-3)


def plain_features(text):
    """The features of quality_rank.NAMES, one after the other."""
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    lines = [line for line in data.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    n, chars = max(len(words), 1), max(len(data), 1)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lower = lambda w: bytes(b + 32 if 65 <= b <= 90 else b for b in w)
    count = lambda test: sum(1 for b in data if test(b))
    letters = count(lambda b: b >= 128 or chr(b).isalpha())
    shares = [
        count(lambda b: 65 <= b <= 90) / max(letters, 1), count(lambda b: 48 <= b <= 57) / chars,
        count(lambda b: 33 <= b <= 126 and not chr(b).isalnum()) / chars, count(lambda b: b in b"#*$%&|<>") / chars,
        sum(w[-1] in b"#*$%&|<>" for w in words) / n, data.count(b"!") / n, data.count(b"|") / n, len(repeated) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1), len({lower(w) for w in words}) / n,
    ]
    rest = [
        min(sum(len(w.decode()) for w in words) / n, 20) / 10, sum(len(w) <= 2 for w in words) / n, sum(w[-1] in b"!.?" for w in words) / n,
        math.log1p(n / max(len(lines), 1)) / 5, math.log1p(len(words)) / 10, float(len(words) < 10),
    ]
    return [*(math.sqrt(min(s, 4)) for s in shares), *rest]


def test_quality_is_that_of_plain_features_and_weights(spark, docs):
    raw = [(t or "").encode() for _, t, _ in docs]
    got = quality_rank.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    want = np.array([plain_features(t) for _, t, _ in docs])
    assert got.shape == (len(docs), len(quality_rank.NAMES))
    off = ~np.isclose(got, want, atol=1e-12).all(0)
    assert not off.any(), [name for name, bad in zip(quality_rank.NAMES, off, strict=True) if bad]
    rng = np.random.default_rng(0)
    model = quality_rank.Model(rng.normal(size=len(quality_rank.NAMES)), 0.3, 0.8)
    scored = {r.doc_id: (r.score, r.predicted) for r in quality_rank.score(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), model).collect()}
    for (ident, _, _), x in zip(docs, want, strict=True):
        odds = math.exp((float(np.dot(x, model.weights)) - 0.3) / 0.8) * 0.7 / 0.3
        assert scored[ident][0] == pytest.approx(odds / (1 + odds), abs=1e-9) and scored[ident][1] == (scored[ident][0] >= 0.7)


def test_documents_tied_at_the_cut_are_judged_alike(spark):
    texts = [(i, "the same words in the same order, every time.") for i in range(20)]
    x = np.array(plain_features(texts[0][1]))
    weights = np.zeros(len(x))
    weights[10] = 1.0
    scored = quality_rank.score(spark.createDataFrame(texts, "doc_id long, text string"), quality_rank.Model(weights, float(x[10]), 1.0)).collect()
    assert len({(r.score, r.predicted) for r in scored}) == 1 and scored[0].score == pytest.approx(0.7)
