"""Lattice scores against sums over all spellings one by one, and counts against plain Python."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from verdigris.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return lattice.Vocabulary(PATH)


def spellings(word, pieces):
    """All ways to write bytes as pieces."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            yield from ([pieces[word[:n]], *rest] for rest in spellings(word[n:], pieces))


WORDS = [b"a", b"the", b"those", "été".encode(), b"\x00\x01", "日本".encode(), b"ing", b"<0x41>", b"\xe2\x96\x81x"]


def test_likelihood_adds_up_all_spellings(vocabulary):
    pieces = {p: i for i, p in enumerate(vocabulary.pieces)}
    weights = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces) + 1)))
    times = np.arange(1.0, len(WORDS) + 1)
    expected, want = defaultdict(float), []
    for word, n in zip(WORDS, times, strict=True):
        ways = [(math.exp(sum(weights[x] for x in s)), s) for s in spellings(b" " + word, pieces)]
        total = sum(p for p, _ in ways)
        want.append(math.log(total))
        for p, s in ways:
            for x in s:
                expected[x] += n * p / total
    of = lattice.Lattice(vocabulary, WORDS)
    assert np.allclose(of.likelihood(weights), want, rtol=1e-10)
    got = of.expected(weights, times)
    assert set(np.flatnonzero(got)) == set(expected) and np.allclose([got[i] for i in expected], list(expected.values()), rtol=1e-8)
    alone = [lattice.Lattice(vocabulary, [w]).likelihood(weights)[0] for w in WORDS]
    assert np.allclose(alone, want, rtol=1e-10)
    long = lattice.Lattice(vocabulary, [b"ab" * 20_000]).likelihood(weights)[0]
    assert -1e7 < long < -1000


def test_every_turn_fits_better(spark, docs, vocabulary):
    words = lattice.count_words(docs).cache()
    table = [(r["word"], r["trained"]) for r in words.collect() if r["trained"] and r["word"]]
    times = np.array([n for _, n in table], float)
    fits = []
    for turns in range(4):
        weights = lattice.fit(words, PATH, turns)
        assert abs(np.exp(weights).sum() - 1) < 1e-9
        fits.append((lattice.Lattice(vocabulary, [bytes(w) for w, _ in table]).likelihood(weights) * times).sum())
    assert fits == sorted(fits) and fits[3] > fits[0] + 100


def brute(rows, weights, vocabulary):
    """``doc_id`` and all columns by the contract's words; texts' likelihoods word by word."""
    away = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    seen = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if not away(i) for w in ws)
    n, v = sum(seen.values()), len(seen)
    like = {w: lattice.Lattice(vocabulary, [w]).likelihood(weights)[0] if w else weights[-1] for ws in tokens for w in ws}
    return [(i, away(i), len(ws), sum(w in seen for w in ws), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws), sum(like[w] for w in ws) / math.log(10)) for (i, _), ws in zip(rows, tokens, strict=True)]


def near(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[:5]), r[6])) for x in (got, want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(a - b) <= 1e-9 * max(1, abs(b)) for g, w in zip(got, want, strict=True) for a, b in zip(g[5:], w[5:], strict=True))


@pytest.mark.parametrize("frequent", [1 << 16, 10])
def test_scores_of_texts(spark, docs, vocabulary, monkeypatch, frequent):
    """Also where most words are joined and not sent."""
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    weights = lattice.fit(lattice.count_words(docs), PATH, 1)
    near(map(tuple, lattice.score(docs, PATH, 1).collect()), brute(rows, weights, vocabulary))


def test_odd_tables(spark, clashing, empty):
    assert lattice.score(empty, PATH).count() == 0
    assert lattice.score(clashing, PATH, 1).count() == clashing.count()
    away = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = spark.createDataFrame([(away, "Unseen words"), (away, None)], "doc_id bigint, text string")
    got = lattice.score(only, PATH).orderBy("n_tokens").collect()
    assert [(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(True, 1, 0, 0, 0.0), (True, 3, 0, 0, 0.0)]
    assert got[1]["score"] < got[0]["score"] < 0
