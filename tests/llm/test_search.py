import math
import re
from collections import Counter

import pytest

from verdigris.llm import search


def terms(t):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute(rows, queries, k):
    bags = [(d, Counter(terms(t))) for d, t in rows]
    mean = sum(sum(b.values()) for _, b in bags) / len(bags)
    df = Counter(x for _, b in bags for x in b)
    out = []
    for q, t in queries:
        scored = []
        for d, b in bags:
            n = sum(b.values())
            s = sum(math.log(1 + (len(bags) - df[x] + 0.5) / (df[x] + 0.5)) * b[x] * 2.2 / (b[x] + 1.2 * (0.25 + 0.75 * n / mean)) for x in set(terms(t)) if x in b)
            if s > 0:
                scored.append((-round(s, 8), math.inf if d is None else d))
        out += [(q, i + 1, None if d == math.inf else d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("size", [1 << 22, 3000])
def test_exact_against_brute_force(docs, size):
    queries = docs.filter("doc_id % 10 = 0").selectExpr("doc_id AS query_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows, sorted({(r["query_id"], r["text"]) for r in queries.collect()}, key=lambda x: x[0]), 5)
    got = sorted(((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 8)) for r in search.top_k(docs, queries, 5, size).collect()), key=lambda x: x[:2])
    assert len(got) == len(want)
    assert all(a[:2] == b[:2] and abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want, strict=True))
    near = sum(a[2] == b[2] for a, b in zip(got, want, strict=True))
    assert near >= len(want) - 2  # scores equal but for the last digit may swap


def test_odd_tables(docs, clashing, empty):
    queries = docs.filter("doc_id IN (40, 41, 43)").selectExpr("doc_id AS query_id", "text")
    got = search.top_k(clashing, queries, 3).collect()
    assert {r["query_id"] for r in got} == {43} and {r["doc_id"] for r in got} == {43, 44}
    assert search.top_k(empty, queries).count() == 0
    assert search.top_k(docs, queries.limit(0)).count() == 0


def test_blocks_of_queries_and_carried_bounds_change_nothing(spark, docs):
    """Many blocks of queries, many shards to a task, or all at once: the same rows."""
    queries = docs.filter("doc_id % 7 = 0").selectExpr("doc_id AS query_id", "text")
    key = lambda df: sorted((r["query_id"], r["rank"], str(r["doc_id"]), r["score"]) for r in df.collect())
    whole = key(search.top_k(docs, queries, 4))
    assert whole == key(search.top_k(docs, queries, 4, shard_bytes=500, tasks=1))
    assert whole == key(search.top_k(docs, queries, 4, shard_bytes=2000, query_bytes=3000, tasks=3))


def test_pruning_keeps_the_best(monkeypatch):
    """One shard after another against scores of all documents, with bounds that prune."""
    import random

    import numpy as np

    r = random.Random(6)
    words = [f"w{i}".encode() for i in range(300)]
    texts = [b" ".join(r.choices(words, weights=[1 / (i + 1) for i in range(300)], k=r.randrange(1, 60))) for _ in range(900)]
    monkeypatch.setattr(search, "BLOCK", 8)
    whole = search.Shard(texts, 30.0)
    parts = [search.Shard(texts[a : a + 150], 30.0) for a in range(0, 900, 150)]
    for _ in range(40):
        terms, _ = search._terms([b" ".join(r.sample(words, 12))])
        terms = np.unique(terms)
        weights = np.array([r.uniform(0.1, 6) for _ in terms])
        at = np.searchsorted(whole.terms, terms)
        at[at == len(whole.terms)] = 0
        known = whole.terms[at] == terms
        whole.weight[at[known]] = weights[known]
        scores = np.zeros(900)
        scores[whole.order] = whole._scores(np.arange(900))
        whole.weight[:] = 0
        want = sorted(((-s, i) for i, s in enumerate(scores.tolist()) if s > 0))[:5]
        best = search._Best(1, 5)
        for p, shard in enumerate(parts):
            found, got = shard.top(terms, weights, 5, best.least[0])
            best.add(0, got, np.zeros(len(found), bool), found + 150 * p)
        assert [(-s, i) for s, _, i in zip(*(x.tolist() for x in best.held[0]), strict=True)] == want


@pytest.mark.parametrize("matrix", [1 << 24, 900 * 30, 0])
@pytest.mark.parametrize("step", [1 << 16, 100])
def test_several_queries_at_once(monkeypatch, matrix, step):
    """Lists of frequent terms as a matrix, all of them, some or none, and postings in pieces: the best as by plain sums."""
    import random

    import numpy as np

    monkeypatch.setattr(search, "MATRIX", matrix)
    monkeypatch.setattr(search, "STEP", step)
    r = random.Random(7)
    words = [f"w{i}".encode() for i in range(400)]
    texts = [b" ".join(r.choices(words, weights=[1 / (i + 1) for i in range(400)], k=r.randrange(0, 60))) for _ in range(850)]
    texts += [texts[3]] * 20 + [b""] * 30
    queries = [r.choice(texts[:850]) for _ in range(37)] + [texts[3], b"", b"absent"]
    terms = np.unique(search._terms(queries)[0])
    weights = np.array([r.uniform(0.1, 6) for _ in terms])
    weight = dict(zip(terms.tolist(), weights.tolist(), strict=True))
    asked = [np.unique(search._terms([q])[0]) for q in queries]
    offsets = np.cumsum([0, *map(len, asked)])
    numbers = np.searchsorted(terms, np.concatenate(asked))
    best = search._Best(len(queries), 5)
    for at in range(0, 900, 300):
        shard = search.Shard(texts[at : at + 300], 30.0)
        shard.ask(terms, weights)
        frequent = sum(1 for a, b in zip(shard.first, shard.last, strict=True) if search.FREQUENT * (b - a) >= 300)
        assert len(shard.rows) <= matrix // shard.width and (matrix < 1 << 24 or 0 < len(shard.rows) <= frequent)
        for q in range(0, len(queries), 16):
            which, found, scores = shard.search(numbers, offsets[q : q + 17], 5, best.least[q : q + 16])
            best.add(which + q, scores, np.zeros(len(found), bool), found + at)
    for q, held in enumerate(best.held):
        want = []
        for i, text in enumerate(texts):
            bag = Counter(search._terms([text])[0].tolist())
            n = sum(bag.values())
            # in the order of the hashes, as equal scores go by id
            score = sum(weight[x] * (bag[x] * 2.2 / (bag[x] + 1.2 * (1 - 0.75 + 0.75 * n / 30.0))) for x in asked[q].tolist() if x in bag)
            if score > 0:
                want.append((-score, i))
        want = sorted(want)[:5]
        assert held[2].tolist() == [i for _, i in want]
        assert held[0].tolist() == pytest.approx([-x for x, _ in want], rel=1e-12)


def test_terms_that_differ_in_lower_bits_alone(monkeypatch):
    import numpy as np

    hashes = {b"a": 1 << 40, b"b": (1 << 40) + 1, b"c": 5}
    monkeypatch.setattr(search, "_terms", lambda texts: (np.array([hashes[w] for t in texts for w in t.split()], np.uint64), np.cumsum([0] + [len(t.split()) for t in texts])))
    term, text, times, lengths = search._pairs([b"b a b", b"c", b"", b"a b"])
    assert list(zip(term.tolist(), text.tolist(), times.tolist(), strict=True)) == [(5, 1, 1), (1 << 40, 0, 1), (1 << 40, 3, 1), ((1 << 40) + 1, 0, 2), ((1 << 40) + 1, 3, 1)]
    assert lengths.tolist() == [3, 1, 0, 2]
