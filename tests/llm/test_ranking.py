"""Ranked search against scores of all documents in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from verdigris.llm import ranking

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(i, Counter(b)) for i, t in docs if (b := terms(t))]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(x for _, b in bags for x in b)
    out = []
    for item, text in set(items):
        scored = []
        for i, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if t in bag)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, place + 1, i, -s) for place, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def asked(docs):
    rows = [(r["doc_id"] or 0, r["text"]) for r in docs.collect() if r["text"] is not None][:40]
    return [*rows, (7, "other text"), (900, "wabcde NOT there"), (901, ""), (902, "É ça"), (902, "É ça")]


def ranked(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_ranks_as_all_scores_do(spark, docs, asked, k):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = spark.createDataFrame(asked, "item_id bigint, text string")
    assert ranked(ranking.rank(docs, items, k)) == brute(rows, asked, k)


def test_blocks_of_items_and_small_tables_in_memory_change_nothing(spark, docs, asked, monkeypatch):
    items = spark.createDataFrame(asked, "item_id bigint, text string")
    want = ranked(ranking.rank(docs, items, 4))
    monkeypatch.setattr(ranking, "CELLS", 1)
    assert ranked(ranking.rank(docs, items, 4, item_bytes=40_000)) == want


def test_seeds_and_suffixes_keep_the_best():
    """Skewed terms, so that suffixes are pruned and candidates dropped; the same best as without pruning."""
    r = np.random.default_rng(5)
    share = 1 / np.arange(1, 301)
    texts = [b" ".join(b"w%d" % x for x in r.choice(300, r.integers(1, 60), p=share / share.sum())) for _ in range(900)]
    wanted = [b" ".join(b"w%d" % x for x in r.choice(300, 12, replace=False)) for _ in range(40)]
    import pyarrow as pa

    def search(seeded):
        items = ranking._Items(pa.array(range(40)), wanted)
        number = items.number
        bags = [Counter(number[w] for w in ranking.terms(t) if w in number) for t in texts]
        n = np.array([len(ranking.terms(t)) for t in texts])
        m = 50 + 50 * n * 900 // int(n.sum())
        of = [sorted((1_000_000_000 * b[t] // (1000 * b[t] + 20 * int(x)) for b, x in zip(bags, m, strict=True) if t in b), reverse=True) for t in range(len(number))]
        stored = pa.table({"term": range(len(number)), "df": [len(x) for x in of], "most": [x[0] if x else 0 for x in of], "kth": [x[4] if len(x) > 4 and seeded else 0 for x in of]})
        items.plan(900, int(n.sum()), stored, 5)
        run = ranking._Search(items, 5)
        for lo in range(0, 900, 150):
            some = [sorted(b.items()) for b in bags[lo : lo + 150]]
            first = np.append(0, np.cumsum([len(x) for x in some]))
            term, tf = (np.array([y[i] for x in some for y in x], np.int64) for i in range(2))
            run.add(np.zeros(150, bool), np.arange(lo, lo + 150), n[lo : lo + 150], first, term, tf)
        return items, [x.tolist() for x in run.held]

    pruned, got = search(True)
    whole, want = search(False)
    assert got == want and len(got[0]) == 200
    assert len(pruned.other_term) > 20 and len(whole.other_term) == 0


def test_odd_tables(spark, clashing, docs, empty, asked):
    items = spark.createDataFrame(asked, "item_id bigint, text string")
    assert ranked(ranking.rank(clashing, items.selectExpr("*", "1 score", "2 rank"), 3)) == ranked(ranking.rank(docs, items, 3))
    assert ranking.rank(empty, items).count() == 0
    assert ranking.rank(docs, items.limit(0)).count() == 0
    names = items.selectExpr("concat('item ', item_id) AS item_id", "text")
    assert {r["item_id"][:5] for r in ranking.rank(docs, names, 1).collect()} == {"item "}
