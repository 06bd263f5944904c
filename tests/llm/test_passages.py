import re
from collections import Counter

import pytest

from verdigris.llm import passages


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def brute(texts, window):
    count = Counter()
    for t in texts:
        w = words(t)
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for t in texts:
        w = words(t)
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize(("window", "size"), [(35, 1 << 20), (35, 2000), (6, 3000)])
def test_against_brute_force(docs, window, size):
    rows = docs.collect()
    want = sorted(zip([r["doc_id"] or -1 for r in rows], brute([r["text"] for r in rows], window), strict=True))
    got = sorted((r["doc_id"] or -1, (r["n_words"], r["n_removed"], r["kept_text"])) for r in passages.remove(docs, window, bucket_bytes=size).collect())
    assert got == want


def test_periodic_texts_and_ends(spark):
    period = " ".join(["a b c"] * 40)
    tail = " ".join(f"t{i}" for i in range(40))
    rows = [period, "x " + tail, tail + " y", " ".join(tail.split()[:34]), "z " + " ".join(tail.split()[3:38]), "a " * 35, "q " * 36]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")
    got = [(r["n_words"], r["n_removed"], r["kept_text"]) for r in passages.remove(df).orderBy("doc_id").collect()]
    assert got == brute(rows, 35)


def test_columns_and_empty_tables(docs, clashing, empty):
    assert passages.remove(empty).count() == 0
    got = passages.remove(clashing)
    assert set(got.columns) == (set(clashing.columns) - {"text"}) | {"n_words", "n_removed", "kept_text"}
    assert got.filter("score = 'other score' AND value = 'other value'").count() == docs.count()
    same = {(r["doc_id"], r["kept_text"]) for r in passages.remove(docs, rejoin=False).filter("n_removed = 0").collect()}
    assert same <= {(r["doc_id"], r["text"] or "") for r in docs.collect()}
