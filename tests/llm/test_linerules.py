import re
from collections import Counter

from verdigris.llm import linerules


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def brute(t):
    t = t or ""
    w = words(t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered)


def test_base_counts_against_brute_force(spark, docs, clashing, empty):
    more = spark.createDataFrame([(1000 + i, t, "s") for i, t in enumerate(["a b a b a b a b a b", "x\nx\n\nx y\r\nx y", "a#b **c** é|ü <t>", "a b c d e\na b c d e", "1 2 3 4 5 6 1 2 3 4 5"])], "doc_id bigint, text string, source string")
    both = docs.select("doc_id", "text", "source").union(more)
    want = {}
    for r in both.collect():
        want.setdefault(r["doc_id"], set()).add(brute(r["text"]))
    got = linerules.judge(both).collect()
    assert len(got) == both.count()
    for r in got:
        base = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert base in want[r["doc_id"]]
        assert r["base_failed"] == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert not (r["base_failed"] and r["kept"])
    assert linerules.judge(clashing).count() == docs.count()
    assert linerules.judge(empty).count() == 0


def test_lines_are_counted_for_each_host_over_distinct_documents(spark):
    own = lambda i: " ".join(f"v{i}x{j}" for j in range(12))
    shared = "Home | About | Contact us today for more of the same old thing again friend"
    rows = [(i, f"{own(i)}\n{shared}", "h1") for i in range(60)] + [(100 + i, f"{shared.upper()}\n{shared}\nx{i}", "h1") for i in range(10)]
    rows += [(200 + i, f"{own(i + 500)}\n{shared}", "h2") for i in range(5)] + [(300, f"{own(9)} {own(8)}", None)]
    rows += [(400, f"{own(900)}\nonly here", "h3")] * 80  # one document many times
    got = {r["doc_id"]: r for r in linerules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    n = len(shared.split())
    assert all(got[i]["n_removed_words"] == n and got[i]["kept"] for i in range(60))
    assert all(got[100 + i]["n_removed_words"] == 2 * n and not got[100 + i]["kept"] for i in range(10))
    assert all(got[200 + i]["n_removed_words"] == 0 and got[200 + i]["kept"] for i in range(5))
    assert got[300]["kept"] and got[400]["n_removed_words"] == 0


def test_lines_of_a_few_documents_of_large_and_small_hosts(spark):
    own = lambda i: " ".join(f"v{i}x{j}" for j in range(12))
    shared = "Sign up for our letter"
    rows = [(i, f"{own(i)}\n{shared}" if i % 14 == 0 else own(i), "large") for i in range(300)]  # 22 of 300
    rows += [(1000 + i, f"{own(1000 + i)}\n{shared}" if i < 8 else own(1000 + i), "small") for i in range(10)]
    rows += [(2000 + i, f"{shared}\n{own(2000 + i)}\n{shared}", None) for i in range(7)]
    rows += [(3000 + i, own(9999), "copies") for i in range(20)]  # one text under many ids
    rows += [(4000 + i, f"{own(4000 + i)}\n{shared}", "few") for i in range(5)]
    rows += [(0, rows[0][1], "large")] * 2
    got = linerules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    want = sorted((d, (5 * t.count(shared)) if s in ("large", "small", None) else 0) for d, t, s in rows)
    assert sorted((r["doc_id"], r["n_removed_words"]) for r in got) == want
    assert all(r["kept"] != r["base_failed"] for r in got)
