import random
import re

import pytest

from verdigris.llm import jaccard
from verdigris.llm.components import components


def words(t):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x20\x09-\x0d]+", lower)


def brute(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def run(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(df).collect()), key=str)


def test_against_brute_force(docs):
    assert run(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize(("seed", "block"), [(1, 4), (2, 1024)])
def test_families_and_common_lines(spark, seed, block, monkeypatch):
    """Trees of many blocks, near copies around the threshold, and a line that half of the texts share."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    line, base = " ".join(r.choices(vocabulary, k=25)), r.choices(vocabulary, k=120)
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 7])):
            text[r.randrange(len(text))] = r.choice(vocabulary)
        rows.append((i, " ".join(text)))
    rows += [(100 + i, line + " " + " ".join(r.choices(vocabulary, k=r.choice([2, 5, 40])))) for i in range(90)]
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == brute(rows)


@pytest.mark.parametrize(("turns", "block"), [(0, 3), (3, 3), (0, 1024)])
def test_turns_change_no_link(spark, monkeypatch, turns, block):
    """Links come out of the last traversal alone, or of turns that merge labels ahead of it, of one block or of many."""
    r = random.Random(5)
    base = [[f"f{f}w{i}" for i in range(60)] for f in range(3)]
    rows = []
    for i in range(60):
        text = list(base[i % 3])
        for _ in range(r.choice([0, 1, 1, 2, 5])):
            text[r.randrange(len(text))] = f"x{r.randrange(99)}"
        rows.append((i, " ".join(text)))
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(jaccard, "TURNS", turns)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    assert run(made) == brute(rows)


def test_a_family_gives_few_pairs(spark, monkeypatch):
    """Each turn gives fewer pairs than the family has members, and the last one next to none."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: i % 190], f"x{i}", *base[i % 190 + 1 :]])) for i in range(400)]
    given = []
    verified = jaccard._Join.verified

    def counted(self, pairs, members):
        given.append(pairs.count())
        return verified(self, pairs, members)

    monkeypatch.setattr(jaccard._Join, "verified", counted)
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    assert {c for _, _, c in run(spark.createDataFrame(rows, "doc_id bigint, text string"))} == {0}
    assert given[0] < 400 and sum(given) < 1200


def test_forest_connects_what_may_link():
    """The pairs of a block connect exactly what all pairs of the plain traversal connect, without a ring."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(7)
    base = r.integers(0, 1 << 63, (3, 80)).astype(np.uint64)
    rows = []
    for token in (1, 2):
        for i in range(200):
            change = r.random(80) < r.choice([0, 0.02, 0.1, 0.6])
            tokens = np.unique(np.where(change, r.integers(0, 1 << 63, 80).astype(np.uint64), base[i % 3]))
            rows.append((token, 0, 0, 0, int(r.integers(1 << 60)), len(tokens), jaccard._bits(tokens).tobytes()))
    names = ["token", "a", "b", "side", "cls", "lo", "bits"]
    table = pa.table({k: [row[i] for row in rows] for i, k in enumerate(names)})
    table = table.append_column("hi", table["lo"]).append_column("label", table["cls"]).append_column("loose", pa.nulls(len(rows), pa.int64()))

    def parts(pairs):
        label = list(range(len(rows)))

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        joined = 0
        for x, y in zip(*(p.tolist() for p in pairs), strict=True):
            joined += root(x) != root(y)
            label[max(root(x), root(y))] = min(root(x), root(y))
        return [root(x) for x in range(len(rows))], joined

    whole = parts(jaccard._traversed(table, 80))[0]
    for turn in range(3):
        x, y = jaccard._forest(table, 80, turn)
        got, joined = parts((x, y))
        assert got == whole and joined == len(x) < len(rows)


def test_bounds_never_exclude_a_link():
    import numpy as np

    def nodes(sets):
        size = np.array([len(x) for x in sets])
        bits = [jaccard._bits(x) for x in sets]
        loose = size - np.array([int(np.bitwise_count(x).sum()) for x in bits])
        return jaccard._Nodes(size, size, loose, np.arange(len(sets)), bits)

    r = np.random.default_rng(0)
    for _ in range(300):
        n = int(r.integers(2, 400))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * r.uniform(0.6, 1))], r.integers(0, 1 << 63, int(r.integers(0, 60))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            noise = [np.unique(r.integers(0, 1 << 63, int(r.integers(1, 500))).astype(np.uint64)) for _ in range(3)]
            members = nodes([a, noise[0], noise[1], b, noise[2]])
            above = members.merged(np.array([0, 3]))
            assert members.possible(np.array([0]), np.array([3]), 80).all()
            assert above.possible(np.array([0]), np.array([1]), 80).all()
            assert above.joined(members).possible(np.array([0]), np.array([5]), 80).all()


def test_keep_one_and_odd_tables(docs, clashing, empty):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    lowest = {d: c for d, _, c in run(docs)}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, c in lowest.items() if d is None or d == c}
    assert run(empty) == [] and jaccard.keep_one(empty).count() == 0
    assert run(clashing) == run(docs)


@pytest.mark.parametrize("broadcast", [True, False])
def test_keep_one_keeps_one_row_of_each_component(spark, docs, monkeypatch, broadcast):
    """Repeated rows, null ids, and an id with two texts; rows are counted, not ids."""
    if not broadcast:
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    own = lambda i: " ".join(f"v{i}x{j}" for j in range(20))
    rows = [(1, own(1), "a")] * 3 + [(1, own(1), "b")]  # one row four times
    rows += [(None, own(2), "a")] * 2 + [(None, own(2) + " more", "a")]  # copies without an id
    rows += [(None, own(3), "a"), (3, own(3).upper(), "a"), (4, own(3), "a")]  # an id is preferred
    rows += [(7, own(1), "a"), (7, own(7), "a")]  # one text of id 7 is a copy, the other stays
    rows += [(8, own(8), "a"), (8, own(8) + " more", "a")]  # two near texts under one id
    rows += [(9, None, "a")] * 2 + [(9, " \n\t\x0b", "a")] * 2 + [(None, "", "a")] * 2
    made = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    got = sorted(((r["doc_id"], (r["text"] or "").split()[:1]) for r in jaccard.keep_one(made).collect()), key=str)
    want = [(1, ["v1x0"]), (None, ["v2x0"]), (3, ["V3X0"]), (7, ["v7x0"]), (8, ["v8x0"])] + [(9, [])] * 4 + [(None, [])] * 2
    assert got == sorted(want, key=str)
    # of the fixture: as many rows as components of the rows numbered, and rows without words
    numbered = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(docs.collect())], "doc_id bigint, text string")
    whole = run(numbered)
    wanted = len({c for _, n, c in whole if n}) + sum(not n for _, n, _ in whole)
    kept = jaccard.keep_one(docs)
    assert kept.count() == wanted and kept.filter("doc_id = 48").count() == 1


def test_components(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(60)]
    stars = [(100, 100 + i) for i in range(1, 40)]
    loose = [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    edges = [*chain, *stars, *loose, (5, 5), (1, 0)]
    r.shuffle(edges)
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_tokens_of_one_class_are_only_counted(spark, docs, monkeypatch):
    """Hashes of classes are shuffled for tokens that several classes have, not for the many others."""
    saved, tables = jaccard.saved, []
    monkeypatch.setattr(jaccard, "saved", lambda df: (tables.append((df.columns, df._jdf.queryExecution().toString())), saved(df))[1])
    join = jaccard._Join(docs, 5, 80)
    groups = join.groups(join.classes(join.members()[1]))
    plans = [plan for columns, plan in tables if set(columns) == {"token", "cls"}]
    assert len(plans) == 2 and "xxhash64" not in plans[0] and "xxhash64" in plans[1]
    sizes = [r["count"] for r in groups.groupBy("token").count().collect()]
    assert sizes and min(sizes) > 1
