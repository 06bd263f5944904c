"""Greedy leaders by rounds against one pass in order."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from verdigris.operators import clusters


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def fold(texts):
    """The leader of each text, in order, by its number."""
    leaders, out = [], []
    for i, t in enumerate(texts):
        raw = t.encode()
        for j, other in leaders:
            if raw == other or (raw and other and 10 * distance(raw, other) <= 3 * max(len(raw), len(other))):
                out.append(j)
                break
        else:
            leaders.append((i, raw))
            out.append(i)
    return out


def assigned(spark, runs, block):
    rows = [(r, t, 10 * i) for r, texts in runs.items() for i, t in enumerate(texts)]
    found = spark.createDataFrame(rows, "run_id string, pattern string, first bigint")
    got = clusters.assign(found, block).collect()
    assert len(got) == len(rows)
    assert all(r["leader"] == runs[r["run_id"]][r["leads"] // 10] for r in got)
    return {(r["run_id"], r["first"] // 10): r["leads"] // 10 for r in got}


@pytest.mark.parametrize("block", [1, 4, 64])
def test_rounds_give_the_leaders_of_one_pass(spark, block):
    r = random.Random(block)
    near = lambda t: "".join(r.choice("abcdé") if r.random() < 0.2 else c for c in t if r.random() > 0.05)
    families = ["".join(r.choices("abcdé", k=r.randrange(3, 40))) for _ in range(6)]
    runs = {f"r{n}": list(dict.fromkeys([near(r.choice(families)) for _ in range(40)])) for n in range(3)} | {None: ["", "aaaaaaaaaa", "aaaaaaabbb", "aaaabbbbbb"], "one": ["x"]}
    assert assigned(spark, runs, block) == {(n, i): j for n, texts in runs.items() for i, j in enumerate(fold(texts))}


def test_bands_and_bags_lose_no_pair(spark):
    """Of all pairs that are similar, each passes the filters that come before its distance."""
    r = random.Random(3)
    rows = []
    for _ in range(400):
        a = "".join(r.choices("abcdefgh ", k=r.randrange(1, 60)))
        b = list(a)
        for _ in range(len(a) * 3 // 10):
            if b and r.random() < 0.5:
                del b[r.randrange(len(b))]
            elif r.random() < 0.5:
                b.insert(r.randrange(len(b) + 1), "z")
            elif b:
                b[r.randrange(len(b))] = "y"
        rows.append((a, "".join(b) or "x"))
    both = spark.createDataFrame(rows, "x string, y string")
    a, b = (clusters._measured(both.select(F.col("x").alias("key"), F.col(c).alias("pattern"))).alias(n) for c, n in (("x", "a"), ("y", "b")))
    want = {x for x, y in rows if 10 * distance(x.encode(), y.encode()) <= 3 * max(len(x), len(y))}
    got = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.abs(F.col("a.band") - F.col("b.band")) <= 1) & clusters._near("a", "b")).select("a.key").distinct().collect()
    assert want <= {k["key"] for k in got}


def test_a_run_of_100_000_patterns(spark):
    """One run as large as that, against leaders taken one by one from what is left."""
    words = "timeout socket element header promise worker module render cookie schema bundle driver replica cursor quota".split()
    r = random.Random(11)
    heads = [" ".join(r.choices(words, k=5)) for _ in range(40)]
    texts = list(dict.fromkeys(f"{heads[r.randrange(40)]} {''.join(r.choices('abcdefghij', k=8))}" for _ in range(101_000)))[:100_000]
    assert len(texts) == 100_000
    db = duckdb.connect()
    db.execute("CREATE TABLE open AS SELECT unnest(?) AS t, unnest(?) AS i", [texts, list(range(100_000))])
    want = {}
    while (head := db.execute("SELECT i, t FROM open ORDER BY i LIMIT 1").fetchone()) is not None:
        similar = "t = $t OR 10 * levenshtein(t, $t) <= 3 * greatest(strlen(t), strlen($t))"
        want |= {i: head[0] for (i,) in db.execute(f"SELECT i FROM open WHERE {similar}", {"t": head[1]}).fetchall()}
        db.execute(f"DELETE FROM open WHERE {similar}", {"t": head[1]})
    found = spark.createDataFrame([("r", t, i) for i, t in enumerate(texts)], "run_id string, pattern string, first bigint").repartition(8)
    got = {x["first"]: x["leads"] for x in clusters.assign(found).select("first", "leads").collect()}
    assert got == want and len(set(want.values())) >= 20
