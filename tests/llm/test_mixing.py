import re
from collections import defaultdict

from pyspark.sql import functions as F

from verdigris.llm import mixing


def fill(sizes, weights=(3, 1, 2), share=1.5, ceiling=2.0):
    """Targets by resharing round after round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    got, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= ceiling * sizes[s]}
        if not full:
            return got | {s: level * weight[s] for s in free}
        got |= {s: ceiling * sizes[s] for s in full}
        left -= sum(got[s] for s in full)
        free -= full
    return got


def test_plan_against_brute_force(docs):
    rows = docs.collect()
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += count(r["text"])
    want = fill(dict(sizes))
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["mix_size"] == count(r["text"]) and r["mix_source_size"] == sizes[r["source"]]
        assert abs(r["mix_target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["mix_copies"] <= 2
        taken[r["source"]] += r["mix_copies"] * r["mix_size"]
    largest = max(r["mix_size"] for r in got)
    assert all(abs(taken[s] - want[s]) <= largest for s in want)


def test_many_sources(spark):
    rows = [(i, "a " * (1 + i * 37 % 101), f"s{i % 17}" if i % 17 else None) for i in range(900)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    sums = got.groupBy("mix_source_size", "mix_target", "source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken")).collect()
    want = fill({r["source"]: r["mix_source_size"] for r in sums})
    for r in sums:
        assert abs(r["mix_target"] - want[r["source"]]) < 1e-6 and abs(r["taken"] / r["mix_target"] - 1) < 0.03
    assert abs(sum(want.values()) - 1.5 * sum(r["mix_source_size"] for r in sums)) < 1e-6


def test_mix_repeats_rows_and_agrees_with_itself(docs, clashing, empty):
    assert mixing.mix(docs).columns == docs.columns
    first, again = (sorted(map(str, mixing.mix(docs.repartition(n)).collect())) for n in (2, 5))
    assert first == again
    assert mixing.mix(clashing).columns == clashing.columns
    assert mixing.mix(empty).count() == 0
    assert mixing.plan(docs.filter("text is null")).first()["mix_copies"] == 0


def test_own_columns_stay(docs):
    names = ("mix_size", "mix_key", "mix_rate", "mix_turn", "mix_source", "mix_copies", "size", "rate")
    own = docs.withColumns({n: F.lit(f"own {n}") for n in names})
    got = mixing.mix(own)
    assert got.columns == own.columns and got.filter(" OR ".join(f"{n} <> 'own {n}'" for n in names)).count() == 0
    assert sorted(map(str, got.select(docs.columns).collect())) == sorted(map(str, mixing.mix(docs).collect()))
    planned = mixing.plan(own)
    assert planned.filter("mix_key = 'own mix_key'").count() == docs.count() and dict(planned.dtypes)["mix_size"] == "bigint"
