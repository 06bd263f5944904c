from collections import Counter

from pyspark.sql import functions as F

from verdigris.llm import sharding
from verdigris.llm.sharding import SlotMap


def test_growing_moves_slots_into_the_new_shard_only():
    old = SlotMap.even(8)
    new = old.grown()
    moved = [(a, b) for a, b in zip(old.shards, new.shards, strict=True) if a != b]
    assert {b for _, b in moved} == {8} and len(moved) == 4096 // 9
    assert max(Counter(new.shards).values()) - min(Counter(new.shards).values()) <= 1
    assert new.version == 2 and old.version == 1


def test_rebalancing_evens_bytes():
    sizes = {i: (i * 7919) % 1000 + (100_000 if i % 8 == 3 else 0) for i in range(4096)}
    old = SlotMap.even(8)
    new = old.rebalanced(sizes)
    loads = lambda m: Counter({s: sum(sizes[i] for i, x in enumerate(m.shards) if x == s) for s in range(8)})
    assert max(loads(old).values()) > 2 * min(loads(old).values())
    assert max(loads(new).values()) - min(loads(new).values()) <= 101_000


def test_maps_are_stored_by_version(spark, tmp_path):
    old = SlotMap.even(3, 64)
    for m in (old, old.grown()):
        m.save(spark, str(tmp_path / "map"))
    assert SlotMap.load(spark, str(tmp_path / "map")) == old.grown()
    assert SlotMap.load(spark, str(tmp_path / "map"), 1) == old


def placed(docs):
    rows = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    return sharding.numbered(sharding.assign(rows, SlotMap.even(8)), ["doc_id", "text_crc32"]).select("doc_id", "shard", "slot")


def test_places_are_gapless_and_ids_decide(docs, clashing, empty):
    rows = placed(docs).collect()
    assert len(rows) == docs.count()
    for shard in range(8):
        places = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert places == list(range(len(places)))
    where = {r["doc_id"]: r["shard"] for r in rows}
    assert all(where[r["doc_id"]] == r["shard"] for r in rows)
    part = placed(docs.filter("doc_id % 3 = 0")).collect()
    assert all(where[r["doc_id"]] == r["shard"] for r in part)
    assert placed(clashing).count() == len(rows) and placed(empty).count() == 0
    stats = sharding.slot_stats(docs).agg(F.sum("rows"), F.sum("bytes")).first()
    assert tuple(stats) == (len(rows), sum(len((r["text"] or "").encode()) + 1 for r in docs.collect()))


def test_maps_are_made_from_sums_and_edited_in_the_store(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    first = sharding.published(docs, path, 4, 64)
    assert first == SlotMap.even(4, 64)
    held = spark.read.parquet(path).agg(F.sum("rows"), F.sum("bytes"), F.count("*")).first()
    assert tuple(held) == (docs.count(), sum(len((r["text"] or "").encode()) + 1 for r in docs.collect()), 64)
    grown = sharding.edited(spark, path, lambda last, _: last.grown())
    even = sharding.edited(spark, path, lambda last, sizes: last.rebalanced(sizes))
    assert (grown.version, even.version, even.count) == (2, 3, 5)
    loads = lambda m: [r["b"] for r in sharding.assign(docs, m).groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b")).collect()]
    assert max(loads(even)) <= max(loads(grown))
    assert SlotMap.load(spark, path, 1) == first and SlotMap.load(spark, path) == even


def test_repeated_rows_and_clashing_names_are_numbered(spark):
    rows = spark.createDataFrame([(7, "same", "own")] * 500 + [(None, None, "own")] * 40, "doc_id bigint, text string, slot_part string").withColumn("text_crc32", F.lit(1))
    got = sharding.numbered(sharding.assign(rows, SlotMap.even(3)), ["doc_id"]).collect()
    assert all(r["slot_part"] == "own" for r in got)
    for shard in {r["shard"] for r in got}:
        places = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert places == list(range(len(places)))
