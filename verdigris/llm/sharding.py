"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots, and rows and bytes are added up for each. A small versioned
table maps slots to shards and keeps these sums; rows are placed by a version read from it. Adding a shard or
evening out bytes writes a new version, so only the slots that change hands move. A row's position comes from
counts by slot, never from a pass over a whole shard in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm.scratch import fresh, saved

SLOTS = 4096
#: Parts that a slot's rows are numbered in, so that many rows with one key aren't one task.
PARTS = 16


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key; null keys share one."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """A versioned map from virtual slots to shards; the shard of slot i is ``shards[i]``."""

    shards: tuple[int, ...]
    count: int
    version: int = 1
    history: tuple[str, ...] = field(default=())

    @classmethod
    def even(cls, count: int, slots: int = SLOTS) -> SlotMap:
        """Version 1: slots in turn, which only the number of shards decides."""
        return cls(tuple(i % count for i in range(slots)), count, 1, (f"even over {count}",))

    def grown(self) -> SlotMap:
        """One more shard takes its even part from the fullest shards in turn; no other slot moves."""
        owned: dict[int, list[int]] = {s: [] for s in range(self.count)}
        for slot, shard in enumerate(self.shards):
            owned[shard].append(slot)
        new, shards = self.count, list(self.shards)
        for _ in range(len(shards) // (self.count + 1)):
            giver = max(owned, key=lambda s: (len(owned[s]), -s))
            shards[owned[giver].pop()] = new
        return replace(self, shards=tuple(shards), count=self.count + 1, version=self.version + 1, history=(*self.history, f"grown to {self.count + 1}"))

    def rebalanced(self, slot_bytes: dict[int, int]) -> SlotMap:
        """Move slots from the largest shard to the smallest while that narrows the gap between them."""
        shards, load = list(self.shards), [0] * self.count
        for slot, shard in enumerate(shards):
            load[shard] += slot_bytes.get(slot, 0)
        for _ in range(len(shards)):
            most, least = max(range(self.count), key=lambda s: load[s]), min(range(self.count), key=lambda s: load[s])
            gap = load[most] - load[least]
            fit = [(slot_bytes.get(i, 0), i) for i, s in enumerate(shards) if s == most and 0 < slot_bytes.get(i, 0) < gap]
            if not fit:
                break
            size, slot = min(fit, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
            shards[slot] = least
            load[most], load[least] = load[most] - size, load[least] + size
        return replace(self, shards=tuple(shards), version=self.version + 1, history=(*self.history, "rebalanced by bytes"))

    def frame(self, spark: SparkSession) -> DataFrame:
        """``virtual_slot, shard``: as many rows as there are slots."""
        return spark.createDataFrame(list(enumerate(self.shards)), "virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str, stats: DataFrame | None = None) -> None:
        """Add this version to the map's table at ``path``, with what each slot holds (:func:`slot_stats`)."""
        rows = self.frame(spark).withColumns({"version": F.lit(self.version), "shards": F.lit(self.count), "history": F.array(*map(F.lit, self.history))})
        held = stats if stats is not None else spark.createDataFrame([], "virtual_slot int, rows bigint, bytes bigint")
        rows = rows.join(held, "virtual_slot", "left").fillna(0, ["rows", "bytes"])
        rows.coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version stored at ``path``, the latest by default."""
        rows = spark.read.parquet(path)
        version = version or rows.agg(F.max("version")).first()[0]
        got = sorted(rows.filter(F.col("version") == version).collect(), key=lambda r: r["virtual_slot"])
        return cls(tuple(r["shard"] for r in got), got[0]["shards"], version, tuple(got[0]["history"]))


def slot_stats(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``virtual_slot, rows, bytes``: what each slot holds; texts count their UTF-8 bytes plus 1.

    Null texts count 1, null ids are one key; a slot without rows has no row here. One row a slot is shuffled
    from each task.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    return docs.groupBy(slot_of(F.col("doc_id"), slots).alias("virtual_slot")).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))


def published(docs: DataFrame, path: str, count: int, slots: int = SLOTS) -> SlotMap:
    """Store version 1 of a map over ``count`` shards at ``path``, with the sums over ``docs``, and read it back."""
    spark = docs.sparkSession
    SlotMap.even(count, slots).save(spark, path, slot_stats(docs, slots))
    return SlotMap.load(spark, path, 1)


def edited(spark: SparkSession, path: str, edit) -> SlotMap:
    """Store ``edit(latest version, bytes by slot)`` as the next version at ``path``, and read it back."""
    last = SlotMap.load(spark, path)
    held = spark.read.parquet(path).filter(F.col("version") == last.version).select("virtual_slot", "rows", "bytes")
    slot_bytes = {r["virtual_slot"]: r["bytes"] for r in held.collect()}  # a row for each slot
    edit(last, slot_bytes).save(spark, path, held)
    return SlotMap.load(spark, path, last.version + 1)


def assign(docs: DataFrame, slot_map: SlotMap) -> DataFrame:
    """``docs`` with ``virtual_slot`` and ``shard``; the map has a fixed number of rows and is broadcast.

    Null ids are one key. Columns of ``docs`` with these names are replaced; every row is kept once.
    """
    rows = docs.drop("virtual_slot", "shard").withColumn("virtual_slot", slot_of(F.col("doc_id"), len(slot_map.shards)))
    return rows.join(F.broadcast(slot_map.frame(docs.sparkSession)), "virtual_slot")


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` (from :func:`assign`) with ``slot``, their place in the shard, gapless from 0.

    Rows are written once with a part of their virtual slot, by where they were read, so that repeated rows
    and keys are dealt as well; they are numbered by ``order`` within a part, and each part starts where those
    before it in the shard end. A column ``slot`` is replaced, others stay.
    """
    part, begin, place = (fresh(rows, f"slot_{c}") for c in ("part", "begin", "place"))
    rows = saved(rows.drop("slot").withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")))
    by = ["virtual_slot", part]
    counts = rows.groupBy("shard", *by).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(begin))  # at most PARTS rows a slot
    within = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn(place, within).join(F.broadcast(starts), by).withColumn("slot", (F.col(begin) + F.col(place)).cast("bigint")).drop(place, begin, part)
