"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.scratch import drop, saved


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for the nodes of ``edges (a, b)``.

    Each round hangs larger neighbours of a node below its smallest neighbour, then the rest; it ends when
    every edge leads to a component's smallest node. Edges stay as many as the nodes at most; only counts
    reach the driver. Nulls in ``edges`` lead nowhere; repeated and empty edges change nothing. Minima are taken
    before the shuffle, and the joins are left to Spark, which splits the partition of a hub.
    """
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u AND m < v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        new = saved(small)
        drop(now)
        now = new
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:  # each node has one edge, to the smallest
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before = state
