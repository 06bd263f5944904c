"""Durations: exact percentiles, means, the slowest tests and percentile ranks, run by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.scalars import round2

PERCENTILES, SLOWEST = (50, 75, 90, 95, 99), 10
#: Ranges of durations that a group is cut into.
PARTS = 64


def _steps(executions: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Distinct durations of each group with how many there are (``n``), up to it (``upto``) and in all (``size``).

    Equal durations are counted first. A group is then cut into :data:`PARTS` ranges of durations, at cuts that need
    not be exact: each range is sorted by itself and starts at the sum of the ranges below, so that a group as
    large as the whole table is not sorted in one task.
    """
    steps = executions.groupBy(*by, "duration_ms").agg(F.count("*").alias("n"))
    cuts = steps.groupBy(*by).agg(F.percentile_approx("duration_ms", [i / PARTS for i in range(1, PARTS)], 20 * PARTS).alias("cuts"))
    parted = steps.join(cuts, [*by]).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("duration_ms")))).drop("cuts")
    counts = parted.groupBy(*by, "part").agg(F.sum("n").alias("held"))
    below = counts.select(*by, F.col("part").alias("other"), F.col("held").alias("other_held"))
    own = F.col("other") < F.col("part")
    starts = counts.join(below, [*by]).groupBy(*by, "part").agg(F.sum(F.when(own, F.col("other_held")).otherwise(0)).alias("start"), F.sum("other_held").alias("size"))
    within = Window.partitionBy(*by, "part").orderBy("duration_ms")
    return parted.withColumn("upto", F.sum("n").over(within)).join(starts, [*by, "part"]).select(*by, "duration_ms", "n", (F.col("start") + F.col("upto")).alias("upto"), "size")


def percentiles(executions: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """p50 to p99 and the mean for each group, to two decimals.

    A percentile lies at p/100 * (n - 1) of the sorted durations: lower + (upper - lower) * fraction.
    """
    steps = _steps(executions, by)
    values = []
    for p in PERCENTILES:
        at = F.lit(p / 100) * (F.col("size") - 1)
        pick = lambda i: F.min(F.when(F.col("upto") > i, F.col("duration_ms")))
        low, high = pick(F.floor(at)), pick(F.ceil(at))
        values.append(round2(low + (high - low) * F.first(at - F.floor(at))).alias(f"p{p}"))
    mean = F.sum(F.col("duration_ms") * F.col("n")) / F.sum("n")
    return steps.groupBy(*by).agg(*values, round2(mean).alias("mean"))


def ranked(executions: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Executions with ``percentile``: the share of their group that is not slower, in percent."""
    share = round2(F.col("upto") / F.col("size") * 100).alias("percentile")
    return executions.join(_steps(executions, by).select(*by, "duration_ms", share), [*by, "duration_ms"])


def slowest(executions: DataFrame, limit: int = SLOWEST, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The slowest executions of each group with their percentile rank; never more than ten.

    Ranks are cut before rows are shuffled, so a task gives at most so many rows of a group.
    """
    place = Window.partitionBy(*by).orderBy(F.desc("duration_ms"), "name", "id")
    few = executions.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= min(limit, SLOWEST))
    share = round2(F.col("upto") / F.col("size") * 100).alias("percentile")
    top = few.join(_steps(executions, by).select(*by, "duration_ms", share), [*by, "duration_ms"])
    return top.select(*by, "rank", F.col("name").alias("test_name"), F.coalesce("file_path", F.lit("")).alias("file_path"), round2(F.col("duration_ms")).alias("duration_ms"), "percentile")
