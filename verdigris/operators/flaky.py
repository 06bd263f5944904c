"""Flaky tests: adjacent executions of a test whose outcomes differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.scalars import clamp, round2
from verdigris.operators.tables import history

#: Executions needed, least flip rate, weights of flips and of failures.
LEAST_RUNS, LEAST_RATE, FLIP_WEIGHT, FAILURE_WEIGHT = 5, 0.1, 0.4, 0.4


def flips(rows: DataFrame, by: tuple[str, ...] = ("name",)) -> DataFrame:
    """Passed and failed executions with ``flip``: 1 where the outcome differs from the one before."""
    order = Window.partitionBy(*by).orderBy("started_at", "id")
    decided = rows.filter(F.col("status").isin("passed", "failed"))
    return decided.withColumn("flip", F.coalesce((F.col("status") != F.lag("status").over(order)).cast("int"), F.lit(0)))


def flaky_tests(executions: DataFrame, runs: DataFrame, last: int = 20, by: tuple[str, ...] = ("name",)) -> DataFrame:
    """Flaky tests over the latest ``last`` finished runs, the highest score first.

    Only the status, time and file columns are shuffled, by test; a test has one row for each execution in
    ``last`` runs. Tests of one name in several files are one test.
    """
    seen = flips(history(executions, runs, last).select(*by, "id", "started_at", "status", "file_path"), by)
    found = seen.groupBy(*by).agg(
        F.max_by("file_path", F.when(F.col("file_path") != "", F.struct("started_at", "id"))).alias("file_path"),
        F.sum("flip").alias("flip_count"),
        F.count("*").alias("total_runs"),
        F.sum((F.col("status") == "failed").cast("int")).alias("failures"),
        F.max(F.when(F.col("flip") == 1, F.col("started_at"))).alias("last_flipped_at"),
    )
    found = found.filter(F.col("total_runs") >= LEAST_RUNS).withColumn("flip_rate", F.col("flip_count") / (F.col("total_runs") - 1)).filter(F.col("flip_rate") >= LEAST_RATE)
    score = round2(clamp(FLIP_WEIGHT * F.col("flip_rate") + FAILURE_WEIGHT * (F.col("failures") / F.col("total_runs")), 0.0, 1.0))
    out = found.select(F.col("name").alias("test_name"), *[c for c in by if c != "name"], F.coalesce("file_path", F.lit("")).alias("file_path"), "flip_rate", "flip_count", "total_runs", score.alias("composite_score"), "last_flipped_at")
    return out.orderBy(F.desc("composite_score"), "test_name")
