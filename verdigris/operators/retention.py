"""Retention: runs to drop, and the rows that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_RUNS, MAX_DAYS = 100, 90


def cutoff(days: int = MAX_DAYS) -> str:
    """The text of the moment ``days`` before now, which start times are compared with as text."""
    from datetime import UTC, datetime, timedelta

    return (datetime.now(UTC) - timedelta(days=days)).strftime("%Y-%m-%d %H:%M:%S")


def expired(runs: DataFrame, max_runs: int = MAX_RUNS, before: str | None = None) -> DataFrame:
    """Runs beyond the newest ``max_runs`` of any status that also started before ``before``."""
    newest = runs.orderBy(F.desc("started_at"), F.desc("id")).limit(max_runs).select("id")
    old = runs.filter(F.col("started_at") < (before or cutoff()))
    return old.join(F.broadcast(newest), "id", "left_anti")


def survivors(runs: DataFrame, max_runs: int = MAX_RUNS, before: str | None = None) -> DataFrame:
    return runs.join(expired(runs, max_runs, before).select("id"), "id", "left_anti")


def cascade(children: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of ``children`` whose run is among ``runs``."""
    return children.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")


def ranked(runs: DataFrame) -> DataFrame:
    return runs.withColumn("age_rank", F.row_number().over(Window.orderBy(F.desc("started_at"), F.desc("id"))))
