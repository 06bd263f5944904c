"""Comparison of runs with a baseline branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.scalars import pass_rate
from verdigris.operators.tables import finished, last_status

COUNTS = ("total", "passed", "failed", "skipped", "duration_ms")


def baselines(runs: DataFrame, branch: str, current: DataFrame | None = None) -> DataFrame:
    """``run_id, baseline_run_id`` and both runs' counts: for each current run the latest other finished run of ``branch``.

    Only the two latest runs of the branch can be a baseline: the second serves the latest itself.
    """
    current = finished(runs) if current is None else current
    top = finished(runs).filter((F.col("branch") == branch) & F.col("total").isNotNull()).orderBy(F.desc("started_at"), F.desc("id")).limit(2)
    base = top.select(F.col("id").alias("baseline_run_id"), F.col("started_at").alias("base_started_at"), *[F.col(c).alias(f"base_{c}") for c in COUNTS])
    pairs = current.select(F.col("id").alias("run_id"), *COUNTS).join(F.broadcast(base), F.col("run_id") != F.col("baseline_run_id"))
    picked = F.max_by(F.struct(*base.columns), F.struct("base_started_at", "baseline_run_id")).alias("b")
    return pairs.groupBy("run_id", *COUNTS).agg(picked).select("run_id", *COUNTS, "b.*")


def changes(executions: DataFrame, pairs: DataFrame) -> DataFrame:
    """``run_id, name, kind`` of tests whose failures differ or persist: new, fixed, pre_existing.

    A test's last execution in a run decides; tests that the current run lacks are left out.
    """
    status = last_status(executions)
    now = status.join(pairs.select("run_id", "baseline_run_id"), "run_id")
    old = status.join(pairs.select("baseline_run_id").distinct(), F.col("run_id") == F.col("baseline_run_id"), "left_semi").select(F.col("run_id").alias("baseline_run_id"), "name", F.col("status").alias("old"))
    both = now.join(old, ["baseline_run_id", "name"], "left")
    fails, failed = F.col("status") == "failed", F.coalesce(F.col("old") == "failed", F.lit(False))
    kind = F.when(fails & ~failed, "new").when(fails & failed, "pre_existing").when(~fails & failed, "fixed")
    return both.withColumn("kind", kind).filter("kind is not null").select("run_id", "baseline_run_id", "name", "kind")


def deltas(pairs: DataFrame) -> DataFrame:
    """``pass_rate_delta, duration_delta, total_delta`` of each current run."""
    rate = pass_rate(F.col("passed"), F.col("total")) - pass_rate(F.col("base_passed"), F.col("base_total"))
    return pairs.select("run_id", "baseline_run_id", rate.alias("pass_rate_delta"), (F.col("duration_ms") - F.coalesce("base_duration_ms", F.lit(0.0))).alias("duration_delta"), (F.col("total") - F.col("base_total")).alias("total_delta"))


def compare(executions: DataFrame, runs: DataFrame, branch: str, current: DataFrame | None = None) -> DataFrame:
    """One row for each current run: sorted names of new failures, fixed and persisting tests, and the deltas."""
    pairs = baselines(runs, branch, current)
    names = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("name"))))
    lists = changes(executions, pairs).groupBy("run_id").agg(names("new").alias("new_failures"), names("fixed").alias("fixed"), names("pre_existing").alias("pre_existing_failures"))
    none = F.array().cast("array<string>")
    filled = [F.coalesce(c, none).alias(c) for c in ("new_failures", "fixed", "pre_existing_failures")]
    return deltas(pairs).withColumn("baseline_branch", F.lit(branch)).join(lists, "run_id", "left").select("run_id", "baseline_branch", "baseline_run_id", *filled, "pass_rate_delta", "duration_delta", "total_delta")
