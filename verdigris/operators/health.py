"""Health: one score of a run from its pass rate, flaky tests and trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.scalars import clamp, health_label
from verdigris.operators.flaky import flaky_tests
from verdigris.operators.tables import finished, latest_finished

#: Weights of the pass rate, of stability and of the trend; points of a trend; points that count as a change.
PASS_WEIGHT, STABLE_WEIGHT, TREND_WEIGHT, TREND_POINTS, CHANGE = 0.6, 0.3, 0.1, {"improving": 100.0, "stable": 50.0, "declining": 0.0}, 2


def score(total: Column, passed: Column, flaky: Column, previous: Column) -> dict[str, Column]:
    """``score, label, trend, previous_score`` of a run; a run without tests scores 0."""
    part = lambda n: n / F.nullif(total, F.lit(0)) * 100
    base = PASS_WEIGHT * part(passed) + STABLE_WEIGHT * (100 - part(flaky))
    neutral = F.round(clamp(base + TREND_WEIGHT * TREND_POINTS["stable"], 0.0, 100.0))
    trend = F.when(neutral - previous > CHANGE, "improving").when(neutral - previous < -CHANGE, "declining").otherwise("stable")
    bonus = F.when(trend == "improving", TREND_POINTS["improving"]).when(trend == "declining", TREND_POINTS["declining"]).otherwise(TREND_POINTS["stable"])
    final = F.when(total == 0, 0.0).otherwise(F.round(clamp(base + TREND_WEIGHT * bonus, 0.0, 100.0)))
    return {"score": final, "label": health_label(final), "trend": F.when(total == 0, "stable").otherwise(trend), "previous_score": F.when(total == 0, None).otherwise(previous)}


def alone(total: Column, passed: Column) -> Column:
    """A run's score as the next run's previous one: no flaky tests, no trend, not rounded; null without tests."""
    return F.when(total > 0, clamp(passed / F.nullif(total, F.lit(0)) * 100 * PASS_WEIGHT + 100 * STABLE_WEIGHT + TREND_WEIGHT * TREND_POINTS["stable"], 0.0, 100.0))


def previous_scores(runs: DataFrame) -> DataFrame:
    """``id, previous_score``: for each finished run, that of the finished run before it.

    Runs are the small side of this data, a row for each run of a whole suite; give ``branch`` or another
    key to :func:`by_run` to part them.
    """
    order = Window.orderBy("started_at", "id")
    return finished(runs).select("id", F.lag(alone(F.col("total"), F.col("passed"))).over(order).alias("previous_score"))


def by_run(executions: DataFrame, runs: DataFrame) -> DataFrame:
    """Health of every finished run against the one before it; flaky tests are those of the latest runs."""
    flaky = flaky_tests(executions, runs).agg(F.count("*")).scalar()
    rows = finished(runs).select("id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("passed", F.lit(0)).alias("passed"))
    joined = rows.join(previous_scores(runs), "id").withColumn("flaky_tests", flaky)
    return joined.select("id", *[c.alias(n) for n, c in score(F.col("total"), F.col("passed"), F.col("flaky_tests"), F.col("previous_score")).items()])


def latest(executions: DataFrame, runs: DataFrame) -> DataFrame:
    """Health of the latest finished run; the run before it is the latest other finished one."""
    now = latest_finished(runs).select("id")
    return by_run(executions, runs).join(F.broadcast(now), "id", "left_semi")
