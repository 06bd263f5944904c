"""What readers return: test cases with report rows, or covered files with report rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.scalars import percentage

CASE = ("doc", "pos", "id", "name", "full_name", "status", "duration_ms", "error_message", "file_path", "line", "retry_attempt")
KINDS = ("lines", "branches", "functions")
COUNTS = tuple(f"{k}_{c}" for k in KINDS for c in ("covered", "total"))


@dataclass(frozen=True)
class TestReports:
    """``cases`` (:data:`CASE`) and ``reports (doc, framework, passed, failed, skipped, flaky, total, duration_ms, metadata, error)``."""

    cases: DataFrame
    reports: DataFrame


@dataclass(frozen=True)
class CoverageReports:
    """``files (doc, pos, path, …)`` and ``reports (doc, format, …, error)`` with covered and total counts."""

    files: DataFrame
    reports: DataFrame


def case(**columns: Column) -> list[Column]:
    """The columns of a test case in order; those not given are null."""
    kinds = dict(pos="bigint", duration_ms="bigint", line="bigint", retry_attempt="int")
    return [columns.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in CASE]


def case_number(order: str) -> Column:
    return F.row_number().over(Window.partitionBy("doc").orderBy(order))


def summed(cases: DataFrame) -> DataFrame:
    """Counts of cases by status for each document; timed-out tests failed."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return cases.groupBy("doc").agg(is_("passed").alias("passed"), is_("failed", "timedOut").alias("failed"), is_("skipped").alias("skipped"), is_("flaky").alias("flaky"), F.count("*").alias("total"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("case_ms"))


def report(docs: DataFrame, counted: DataFrame, framework: Column, duration: Column, metadata: Column, missing: str | None) -> DataFrame:
    """Report rows of ``docs``; a document without cases has the error ``missing``."""
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("passed", "failed", "skipped", "flaky", "total")]
    none = F.when(F.coalesce(F.col("total"), F.lit(0)) == 0, F.lit(missing)) if missing else F.lit(None).cast("string")
    joined = docs.join(counted, "doc", "left")
    return joined.select("doc", framework.alias("framework"), *zero, duration.cast("bigint").alias("duration_ms"), metadata.alias("metadata"), none.alias("error"))


def events(cases: DataFrame) -> DataFrame:
    """Cases as rows of executions: full names, timed-out as failed, flaky as passed and marked."""
    status = F.when(F.col("status") == "timedOut", "failed").when(F.col("status") == "flaky", "passed").otherwise(F.col("status"))
    return cases.select("doc", "pos", F.col("full_name").alias("name"), status.alias("status"), F.coalesce(F.col("duration_ms").cast("double"), F.lit(0.0)).alias("duration_ms"), "file_path", "error_message", F.coalesce("retry_attempt", F.lit(0)).alias("retry_count"), (F.col("status") == "flaky").alias("flaky"))


def totals(files: DataFrame) -> DataFrame:
    return files.groupBy("doc").agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTS], F.count("*").alias("n_files"))


def with_percentages(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"{k}_percent": percentage(F.col(f"{k}_covered"), F.col(f"{k}_total")) for k in KINDS})


def stored_files(files: DataFrame) -> DataFrame:
    """``doc, data``: the files as the JSON that the coverage table stores, without percentages."""
    metric = lambda k: F.struct(F.col(f"{k}_covered").alias("covered"), F.col(f"{k}_total").alias("total")).alias(k)
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.struct("path", *map(metric, KINDS)).alias("f"))))
    return files.groupBy("doc").agg(F.to_json(F.transform(ordered, lambda x: x["f"])).alias("data"))
