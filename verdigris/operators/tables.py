"""Reading the normalised tables: runs, histories, searches and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.scalars import contains_text

#: Finished runs that analytics look back on; default lengths of listings.
HISTORY_RUNS, RECENT_RUNS, LISTED = 20, 20, 50


def newest(order: str = "started_at") -> list[Column]:
    """Latest first; ids part equal times."""
    return [F.desc(order), F.desc("id")]


def finished(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status") == "finished")


def recent_runs(runs: DataFrame, limit: int = RECENT_RUNS) -> DataFrame:
    """The latest finished runs with counts that default to 0."""
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "passed", "failed", "skipped")]
    top = finished(runs).orderBy(*newest()).limit(limit)
    return top.select("id", "branch", "commit_sha", "framework", "started_at", F.coalesce("finished_at", "started_at").alias("finished_at"), *zero, F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"))


def history(executions: DataFrame, runs: DataFrame, last: int = HISTORY_RUNS) -> DataFrame:
    """Executions of the latest ``last`` finished runs with the run's start.

    The runs are ``last`` rows, so the executions are filtered by a broadcast of them and never shuffled.
    """
    top = finished(runs).orderBy(*newest()).limit(last).select(F.col("id").alias("run_id"), "started_at")
    return executions.join(F.broadcast(top), "run_id").withColumns({"file_path": F.coalesce("file_path", F.lit("")), "error_message": F.coalesce("error_message", F.lit(""))})


def ordered_history(executions: DataFrame, runs: DataFrame, last: int = HISTORY_RUNS) -> DataFrame:
    return history(executions, runs, last).orderBy("started_at", "name", "id")


def _listed(found: DataFrame, limit: int) -> DataFrame:
    return found.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def _with_run(executions: DataFrame, runs: DataFrame) -> DataFrame:
    return executions.join(runs.select(F.col("id").alias("run_id"), "branch", "commit_sha", "started_at"), "run_id")


def test_history(executions: DataFrame, runs: DataFrame, pattern: str, limit: int = LISTED) -> DataFrame:
    """Executions whose name contains ``pattern``, the latest first."""
    found = _with_run(executions.filter(contains_text(F.col("name"), pattern)), runs)
    return _listed(found, limit).select("id", "run_id", "name", "status", "duration_ms", "error_message", "branch", "commit_sha", "started_at")


def search_failures(executions: DataFrame, runs: DataFrame, pattern: str, limit: int = LISTED) -> DataFrame:
    """Failed executions whose name or error contains ``pattern``, the latest first."""
    hit = contains_text(F.col("name"), pattern) | contains_text(F.col("error_message"), pattern)
    found = _with_run(executions.filter((F.col("status") == "failed") & hit), runs)
    return _listed(found, limit).select("id", "run_id", "name", "file_path", "error_message", "duration_ms", "branch", "started_at")


def failed_tests(executions: DataFrame, run_id: str | None = None) -> DataFrame:
    """Failed executions of one run, or of all runs, in the order of their ids."""
    rows = executions.filter(F.col("status") == "failed")
    rows = rows if run_id is None else rows.filter(F.col("run_id") == run_id)
    return rows.select("run_id", "id", "name", F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("error_message", F.lit("")).alias("error_message"), "duration_ms").orderBy("run_id", "id")


def executions_of(executions: DataFrame, run_id: str) -> DataFrame:
    return executions.filter(F.col("run_id") == run_id).orderBy("id")


def last_status(executions: DataFrame, by: tuple[str, ...] = ("run_id", "name")) -> DataFrame:
    """The status of each test's last execution in a run."""
    return executions.groupBy(*by).agg(F.max_by("status", "id").alias("status"))


def run_summary(executions: DataFrame) -> DataFrame:
    """Counts of each run; what neither passed nor failed is skipped."""
    counts = executions.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("duration_ms").alias("duration_ms"))
    return counts.withColumn("skipped", F.col("total") - F.col("passed") - F.col("failed"))


def status_counts(executions: DataFrame) -> DataFrame:
    return executions.groupBy("run_id", "status").agg(F.count("*").alias("n"))


def latest_per_branch(runs: DataFrame) -> DataFrame:
    """The latest finished run with counts of each branch."""
    usable = finished(runs).filter(F.col("total").isNotNull())
    return usable.groupBy("branch").agg(F.max_by(F.struct("id", "started_at", "total", "passed", "failed", "skipped", "duration_ms"), F.struct("started_at", "id")).alias("r")).select("branch", "r.*")


def latest_finished(runs: DataFrame) -> DataFrame:
    return finished(runs).orderBy(*newest()).limit(1)


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.filter(F.col("id") == run_id).limit(1)


def latest_coverage(coverage: DataFrame, by: str = "run_id") -> DataFrame:
    """The latest coverage row of each run."""
    cols = [c for c in coverage.columns if c != by]
    return coverage.groupBy(by).agg(F.max_by(F.struct(*cols), F.struct("created_at", "id")).alias("r")).select(by, "r.*")


def coverage_files(coverage: DataFrame) -> DataFrame:
    """``run_id`` and one row for each file of its latest coverage."""
    metrics = "struct<covered: int, total: int>"
    kind = f"array<struct<path: string, lines: {metrics}, branches: {metrics}, functions: {metrics}>>"
    files = latest_coverage(coverage).select("run_id", F.explode(F.from_json("data", kind)).alias("f"))
    return files.select("run_id", "f.*")


def pending(uploads: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Uploads with attempts left, the oldest first."""
    return uploads.filter(F.col("attempts") < max_attempts).orderBy("created_at", "id")


#: Rows that are numbered together; leading characters by which reports are put into ranges.
NUMBERED, HEAD = 1 << 16, 48


def numbered(rows: DataFrame, first: int = 1) -> DataFrame:
    """``rows`` with ``id``, numbers from ``first`` on in the order of ``doc`` (where there is one) and ``pos``.

    Rows are numbered within ranges of positions of a document, and each range starts where those before it
    end; only counts by range are ordered as a whole.
    """
    by = ["doc", "part"] if "doc" in rows.columns else ["part"]
    rows = rows.withColumn("part", F.floor(F.col("pos") / NUMBERED))
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    # two levels, so that no task orders the counts of all reports: ranges of leading characters, then within each
    head = F.coalesce(F.substring("doc", 1, HEAD), F.lit("")) if "doc" in by else F.floor(F.col("part") / NUMBERED)
    counts = counts.withColumn("head", head)
    before = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.groupBy("head").agg(F.sum("n").alias("held")).withColumn("ahead", F.coalesce(F.sum("held").over(before("head")), F.lit(0))).drop("held")
    inside = Window.partitionBy("head").orderBy(*[F.col(c) for c in by]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(heads, "head")
    starts = starts.select(*[F.col(c).alias(f"start_{c}") for c in by], (F.col("ahead") + F.col("start") + first).alias("start"))
    same = [F.col(c).eqNullSafe(F.col(f"start_{c}")) for c in by]
    within = F.row_number().over(Window.partitionBy(*by).orderBy("pos")) - 1
    return rows.withColumn("id", within).join(starts, same).withColumn("id", (F.col("start") + F.col("id")).cast("bigint")).drop("part", "start", *[f"start_{c}" for c in by])
