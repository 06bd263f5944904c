"""Export documents: nested rows and their JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.tables import coverage_files, latest_coverage


def _metrics(kind: str):
    return F.struct(F.col(f"{kind}_covered").alias("covered"), F.col(f"{kind}_total").alias("total")).alias(kind)


def ingest_payload(runs: DataFrame, executions: DataFrame, coverage: DataFrame) -> DataFrame:
    """``run_id, payload``: one nested document for each run that has ended, fields without value left out.

    Tests come in the order of their ids; coverage is the run's latest, with its files if stored.
    """
    tests = executions.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("id", "name", "status", "duration_ms", "file_path", "error_message", "retry_count", "flaky"))).alias("tests"))
    test = lambda t: F.struct(t["name"].alias("name"), t["status"].alias("status"), t["duration_ms"].alias("durationMs"), t["file_path"].alias("filePath"), t["error_message"].alias("error"), t["retry_count"].alias("retryCount"), t["flaky"].alias("flaky"))
    kinds = ("lines", "branches", "functions")
    files = coverage_files(coverage).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("path", *kinds))).alias("files"))
    none = F.array().cast("array<struct<path: string, lines: struct<covered: int, total: int>, branches: struct<covered: int, total: int>, functions: struct<covered: int, total: int>>>")
    covered = latest_coverage(coverage).join(files, "run_id", "left").select("run_id", F.struct("format", *map(_metrics, kinds), F.coalesce("files", none).alias("files")).alias("coverage"))
    empty = F.array().cast("array<struct<id: bigint, name: string, status: string, duration_ms: double, file_path: string, error_message: string, retry_count: int, flaky: boolean>>")
    ended = runs.filter(F.col("finished_at").isNotNull()).withColumnRenamed("id", "run_id")
    joined = ended.join(tests, "run_id", "left").join(covered, "run_id", "left")
    zero = lambda c, to=0: F.coalesce(c, F.lit(to))
    document = F.struct(
        F.col("run_id").alias("runId"), "framework", "branch", F.col("commit_sha").alias("commitSha"), F.col("ci_provider").alias("ciProvider"), F.col("started_at").alias("startedAt"), F.col("finished_at").alias("finishedAt"),
        F.struct(*[zero(c).alias(c) for c in ("total", "passed", "failed", "skipped")], zero("duration_ms", 0.0).alias("durationMs")).alias("summary"),
        F.transform(F.coalesce("tests", empty), test).alias("tests"), "coverage",
    )
    return joined.select("run_id", F.to_json(document).alias("payload"))


def documents(rows: DataFrame) -> DataFrame:
    """Query results as JSON, one document a row, absent values written as null."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def run_document(run_id: str, run: DataFrame, failures: DataFrame, health: DataFrame, intelligence: dict[str, DataFrame], coverage: DataFrame, comparison: DataFrame | None = None, context: DataFrame | None = None, synced: tuple[int, int] | None = None) -> DataFrame:
    """``json``: one run as one document, its ``summary`` and ``failures`` and, where there are any, its ``health``,
    ``intelligence``, ``coverage``, ``sync``, ``comparison`` and ``context_files``. Its size is that of one run.
    """
    key = F.lit(run_id).alias("run_id")

    def one(rows: DataFrame, name: str, *columns) -> DataFrame:
        """``run_id`` with the first row as a struct."""
        return rows.limit(1).select(key, F.struct(*(columns or rows.columns)).alias(name))

    def many(rows: DataFrame, name: str, *order: str) -> DataFrame:
        """``run_id`` with all rows as a list, an empty one where there are none."""
        ordered = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), F.struct(*rows.columns).alias("row"))))
        return rows.agg(F.transform(ordered, lambda x: x["row"]).alias(name)).select(key, name)

    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "passed", "failed", "skipped")]
    failed = failures.withColumn("file", F.nullif("file_path", F.lit(""))).withColumn("error", F.nullif("error_message", F.lit("")))
    found = one(run, "summary", *zero, F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"))
    found = found.join(many(failed.select("id", "name", "file", "error", "duration_ms"), "failures", "id"), "run_id")
    found = found.withColumn("failures", F.transform("failures", lambda f: f.dropFields("id")))
    parts = [one(health, "health"), one(coverage.drop("run_id", "data"), "coverage")]
    parts += [one(comparison, "comparison")] if comparison is not None else []
    parts += [many(rows, name, *_ORDER[name]()) for name, rows in intelligence.items()]
    for part in parts:
        found = found.join(part, "run_id", "left")
    names = list(intelligence)
    found = found.withColumn("intelligence", F.struct(*names)).drop(*names)
    if context is not None:
        found = found.join(context.agg(F.array_sort(F.collect_list("path")).alias("context_files")).select(key, "context_files"), "run_id", "left")
        found = found.withColumn("context_files", F.when(F.size("context_files") > 0, F.col("context_files")))
    if synced is not None:
        found = found.withColumn("sync", F.struct(F.lit(synced[0]).alias("synced"), F.lit(synced[1]).alias("failed")))
    return found.select(F.to_json(F.struct(*[c for c in found.columns if c != "run_id"])).alias("json"))


#: How the lists of a run's intelligence are ordered.
_ORDER = {
    "flaky_tests": lambda: [-F.col("composite_score"), F.col("test_name")],
    "failure_clusters": lambda: [-F.col("count"), F.col("silent"), F.col("first")],
    "durations": lambda: [F.col("run_id")],
    "slowest": lambda: [F.col("rank"), F.col("test_name")],
}


def attempted(uploads: DataFrame, failures: DataFrame) -> DataFrame:
    """Uploads after failed attempts: ``failures (id, error)`` add one attempt each and leave the last error."""
    tried = failures.groupBy("id").agg(F.count("*").alias("more"), F.max("error").alias("error"))
    return uploads.join(tried, "id", "left").select(*[c for c in uploads.columns if c not in ("attempts", "last_error")], (F.col("attempts") + F.coalesce("more", F.lit(0))).cast("int").alias("attempts"), F.coalesce("error", "last_error").alias("last_error"))


def synced(uploads: DataFrame, runs: DataFrame, done: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Uploads left and runs marked, after ``done (id, run_id)`` were accepted."""
    marked = runs.join(done.select(F.col("run_id").alias("id"), F.lit(at).alias("now")).distinct(), "id", "left")
    return uploads.join(done.select("id"), "id", "left_anti"), marked.withColumn("synced_at", F.coalesce("now", "synced_at")).select(*runs.columns)
