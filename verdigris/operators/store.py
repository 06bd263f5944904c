"""The tables as Parquet folders, partitioned by run.

Every row belongs to a run, so each change rewrites the partitions of the runs it touches and no others, by Spark's
dynamic partition overwrite, and readers of some runs prune the rest. Writers of different runs don't meet. A change
of several tables writes children before the run's own row and deletes in that order too, so one that dies half-way
is done by repeating it. Ids come in ranges, each claimed by making a file that only one writer can make.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris import schemas
from verdigris.operators import payload, retention, tables
from verdigris.steps import drop, saved

_VERSION = "schema_version"
#: Ids in a range.
RANGE = 1 << 32


def run_column(table: str) -> str:
    return "id" if table == "test_runs" else "run_id"


class Store:
    """Tables of :data:`schemas.TABLES` below one folder; made if absent."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.migrate()

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _partition(self, table: str, run_id: str):
        named = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run_id)
        return self._path(f"{self.root}/{table}/{run_column(table)}={named}")

    def migrate(self) -> int:
        """Create missing tables and bring the schema version up to date; safe to repeat.

        Columns that a version adds need no rewrite: files without them read as 0.
        """
        for table in schemas.TABLES:
            self._fs.mkdirs(self._path(f"{self.root}/{table}"))
        if self.version() < schemas.LATEST_VERSION:
            rows = self.spark.createDataFrame([(v,) for v in schemas.ADDED], "version int").withColumn("applied_at", F.current_timestamp().cast("string"))
            rows.coalesce(1).write.mode("append").parquet(f"{self.root}/{_VERSION}")
        return self.version()

    def version(self) -> int:
        path = f"{self.root}/{_VERSION}"
        return (self.spark.read.schema(schemas.SCHEMA_VERSION).parquet(path).agg(F.max("version")).first()[0] or 0) if self._fs.exists(self._path(path)) else 0

    def read(self, table: str) -> DataFrame:
        """A table's rows; columns that a later version added are 0 in older files."""
        added = {c for tables_ in schemas.ADDED.values() for c in tables_.get(table, ())}
        rows = self.spark.read.schema(schemas.TABLES[table]).parquet(f"{self.root}/{table}")
        return rows.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in added else F.col(c) for c in schemas.TABLES[table].names])

    def write(self, table: str, rows: DataFrame, mode: str = "overwrite") -> None:
        """Make these rows the partitions of their runs, or with ``append`` add them; other runs stay as they are."""
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.TABLES[table]])
        typed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(run_column(table)).parquet(f"{self.root}/{table}")

    def delete(self, table: str, run_id: str) -> None:
        self._fs.delete(self._partition(table, run_id), True)

    def claim(self, table: str) -> int:
        """The first of :data:`RANGE` ids that no other writer gets; later claims are larger."""
        folder = f"{self.root}/ids/{table}"
        self._fs.mkdirs(self._path(folder))
        number = max([int(x.getPath().getName()) for x in self._fs.listStatus(self._path(folder))], default=-1) + 1
        while not self._fs.createNewFile(self._path(f"{folder}/{number}")):
            number += 1
        self._fs.delete(self._path(f"{folder}/{number - 2}"), False)  # the largest ones are enough
        return number * RANGE + 1

    def insert_run(self, run_id: str, framework: str, started_at: str, branch: str | None = None, commit_sha: str | None = None, ci_provider: str | None = None) -> None:
        """A running run; ids are unique."""
        if not run_id or self._fs.exists(self._partition("test_runs", run_id)):
            raise ValueError(f"run {run_id} exists" if run_id else "a run has an id")
        row = (run_id, branch, commit_sha, ci_provider, framework, started_at, None, "running", None, None, None, None, None, None)
        self.write("test_runs", self.spark.createDataFrame([row], schemas.TEST_RUNS).coalesce(1), "append")

    def insert_tests(self, run_id: str, tests: DataFrame) -> None:
        """Executions ``name, status, duration_ms[, file_path, error_message, retry_count, flaky][, doc][, pos]`` of a run.

        Ids go on from the largest so far, report after report (``doc``) and in the order of ``pos``. Without
        ``pos`` they are in the order in which the rows come. A status outside the closed set fails the write.
        """
        missing = {"file_path": "string", "error_message": "string", "retry_count": "int", "flaky": "boolean"}
        rows = tests.withColumns({c: F.lit(None).cast(k) for c, k in missing.items() if c not in tests.columns})
        valid = F.col("status").isin(*schemas.STATUSES)
        rows = rows.withColumn("status", F.when(valid, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("Invalid test status: "), F.coalesce("status", F.lit("null"))))))
        if "pos" not in tests.columns:
            rows = rows.withColumn("pos", F.monotonically_increasing_id())
        rows = tables.numbered(rows, self.claim("test_executions"))
        self.write("test_executions", rows.withColumns({"run_id": F.lit(run_id), "retry_count": F.coalesce("retry_count", F.lit(0)), "flaky": F.coalesce("flaky", F.lit(False))}), "append")

    def finish_run(self, run_id: str, summary: dict, finished_at: str) -> None:
        """Set a running run's counts and end; there must be one."""
        run = self._run(run_id).filter(F.col("status") == "running")
        if run.isEmpty():
            raise ValueError(f"no running run {run_id}")
        new = {"status": "finished", "finished_at": finished_at, **summary}
        self.write("test_runs", run.withColumns({c: F.lit(v) for c, v in new.items()}))

    def update_framework(self, run_id: str, framework: str) -> None:
        self.write("test_runs", self._run(run_id).withColumn("framework", F.lit(framework)))

    def _run(self, run_id: str) -> DataFrame:
        return self.read("test_runs").filter(F.col("id") == run_id).coalesce(1)

    def insert_coverage(self, run_id: str, report: DataFrame, files: DataFrame | None, created_at: str) -> None:
        """One coverage row from a report row ``format, *_covered, *_total``; the run's rows all get the files' JSON."""
        row = report.limit(1).withColumns({"id": F.lit(self.claim("coverage_reports")), "run_id": F.lit(run_id), "data": F.lit(None).cast("string"), "created_at": F.lit(created_at)})
        self.write("coverage_reports", row, "append")
        if files is not None:
            data = files.select(F.col("data").alias("new_data")).limit(1)
            rows = self.read("coverage_reports").filter(F.col("run_id") == run_id).join(F.broadcast(data), F.lit(True), "left")
            self.write("coverage_reports", rows.withColumn("data", F.coalesce("new_data", "data")))

    def enqueue(self, run_id: str, document: DataFrame, created_at: str) -> int:
        """Queue a run's payload (``payload``, one row) and return its id."""
        new = self.claim("pending_uploads")
        row = document.limit(1).select(F.lit(new).alias("id"), F.lit(run_id).alias("run_id"), "payload", F.lit(created_at).alias("created_at"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"))
        self.write("pending_uploads", row, "append")
        return new

    def mark_synced(self, upload_id: int, run_id: str, at: str) -> None:
        """Drop an accepted upload and mark its run."""
        self.settle([(upload_id, run_id)], [], at)

    def record_failure(self, upload_id: int, error: str) -> None:
        self.settle([], [(upload_id, error)], None)

    def settle(self, accepted: list[tuple[int, str]], failed: list[tuple[int, str]], at: str | None) -> None:
        """:meth:`settle_outcomes` of accepted uploads ``(id, run_id)`` and failed ones ``(id, error)``."""
        rows = [(i, True, None) for i, _ in accepted] + [(i, False, e) for i, e in failed]
        self.settle_outcomes(self.spark.createDataFrame(rows, "id bigint, accepted boolean, error string"), at)

    def settle_outcomes(self, outcomes: DataFrame, at: str | None) -> None:
        """Mark runs of accepted uploads and drop these, and count failed attempts: ``outcomes (id, accepted, error)``.

        Only partitions of the runs that have outcomes are written. Runs are marked first: what is sent again
        after a crash is marked again.
        """
        queue = self.read("pending_uploads")
        touched = queue.join(outcomes.select("id", "accepted", "error"), "id").select("run_id", "id", "accepted", "error")
        owners = {r["run_id"]: r["any"] for r in touched.groupBy("run_id").agg(F.bool_or("accepted").alias("any")).toLocalIterator()}
        if not owners:
            return
        of_owners = queue.join(touched.select("run_id").distinct(), "run_id", "left_semi")
        done = touched.filter("accepted").select("id", "run_id")
        runs = self.read("test_runs").join(done.select(F.col("run_id").alias("id")).distinct(), "id", "left_semi")
        left, marked = payload.synced(of_owners, runs, done, at)
        left = saved(payload.attempted(left, touched.filter("NOT accepted")).select(*schemas.PENDING_UPLOADS.names))
        if any(owners.values()):
            self.write("test_runs", marked)
        self.write("pending_uploads", left)
        for run_id in owners.keys() - {r["run_id"] for r in left.select("run_id").distinct().toLocalIterator()}:
            self.delete("pending_uploads", run_id)
        drop(left)

    def clean_up(self, max_runs: int = retention.MAX_RUNS, before: str | None = None) -> int:
        """Drop expired runs and all rows that belong to them; returns how many runs went.

        A run's own row goes last, so what a crash leaves is dropped the next time.
        """
        gone = 0
        for run in retention.expired(self.read("test_runs"), max_runs, before).select("id").toLocalIterator():
            for table in reversed(schemas.TABLES):
                self.delete(table, run["id"])
            gone += 1
        return gone
