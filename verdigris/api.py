"""The engine: records runs, analyses them when they end, and answers queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import clusters, compare, durations, flaky, health, payload, tables
from verdigris.operators.store import Store
from verdigris.operators.uploads import ACCEPTED, MAX_ATTEMPTS, TIMEOUT, sent
from verdigris.sources import registry as formats
from verdigris.sources.reports import CoverageReports, TestReports, events, stored_files
from verdigris.steps import drop, saved

#: Uploads whose outcomes are written at once.
SETTLED = 100


def now() -> str:
    return datetime.now(UTC).isoformat()


class Engine:
    """Test analytics over one store. Queries return DataFrames."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store, self.formats = spark, Store(spark, root), formats.with_defaults()

    def start_run(self, framework: str = "cli", branch: str | None = None, commit_sha: str | None = None, ci_provider: str | None = None, started_at: str | None = None) -> str:
        run_id = str(uuid.uuid4())
        self.store.insert_run(run_id, framework, started_at or now(), branch, commit_sha, ci_provider)
        return run_id

    def record_tests(self, run_id: str, tests: DataFrame) -> None:
        self.store.insert_tests(run_id, tests)

    def _one(self, content: str, filename: str, missing: str) -> tuple[DataFrame, str]:
        files = self.spark.createDataFrame([(filename, filename, content)], "doc string, filename string, content string")
        found = self.formats.detect(files).select("format.id").first()
        if found["id"] is None:
            raise ValueError(missing)
        return files.select("doc", "content"), found["id"]

    def parse_report(self, content: str, filename: str) -> TestReports:
        """A test report by its detected format."""
        docs, id_ = self._one(content, filename, formats.NO_PARSER)
        got = self.formats.get(id_).read(docs)
        if isinstance(got, CoverageReports):
            raise ValueError("".join(id_ if x == "id" else x for x in formats.NOT_TESTS))
        return got

    def parse_coverage(self, content: str, filename: str) -> CoverageReports:
        docs, id_ = self._one(content, filename, formats.NO_COVERAGE_PARSER)
        got = self.formats.get(id_).read(docs)
        if isinstance(got, TestReports):
            raise ValueError(formats.NOT_COVERAGE)
        return got

    def record_reports(self, run_id: str, files: DataFrame) -> None:
        """All test reports among ``files (doc, filename, content)``; files of no format are left out."""
        known = self.formats.detect(files).persist()  # read once, for all formats
        try:
            self.record_tests(run_id, events(formats.test_cases(known, self.formats)))
        finally:
            known.unpersist()

    def record_coverage(self, run_id: str, content: str, filename: str) -> DataFrame:
        got = self.parse_coverage(content, filename)
        self.store.insert_coverage(run_id, got.reports.drop("doc", "error"), stored_files(got.files), now())
        return self.coverage(run_id)

    def end_run(self, run_id: str, summary: dict | None = None, finished_at: str | None = None, upload: bool = False) -> dict[str, DataFrame]:
        """Finish a run, then give its summary, intelligence and health; queue its payload and clean up."""
        if summary is None:
            row = tables.run_summary(self.store.read("test_executions").filter(F.col("run_id") == run_id)).first()
            summary = {c: row[c] for c in ("total", "passed", "failed", "skipped", "duration_ms")} if row else dict(total=0, passed=0, failed=0, skipped=0, duration_ms=0.0)
        self.store.finish_run(run_id, summary, finished_at or now())
        if upload:
            te, tr, cov = (self.store.read(t).filter(F.col(c) == run_id) for t, c in (("test_executions", "run_id"), ("test_runs", "id"), ("coverage_reports", "run_id")))
            self.store.enqueue(run_id, payload.ingest_payload(tr, te, cov), now())
        self.store.clean_up()
        return {"run": tables.run_by_id(self.store.read("test_runs"), run_id), "health": self.health(run_id), **self.intelligence(run_id)}

    def _history(self) -> tuple[DataFrame, DataFrame]:
        return self.store.read("test_executions"), self.store.read("test_runs")

    def intelligence(self, run_id: str | None = None) -> dict[str, DataFrame]:
        """Flaky tests of the latest runs; clusters and durations of one run, the latest by default."""
        te, tr = self._history()
        chosen = tables.latest_finished(tr).select(F.col("id").alias("run_id")) if run_id is None else tr.filter(F.col("id") == run_id).select(F.col("id").alias("run_id"))
        mine = te.join(F.broadcast(chosen), "run_id", "left_semi")
        recent = tables.history(te, tr).join(F.broadcast(chosen), "run_id", "left_semi")
        return {"flaky_tests": flaky.flaky_tests(te, tr), "failure_clusters": clusters.ordered(clusters.clusters(mine.filter("status = 'failed'"))), "durations": durations.percentiles(recent), "slowest": durations.slowest(recent)}

    def health(self, run_id: str | None = None) -> DataFrame:
        found = health.latest(*self._history()) if run_id is None else health.by_run(*self._history()).filter(F.col("id") == run_id)
        return found

    def flaky(self) -> DataFrame:
        return flaky.flaky_tests(*self._history())

    def slowest(self, limit: int = 10) -> DataFrame:
        """The latest run's slowest tests; that run must have tests."""
        last = tables.history(*self._history(), 1)
        if last.isEmpty():
            raise ValueError("No test data found")
        return durations.slowest(last, limit)

    def runs(self, limit: int = tables.RECENT_RUNS) -> DataFrame:
        return tables.recent_runs(self.store.read("test_runs"), limit)

    def history(self, pattern: str, limit: int = tables.LISTED) -> DataFrame:
        return tables.test_history(*self._history(), pattern, limit)

    def failures(self, pattern: str, limit: int = tables.LISTED) -> DataFrame:
        return tables.search_failures(*self._history(), pattern, limit)

    def coverage(self, run_id: str) -> DataFrame:
        return tables.latest_coverage(self.store.read("coverage_reports").filter(F.col("run_id") == run_id))

    def compare(self, run_id: str, branch: str) -> DataFrame:
        te, tr = self._history()
        return compare.compare(te, tr, branch, tr.filter(F.col("id") == run_id))

    def sync(self, send: Callable[[str], int]) -> tuple[int, int]:
        """Send queued payloads one by one; ``send`` returns a status code. Gives how many went and failed.

        Only 201 and 202 are accepted; after five attempts an upload is left alone. Outcomes are written SETTLED
        at a time: if the driver dies in between, up to so many uploads are sent again.
        """
        went, failed, counts = [], [], [0, 0]

        def settle() -> None:
            if went or failed:
                self.store.settle(went, failed, now())
                counts[:] = counts[0] + len(went), counts[1] + len(failed)
                went.clear()
                failed.clear()

        for row in tables.pending(self.store.read("pending_uploads"), MAX_ATTEMPTS).toLocalIterator():
            try:
                code, error = send(row["payload"]), ""
            except OSError as e:
                code, error = 0, str(e)
            if code in ACCEPTED:
                went.append((row["id"], row["run_id"]))
            else:
                failed.append((row["id"], error or f"HTTP {code}"))
            if len(went) + len(failed) >= SETTLED:
                settle()
        settle()
        return counts[0], counts[1]

    def upload(self, url: str, token: str | None = None, timeout: float = TIMEOUT) -> tuple[int, int]:
        """Post queued payloads to ``url`` from the executors; gives how many went and failed.

        What was sent is written once, and the queue is settled from there; the rules are those of :meth:`sync`.
        """
        outcomes = saved(sent(tables.pending(self.store.read("pending_uploads"), MAX_ATTEMPTS), url, token, timeout))
        counts = outcomes.agg(F.count_if("accepted").alias("went"), F.count_if(~F.col("accepted")).alias("failed")).first()
        self.store.settle_outcomes(outcomes, now())
        drop(outcomes)
        return counts["went"], counts["failed"]

    def run_document(self, run_id: str, branch: str | None = None, context: DataFrame | None = None, synced: tuple[int, int] | None = None) -> DataFrame:
        """``json``: one document of a run with all that is known of it, parts without rows left out.

        ``branch`` adds the comparison with it, ``context (path)`` the files that changed, ``synced`` what
        :meth:`sync` gave.
        """
        te, tr = self._history()
        run = tables.run_by_id(tr, run_id)
        compared = None if branch is None else compare.compare(te, tr, branch, run)
        return payload.run_document(run_id, run, tables.failed_tests(te, run_id), self.health(run_id), self.intelligence(run_id), self.coverage(run_id), compared, context, synced)
