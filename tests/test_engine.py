import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from threading import Thread

import pytest
from pyspark.sql import functions as F

from verdigris.api import Engine
from verdigris.operators.tables import history, numbered
from verdigris.schemas import TABLES
from verdigris.sources.registry import DEFAULT_PATTERNS, glob_pattern, read_files
from verdigris.streaming.ingest import failure_counts, ingest, report_stream


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"))


def rows(spark, *items):
    return spark.createDataFrame([(i, n, s, 1.0, e) for i, (n, s, e) in enumerate(items)], "pos int, name string, status string, duration_ms double, error_message string")


def test_a_run_from_start_to_end(spark, engine):
    base = engine.start_run(branch="main", started_at="2024-01-01T00:00:00+00:00")
    engine.record_tests(base, rows(spark, ("a", "passed", None), ("b", "failed", "boom")))
    engine.end_run(base)
    run = engine.start_run(branch="dev", started_at="2030-01-02T00:00:00+00:00")
    engine.record_tests(run, rows(spark, ("a", "failed", "bang"), ("b", "passed", None)))
    got = engine.end_run(run, upload=True)
    assert got["run"].first()["total"] == 2
    assert got["health"].first()["score"] == 65.0
    assert got["failure_clusters"].first()["test_names"] == ["a"]
    compared = engine.compare(run, "main").first()
    assert (compared["new_failures"], compared["fixed"]) == (["a"], ["b"])
    assert [r["id"] for r in engine.runs().collect()] == [run, base]
    assert engine.history("A").count() == 2 and engine.failures("boom").count() == 1
    assert engine.sync(lambda payload: 200) == (0, 1)
    assert engine.sync(lambda payload: 201) == (1, 0)
    assert engine.store.read("test_runs").filter("synced_at is not null").count() == 1


def test_uploads_are_left_alone_after_five_attempts(spark, engine):
    run = engine.start_run()
    engine.store.enqueue(run, spark.createDataFrame([("{}",)], "payload string"), "2024")
    for _ in range(5):
        assert engine.sync(lambda payload: 500) == (0, 1)
    assert engine.sync(lambda payload: 201) == (0, 0)


class Server(BaseHTTPRequestHandler):
    """Answers by what the payload asks for and remembers what came."""

    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append((body["n"], self.headers["Authorization"], self.headers["Idempotency-Key"]))
        self.send_response(body["answer"])
        self.end_headers()

    def log_message(self, *args):
        pass


def test_payloads_are_posted_by_tasks(spark, engine):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/runs"
    runs = [engine.start_run() for _ in range(4)]
    for n, (run, answer) in enumerate(zip(runs, (201, 202, 200, 500), strict=True)):
        engine.store.enqueue(run, spark.createDataFrame([(json.dumps({"n": n, "answer": answer}),)], "payload string"), "2024")
    assert engine.upload(url, "secret") == (2, 2)
    assert sorted(n for n, _, _ in Server.seen) == [0, 1, 2, 3] and {a for _, a, _ in Server.seen} == {"Bearer secret"}
    assert len({k for _, _, k in Server.seen}) == 4
    left = {r["run_id"]: (r["attempts"], r["last_error"]) for r in engine.store.read("pending_uploads").collect()}
    assert left == {runs[2]: (1, "HTTP 200"), runs[3]: (1, "HTTP 500")}
    assert {r["id"] for r in engine.store.read("test_runs").filter("synced_at is not null").collect()} == set(runs[:2])
    server.shutdown()
    server.server_close()
    for _ in range(4):  # nobody answers any more
        assert engine.upload(url, timeout=2) == (0, 2)
    assert engine.upload(url) == (0, 0)
    assert {r["attempts"] for r in engine.store.read("pending_uploads").collect()} == {5}


def test_writes_are_checked(spark, engine):
    run = engine.start_run()
    with pytest.raises(Exception, match="Invalid test status"):
        engine.record_tests(run, rows(spark, ("a", "odd", None)))
    with pytest.raises(ValueError, match="no running run"):
        engine.store.finish_run("none", {}, "2024")
    with pytest.raises(ValueError, match="exists"):
        engine.store.insert_run(run, "x", "2024")


def test_tests_are_numbered_report_after_report(spark, engine, monkeypatch):
    files = [(f"{d}.xml", f"{d}.xml", f'<testsuite name="s">{"".join(f"<testcase name=\'{d}{i}\'/>" for i in range(3))}</testsuite>') for d in "cab"]
    run = engine.start_run()
    engine.record_reports(run, spark.createDataFrame(files, "doc string, filename string, content string").repartition(3))
    got = engine.store.read("test_executions").orderBy("id").collect()
    assert [r["name"][-2:] for r in got] == [f"{d}{i}" for d in "abc" for i in range(3)]
    assert [r["id"] for r in got] == list(range(1, 10))
    more = [(None if i % 5 == 0 else f"d{i % 3}", i) for i in range(400)]
    monkeypatch.setattr("verdigris.operators.tables.NUMBERED", 16)
    got = numbered(spark.createDataFrame(more, "doc string, pos bigint").repartition(5), 7).orderBy("id").collect()
    assert [(r["doc"], r["pos"]) for r in got] == sorted(more, key=lambda x: (x[0] or "", x[1])) and got[0]["id"] == 7


def test_one_document_of_a_run(spark, engine):
    base = engine.start_run(branch="main", started_at="2024-01-01T00:00:00+00:00")
    engine.record_tests(base, rows(spark, ("a", "passed", None), ("b", "failed", "boom")))
    engine.end_run(base)
    run = engine.start_run(branch="dev", started_at="2030-01-02T00:00:00+00:00")
    engine.record_tests(run, rows(spark, ("a", "failed", "bang"), ("b", "passed", None)))
    engine.end_run(run)
    got = json.loads(engine.run_document(run, "main", spark.createDataFrame([("y",), ("x",)], "path string"), (2, 1)).first()["json"])
    assert got["summary"] == {"total": 2, "passed": 1, "failed": 1, "skipped": 0, "duration_ms": 2.0}
    assert got["failures"] == [{"name": "a", "error": "bang", "duration_ms": 1.0}]
    assert got["health"]["score"] == 65.0 and got["intelligence"]["failure_clusters"][0]["pattern"] == "bang"
    assert got["comparison"]["new_failures"] == ["a"] and got["context_files"] == ["x", "y"] and got["sync"] == {"synced": 2, "failed": 1}
    assert "coverage" not in got
    alone = json.loads(engine.run_document(run).first()["json"])
    assert not {"coverage", "comparison", "context_files", "sync"} & set(alone)


def written(engine, table):
    """Data files of a table by run."""
    found = {}
    for path in Path(engine.store.root, table).glob("*/*.parquet"):
        found.setdefault(path.parent.name.split("=")[1], set()).add(path.name)
    return found


def test_changes_write_the_partitions_of_their_runs_only(spark, engine):
    runs = [engine.start_run(started_at=f"2024-01-0{i}T00:00:00+00:00") for i in range(1, 4)]
    for run in runs:
        engine.record_tests(run, rows(spark, ("a", "passed", None)))
        engine.store.enqueue(run, spark.createDataFrame([("{}",)], "payload string"), "2024")
    before = {t: written(engine, t) for t in TABLES}
    engine.store.finish_run(runs[0], {"total": 1}, "2024-01-01T01:00:00+00:00")
    after = written(engine, "test_runs")
    assert {r for r in runs if after[r] != before["test_runs"][r]} == {runs[0]}
    first = engine.store.read("pending_uploads").filter(F.col("run_id") == runs[1]).first()["id"]
    engine.store.settle([(first, runs[1])], [], "now")
    assert written(engine, "pending_uploads") == {r: f for r, f in before["pending_uploads"].items() if r != runs[1]}
    assert engine.store.clean_up(2, "2024-01-02") == 1 and engine.store.clean_up(2, "2024-01-02") == 0
    for table in TABLES:
        left = written(engine, table)
        assert runs[0] not in left and left.get(runs[2]) == before[table].get(runs[2])


def test_histories_read_the_partitions_of_their_runs_only(spark, engine):
    for i in range(3):
        run = engine.start_run(started_at=f"2024-01-0{i + 1}T00:00:00+00:00")
        engine.record_tests(run, rows(spark, ("a", "passed", None)))
        engine.end_run(run)
    te, tr = engine._history()
    recent = history(te, tr, 1)
    assert recent.count() == 1
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert "PartitionFilters: [isnotnull(run_id" in te.filter(F.col("run_id") == run)._jdf.queryExecution().executedPlan().toString()


def test_writers_get_ranges_of_their_own(spark, tmp_path):
    first, second = (Engine(spark, str(tmp_path / "store")) for _ in range(2))
    run = first.start_run()
    claims = [e.store.claim("test_executions") for e in (first, second, first, second, second)]
    assert claims == sorted(set(claims)) and claims[0] == 1
    second.record_tests(run, rows(spark, ("a", "passed", None)))
    assert first.store.read("test_executions").first()["id"] > claims[-1]


def test_run_ids_of_any_characters(spark, engine):
    for run in ("2024-01-01", "a/b=c %41", "x y"):
        engine.store.insert_run(run, "cli", "2024-01-01")
        engine.record_tests(run, rows(spark, ("a", "failed", "e")))
        engine.store.finish_run(run, {"total": 1}, "2024")
    assert {r["run_id"] for r in engine.store.read("test_executions").collect()} == {"2024-01-01", "a/b=c %41", "x y"}
    assert engine.store.clean_up(0, "2025") == 3 and engine.store.read("test_executions").count() == 0


def test_migration_repeats(engine):
    assert engine.store.migrate() == engine.store.migrate() == 2


def test_coverage(engine):
    run = engine.start_run()
    got = engine.record_coverage(run, "SF:a\nLF:4\nLH:3\nend_of_record", "lcov.info").first()
    assert (got["format"], got["lines_covered"], got["lines_total"]) == ("lcov", 3, 4)
    assert '"path":"a"' in got["data"]
    with pytest.raises(ValueError, match=r"coverage format \(lcov\), not a test report"):
        engine.parse_report("SF:a\nend_of_record", "lcov.info")
    with pytest.raises(ValueError, match="No parser matched"):
        engine.parse_report("", "x.md")


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in" / "fixtures").mkdir(parents=True)
    for name in ("a.xml", "fixtures/b.xml"):
        (tmp_path / "in" / name).write_text('<testsuite name="s"><testcase name="t" time="1"/></testsuite>')
    (tmp_path / "in" / "note.txt").write_text("nothing")
    assert sorted(r["filename"] for r in read_files(spark, str(tmp_path / "in")).collect()) == ["a.xml", "note.txt"]
    for name in ("deep/junit-1.xml", "deep/test-results/x/y.xml", "deep/other.xml", "junit.txt"):
        (tmp_path / "more" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "more" / name).write_text("x")
    got = read_files(spark, str(tmp_path / "more"), DEFAULT_PATTERNS)
    assert sorted(r["filename"] for r in got.collect()) == ["junit-1.xml", "y.xml"]
    assert read_files(spark, str(tmp_path / "more"), ("*.txt",)).count() == 1
    fits = lambda glob, path: bool(re.match(glob_pattern(glob), path))
    assert fits("**/a/**/*.xml", "a/b.xml") and fits("**/a/**/*.xml", "x/a/y/z/b.xml") and not fits("a/*.xml", "a/b/c.xml") and not fits("**/junit*.xml", "a/xjunit.xml")
    stream = ingest(report_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    stream.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_failures_of_a_stream(spark, tmp_path):
    """Counts go on from batch to batch."""
    rows_ = lambda *x: spark.createDataFrame(list(x), "name string, status string")
    rows_(("a", "failed"), ("a", "passed"), ("b", "skipped")).write.parquet(str(tmp_path / "in" / "1"))
    found = {}

    def keep(batch, number):
        found.update({r["name"]: (r["runs"], r["failures"]) for r in batch.collect()})

    stream = lambda: spark.readStream.schema("name string, status string").parquet(str(tmp_path / "in" / "*"))
    failure_counts(stream(), keep, str(tmp_path / "cp")).awaitTermination()
    assert found == {"a": (2, 1)}
    rows_(("a", "failed"), ("c", "failed")).write.parquet(str(tmp_path / "in" / "2"))
    failure_counts(stream(), keep, str(tmp_path / "cp")).awaitTermination()
    assert found == {"a": (3, 2), "c": (1, 1)}
