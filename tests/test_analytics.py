import bisect
import math

import pytest
from pyspark.sql import functions as F

from verdigris import schemas
from verdigris.operators import clusters, compare, durations, flaky, health, payload, retention, tables


def runs(spark, *rows):
    """(id, branch, started, total, passed, failed, duration), finished."""
    full = [(i, b, "abc", None, "vitest", s, s + "x", "finished", t, p, f, t - p - f, d, None) for i, b, s, t, p, f, d in rows]
    return spark.createDataFrame(full, schemas.TEST_RUNS)


def execs(spark, *rows):
    """(run, name, status[, ms, file, error])"""
    full = [(n + 1, r[0], r[1], r[2], r[3] if len(r) > 3 else 1.0, r[4] if len(r) > 4 else None, r[5] if len(r) > 5 else None, 0, False) for n, r in enumerate(rows)]
    return spark.createDataFrame(full, schemas.TEST_EXECUTIONS)


def series(spark, statuses, name="t"):
    r = runs(spark, *[(f"r{i}", "main", f"2024-01-0{i + 1}", 1, 1, 0, 1.0) for i in range(len(statuses))])
    return execs(spark, *[(f"r{i}", name, s, 1.0, f"f{i}.ts") for i, s in enumerate(statuses)]), r


def test_alternating_test_is_flaky(spark):
    got = flaky.flaky_tests(*series(spark, ["passed", "failed"] * 3)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["flip_rate"], r["flip_count"], r["total_runs"], r["composite_score"], r["file_path"], r["last_flipped_at"]) == (1.0, 5, 6, 0.6, "f5.ts", "2024-01-06")


@pytest.mark.parametrize("statuses", [["passed", "failed"] * 2, ["passed"] * 8, ["passed", "skipped"] * 4])
def test_not_flaky(spark, statuses):
    assert flaky.flaky_tests(*series(spark, statuses)).count() == 0


def test_only_the_latest_runs_count(spark):
    te, tr = series(spark, ["passed", "failed"] * 3)
    assert flaky.flaky_tests(te, tr, last=4).count() == 0


def test_percentiles(spark):
    ten = execs(spark, *[("r", f"t{i}", "passed", float(i)) for i in range(1, 11)])
    r = durations.percentiles(ten).first()
    assert (r["p50"], r["p95"], r["mean"]) == (5.5, 9.55, 5.5)
    two = durations.percentiles(execs(spark, ("r", "a", "passed", 10.0), ("r", "b", "passed", 20.0))).first()
    assert two["p50"] == 15.0
    assert durations.percentiles(ten.limit(0)).count() == 0


def test_slowest_is_capped_and_ranked(spark):
    rows = execs(spark, *[("r", f"t{i:02}", "passed", float(i)) for i in range(15)])
    got = durations.slowest(rows, 50).orderBy("rank").collect()
    assert len(got) == 10
    assert (got[0]["test_name"], got[0]["percentile"], got[9]["duration_ms"]) == ("t14", 100.0, 5.0)


@pytest.mark.parametrize(
    ("total", "passed", "n", "previous", "score", "label", "trend"),
    [(100, 100, 0, None, 95, "excellent", "stable"), (100, 0, 0, None, 35, "poor", "stable"), (100, 90, 50, None, 74, "fair", "stable"), (100, 100, 0, 60.0, 100, "excellent", "improving"), (100, 50, 0, 95.0, 60, "fair", "declining"), (100, 100, 0, 93.0, 95, "excellent", "stable"), (0, 0, 0, 50.0, 0, "critical", "stable")],
)
def test_health(spark, total, passed, n, previous, score, label, trend):
    cols = health.score(F.lit(total), F.lit(passed), F.lit(n), F.lit(previous).cast("double"))
    r = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    assert (r["score"], r["label"], r["trend"]) == (score, label, trend)


def test_previous_score_is_of_the_run_before(spark):
    tr = runs(spark, ("a", "main", "2024-01-01", 10, 10, 0, 1.0), ("b", "main", "2024-01-02", 10, 5, 5, 1.0))
    got = {r["id"]: r["previous_score"] for r in health.previous_scores(tr).collect()}
    assert got == {"a": None, "b": 95.0}


def test_similar_errors_are_one_cluster(spark):
    te = execs(spark, *[("r", f"t{i}", "failed", 1.0, f"f{i}", f"expected status 200 but got {c}") for i, c in enumerate((500, 500, 502))])
    got = clusters.clusters(te).collect()
    assert [(r["count"], r["test_names"], r["file_paths"], r["similarity"]) for r in got] == [(3, ["t0", "t1", "t2"], ["f0", "f1", "f2"], 0.7)]


def test_unrelated_and_blank_errors(spark):
    te = execs(spark, ("r", "a", "failed", 1.0, "f", "cannot read property x"), ("r", "b", "failed", 1.0, "f", "Timeout exceeded!!!"), ("r", "c", "failed", 1.0, "g", "  "), ("r", "d", "failed", 1.0, None, None))
    got = [r["pattern"] for r in clusters.ordered(clusters.clusters(te)).collect()]
    assert got == ["cannot read property x", "Timeout exceeded!!!", "Failed tests in g (no error message captured)", "Failed tests in (unknown file) (no error message captured)"]


def test_leaders_absorb_by_distance_to_the_leader_only(spark):
    a, b, c = "aaaaaaaaaa", "aaaaaaabbb", "aaaabbbbbb"  # b is near a and near c, c is not near a
    got = clusters.clusters(execs(spark, *[("r", n, "failed", 1.0, None, x) for n, x in (("1", a), ("2", b), ("3", c))])).collect()
    assert sorted((r["pattern"], r["count"]) for r in got) == [(a, 2), (c, 1)]


def test_comparison(spark):
    tr = runs(spark, ("base", "main", "2024-01-01", 10, 8, 2, 1000.0), ("cur", "dev", "2024-01-02", 12, 11, 1, 1500.0))
    te = execs(spark, ("base", "keeps", "failed"), ("base", "mended", "failed"), ("base", "gone", "failed"), ("base", "skip", "failed"), ("base", "retry", "failed"), ("base", "retry", "passed"), ("cur", "keeps", "failed"), ("cur", "mended", "passed"), ("cur", "new", "failed"), ("cur", "skip", "skipped"), ("cur", "retry", "failed"))
    r = compare.compare(te, tr, "main", tr.filter("id = 'cur'")).first()
    assert (r["new_failures"], r["fixed"], r["pre_existing_failures"]) == (["new", "retry"], ["mended", "skip"], ["keeps"])
    assert (round(r["pass_rate_delta"], 2), r["duration_delta"], r["total_delta"], r["baseline_run_id"]) == (11.67, 500.0, 2, "base")


def test_no_baseline(spark):
    tr = runs(spark, ("cur", "dev", "2024-01-02", 1, 1, 0, 1.0))
    assert compare.compare(execs(spark, ("cur", "a", "passed")), tr, "main").count() == 0


def test_retention(spark):
    tr = runs(spark, *[(f"r{i}", "main", f"2020-01-0{i + 1}", 1, 1, 0, 1.0) for i in range(5)])
    left = retention.survivors(tr, 3, "2021")
    assert sorted(r["id"] for r in left.collect()) == ["r2", "r3", "r4"]
    assert retention.survivors(tr, 3, "2010").count() == 5
    te = execs(spark, *[(f"r{i}", "t", "passed") for i in range(5)])
    assert retention.cascade(te, left).count() == 3


def test_search(spark):
    tr = runs(spark, ("r", "main", "2024", 1, 1, 0, 1.0))
    te = execs(spark, ("r", "test_a", "failed", 1.0, None, None), ("r", "testXa", "failed", 1.0, None, "boom"), ("r", "other", "passed", 1.0, None, "test_a"))
    assert [r["name"] for r in tables.search_failures(te, tr, "test_a").collect()] == ["test_a"]
    assert [r["name"] for r in tables.search_failures(te, tr, "BOOM").collect()] == ["testXa"]
    assert tables.test_history(te, tr, "100%").count() == 0


def test_summary_counts_the_rest_as_skipped(spark):
    r = tables.run_summary(execs(spark, ("r", "a", "passed"), ("r", "b", "todo"), ("r", "c", "failed"))).first()
    assert (r["total"], r["passed"], r["failed"], r["skipped"]) == (3, 1, 1, 1)


def test_payload_leaves_out_what_is_missing(spark):
    import json

    tr = runs(spark, ("r", None, "2024", 1, 1, 0, 1.0))
    none = spark.createDataFrame([], schemas.COVERAGE_REPORTS)
    got = json.loads(payload.ingest_payload(tr, execs(spark, ("r", "a", "passed")), none).first()["payload"])
    assert "branch" not in got and "coverage" not in got
    assert got["tests"] == [{"name": "a", "status": "passed", "durationMs": 1.0, "retryCount": 0, "flaky": False}]
    shown = json.loads(payload.documents(tr.select("id", "branch")).first()["json"])
    assert shown == {"id": "r", "branch": None}


def test_one_run_of_distinct_durations(spark):
    """As large as the table: ranges of it are sorted apart, and give what one sort gives."""
    n = 50_000
    values = [((i * 7919) % n) ** 2 / 1000 for i in range(n)] + [5.0] * 7
    te = spark.createDataFrame([(i, "r", f"t{i}", v, None) for i, v in enumerate(values)] + [(n + 9, "s", "one", 3.0, "f")], "id bigint, run_id string, name string, duration_ms double, file_path string").repartition(6)
    order = sorted(values)
    got = {r["run_id"]: r for r in durations.percentiles(te).collect()}
    for p in durations.PERCENTILES:
        at = p / 100 * (len(order) - 1)
        low, high = order[math.floor(at)], order[math.ceil(at)]
        assert abs(got["r"][f"p{p}"] - (low + (high - low) * (at - math.floor(at)))) < 0.006 and got["s"][f"p{p}"] == 3.0
    ranks = {r["id"]: r["percentile"] for r in durations.ranked(te).collect()}
    assert len(ranks) == len(values) + 1
    assert all(abs(ranks[i] - bisect.bisect_right(order, values[i]) / len(order) * 100) < 0.006 for i in range(0, n, 97))
    top = [r["duration_ms"] for r in durations.slowest(te).filter("run_id = 'r'").orderBy("rank").collect()]
    assert len(top) == 10 and all(abs(a - b) < 0.006 for a, b in zip(top, order[:-11:-1], strict=True))
    sizes = [r["n"] for r in durations._steps(te, ("run_id",)).groupBy("run_id").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) == len(set(values))
