from verdigris.operators import display


def lines(df):
    return [r["line"] for r in df.collect()]


def test_lines(spark):
    flaky = spark.createDataFrame([("a", 0.5, 6, 0.4), ("b", 1.0, 1, 0.6)], "test_name string, flip_rate double, total_runs bigint, composite_score double")
    assert lines(display.flaky(flaky)) == ["b  100% flips in 1 run", "a  50% flips in 6 runs"]
    clusters = spark.createDataFrame([("x" * 70, 2, 0, 1)], "pattern string, count int, silent int, first bigint")
    assert lines(display.clusters(clusters)) == ["2 failures: " + "x" * 57 + "..."]
    health = spark.createDataFrame([(95.0, "excellent", "improving")], "score double, label string, trend string")
    assert lines(display.health(health)) == ["Health 95 (excellent) ↑"]
    covered = spark.createDataFrame([(79.0, 0.0, 100.0)], "lines_percent double, branches_percent double, functions_percent double")
    assert lines(display.coverage(covered)) == ["Lines 79% (medium), branches 0%, functions 100%"]
    kind = "baseline_branch string, new_failures array<string>, fixed array<string>, pre_existing_failures array<string>, pass_rate_delta double, duration_delta double"
    compared = spark.createDataFrame([("main", ["a"], [], ["b", "c"], -1.25, 49.0)], kind)
    assert lines(display.comparison(compared)) == ["vs main: 1 new, 0 fixed, 2 still failing, pass rate -1.3"]
    rows = spark.createDataFrame([("2024", "failed", "t", None, "0123456789", None, "abcdefghij", 2, 1)], "started_at string, status string, name string, error_message string, id string, branch string, commit_sha string, total int, failed int")
    assert lines(display.history(rows)) == ["2024  failed  t  "] and lines(display.failures(rows)) == ["2024  t  "]
    assert lines(display.runs(rows)) == ["01234567  -  abcdefg  2 tests, 1 failed"]
