import pytest
from pyspark.sql import functions as F

from verdigris.functions import scalars as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a  b\n c", "a b c"),
        ("id 123E4567-e89b-12d3-a456-426614174000 x", "id <uuid> x"),
        ("at 2024-01-02T03:04:05.678Z now", "at <timestamp> now"),
        ("at /home/u/src/a.test.ts:12:5", "at a.test.ts:<line>"),
        ("bad ID: 42", "bad id=<id>"),
        ("got 12345 and 123", "got <id> and 123"),
        ("ptr 0xDEADbeef", "ptr <address>"),
        ("", ""),
    ],
)
def test_normalize_error(spark, text, want):
    assert value(spark, S.normalize_error(lit(text))) == want


def test_edit_distance_counts_bytes(spark):
    assert value(spark, S.edit_distance(lit("kitten"), lit("sitting"))) == 3
    assert value(spark, S.edit_distance(lit("e"), lit("é"))) == 2


def test_similarity(spark):
    assert value(spark, S.similarity(lit("a"), lit("a"))) == 1.0
    assert value(spark, S.similarity(lit(""), lit("a"))) == 0.0
    assert value(spark, S.similar(lit("expected 500"), lit("expected 502")))
    assert not value(spark, S.similar(lit("abc"), lit("xyz")))


@pytest.mark.parametrize(("text", "limit", "want"), [("abc", 5, "abc"), ("abcdef", 3, "abc"), ("aé", 2, "a"), ("aé", 3, "aé"), ("日本語", 4, "日"), ("日本語", 6, "日本")])
def test_truncate_bytes(spark, text, limit, want):
    assert value(spark, S.truncate_bytes(lit(text), limit)) == want


def test_round2_goes_away_from_zero(spark):
    assert value(spark, S.round2(lit(0.125))) == 0.13


def test_percentage_and_pass_rate(spark):
    assert value(spark, S.percentage(lit(0), lit(0))) == 0.0
    assert value(spark, S.percentage(lit(1), lit(3))) == 33.0
    assert value(spark, S.pass_rate(lit(3), lit(4))) == 75.0
    assert value(spark, S.pass_rate(lit(0), lit(0))) == 0.0


@pytest.mark.parametrize(("score", "label"), [(90, "excellent"), (89.9, "good"), (75, "good"), (50, "fair"), (25, "poor"), (24, "critical")])
def test_health_label(spark, score, label):
    assert value(spark, S.health_label(lit(score))) == label


@pytest.mark.parametrize(("text", "ms"), [("1.02:03:04.5000000", 93784500), ("00:00:01.5", 1500), ("00:01", 0), ("x:y:z", 0), ("00:00:00", 0)])
def test_timespan(spark, text, ms):
    assert value(spark, S.timespan_millis(lit(text))) == ms


def test_class_and_method(spark):
    assert value(spark, S.class_of(lit("A.B.Run(x: 1.5)"))) == "A.B"
    assert value(spark, S.method_of(lit("A.B.Run(x: 1.5)"))) == "Run(x: 1.5)"
    assert value(spark, S.class_of(lit("Run"))) == ""


@pytest.mark.parametrize(("path", "want"), [("/home/u/tests/a/b.ts", "tests/a/b.ts"), ("C:\\w\\src\\x\\y.ts", "src/x/y.ts"), ("/x/y.ts", "y.ts"), ("/src/tests/a.ts", "src/tests/a.ts")])
def test_project_path(spark, path, want):
    assert value(spark, S.project_path(lit(path))) == want


def test_search_ignores_ascii_case_only(spark):
    assert value(spark, S.contains_text(lit("Test_A"), "test_a"))
    assert not value(spark, S.contains_text(lit("testXa"), "test_a"))
    assert not value(spark, S.contains_text(lit("É"), "é"))
    assert S.escape_like("a%b_c\\") == "a\\%b\\_c\\\\"


def test_small_ones(spark):
    assert value(spark, S.to_millis(lit(1.5))) == 2
    assert value(spark, S.to_millis(lit(-3.0))) == 0
    assert value(spark, S.to_millis(lit(float("nan")))) is None
    assert value(spark, S.first_line(lit("a\r\nb"))) == "a"
    assert value(spark, S.condition_counts(lit("50% (1/2)"))[1]) == 2
    assert value(spark, S.ellipsis(lit("abcdefgh"), 6)) == "abc..."
    assert value(spark, S.plural(lit(1), "test")) == "1 test"
    assert value(spark, S.trend_arrow(lit("declining"))) == "↓"
    assert value(spark, S.local_name(lit("ns:Tag"))) == "Tag"
    assert value(spark, S.strip_bom(lit("﻿x"))) == "x"
