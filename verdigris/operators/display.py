"""Query results as lines of text: each function gives a DataFrame with one column, ``line``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.scalars import ellipsis, plural, trend_arrow

#: Entries shown, bytes of texts, least changes worth showing.
FLAKY_SHOWN, CLUSTERS_SHOWN = 5, 3
PATTERN_BYTES, HISTORY_BYTES, FAILURE_BYTES, ID_CHARS, SHA_CHARS = 60, 80, 100, 8, 7
LEAST_RATE, LEAST_MS = 0.05, 50


def _lines(rows: DataFrame, *parts: Column | str) -> DataFrame:
    return rows.select(F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("line"))


def flaky(rows: DataFrame, most: int = FLAKY_SHOWN) -> DataFrame:
    return _lines(rows.orderBy(F.desc("composite_score"), "test_name").limit(most), F.col("test_name"), "  ", F.format_number(F.col("flip_rate") * 100, 0), "% flips in ", plural(F.col("total_runs"), "run"))


def clusters(rows: DataFrame, most: int = CLUSTERS_SHOWN) -> DataFrame:
    return _lines(rows.orderBy(F.desc("count"), "silent", "first").limit(most), plural(F.col("count"), "failure"), ": ", ellipsis(F.col("pattern"), PATTERN_BYTES))


def health(rows: DataFrame) -> DataFrame:
    return _lines(rows, "Health ", F.format_number("score", 0), " (", F.col("label"), ") ", trend_arrow(F.col("trend")))


def coverage(rows: DataFrame) -> DataFrame:
    """``rows`` with percentages; below 50 is low, from 80 on high."""
    level = F.when(F.col("lines_percent") >= 80, "high").when(F.col("lines_percent") >= 50, "medium").otherwise("low")
    return _lines(rows, "Lines ", F.format_number("lines_percent", 0), "% (", level, "), branches ", F.format_number("branches_percent", 0), "%, functions ", F.format_number("functions_percent", 0), "%")


def comparison(rows: DataFrame) -> DataFrame:
    """Counts of changed tests, and the deltas that are large enough."""
    rate = F.when(F.abs("pass_rate_delta") >= LEAST_RATE, F.concat(F.lit(", pass rate "), F.format_string("%+.1f", "pass_rate_delta")))
    ms = F.when(F.abs("duration_delta") >= LEAST_MS, F.concat(F.lit(", duration "), F.format_string("%+.0f ms", "duration_delta")))
    return _lines(rows, "vs ", F.col("baseline_branch"), ": ", F.size("new_failures").cast("string"), " new, ", F.size("fixed").cast("string"), " fixed, ", F.size("pre_existing_failures").cast("string"), " still failing", rate, ms)


def history(rows: DataFrame) -> DataFrame:
    return _lines(rows, F.col("started_at"), "  ", F.col("status"), "  ", F.col("name"), "  ", ellipsis(F.coalesce("error_message", F.lit("")), HISTORY_BYTES))


def failures(rows: DataFrame) -> DataFrame:
    return _lines(rows, F.col("started_at"), "  ", F.col("name"), "  ", ellipsis(F.coalesce("error_message", F.lit("")), FAILURE_BYTES))


def runs(rows: DataFrame) -> DataFrame:
    return _lines(rows, F.substring("id", 1, ID_CHARS), "  ", F.coalesce("branch", F.lit("-")), "  ", F.coalesce(F.substring("commit_sha", 1, SHA_CHARS), F.lit("-")), "  ", plural(F.col("total"), "test"), ", ", F.col("failed").cast("string"), " failed")
