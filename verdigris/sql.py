"""Readers and scalar functions for SQL.

Functions are SQL functions: their bodies become part of the query's plan, so nothing of them runs outside of it.
:func:`register` adds the scalar ones to a session; :func:`attach` makes reports among files into views, and adds
table functions over one file with the errors that a reader of the wrong kind gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.scalars import ERROR_REWRITES, HEALTH_LABELS
from verdigris.sources import registry as formats
from verdigris.sources.detect import Registry
from verdigris.sources.registry import NO_COVERAGE_PARSER, NO_PARSER, NOT_COVERAGE, NOT_TESTS
from verdigris.sources.reports import CoverageReports, TestReports


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _normalized(text: str) -> str:
    for pattern, to in ERROR_REWRITES:
        text = f"regexp_replace({text}, {_text('(?U)' + pattern)}, {_text(to)})"
    return rf"regexp_replace({text}, '(?U)^\\s+|\\s+$', '')"


def _bytes(text: str) -> str:
    return f"decode(encode({text}, 'UTF-8'), 'ISO-8859-1')"


_LONGER = "greatest(octet_length(a), octet_length(b))"

#: Name, arguments, type and body of each scalar function.
SCALARS = (
    ("normalize_error", "message STRING", "STRING", _normalized("message")),
    ("edit_distance", "a STRING, b STRING", "INT", f"levenshtein({_bytes('a')}, {_bytes('b')})"),
    ("error_similarity", "a STRING, b STRING", "DOUBLE", f"CASE WHEN a = b THEN 1D WHEN a = '' OR b = '' THEN 0D ELSE 1 - levenshtein({_bytes('a')}, {_bytes('b')}) / {_LONGER} END"),
    ("coverage_percentage", "covered BIGINT, total BIGINT", "DOUBLE", "CASE WHEN total = 0 THEN 0D ELSE round(covered / nullif(total, 0) * 100) END"),
    ("pass_rate", "passed BIGINT, total BIGINT", "DOUBLE", "CASE WHEN total > 0 THEN passed / nullif(total, 0) * 100 ELSE 0D END"),
    ("health_label", "score DOUBLE", "STRING", "CASE " + " ".join(f"WHEN score >= {least} THEN {_text(label)}" for least, label in HEALTH_LABELS) + " ELSE 'critical' END"),
    ("round2", "value DOUBLE", "DOUBLE", "round(value * 100) / 100"),
)


def register(spark: SparkSession) -> None:
    """Add :data:`SCALARS` to the session as temporary functions; safe to repeat."""
    for name, arguments, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")


def _union(parts: list[tuple[str, DataFrame]]) -> DataFrame | None:
    out = None
    for id_, rows in parts:
        rows = rows.withColumn("format", F.lit(id_))
        out = rows if out is None else out.unionByName(rows)
    return out


def attach(spark: SparkSession, files: DataFrame, registry: Registry | None = None, prefix: str = "") -> None:
    """Views and table functions over ``files (doc, filename, content)``, each name after ``prefix``.

    Views: ``report_formats`` (``doc, filename, id, name, score, result_type``, nulls for files of no format),
    ``test_cases``, ``test_reports``, ``coverage_files`` and ``coverage_reports``, all with ``doc`` and ``format``.
    Functions: ``detect_format(doc)``, ``parse_report(doc)`` and ``parse_coverage(doc)`` give the rows of one file;
    the latter two fail for a file of the other kind, of no format, or with an error of its own. ``registry`` may
    hold formats of your own. Texts are detected once and kept in Spark's cache while the views are used.
    """
    registry = registry or formats.with_defaults()
    known = registry.detect(files).persist()
    read = formats.parse(known, registry)
    tests = [(i, r) for i, r in read.items() if isinstance(r, TestReports)]
    covered = [(i, r) for i, r in read.items() if isinstance(r, CoverageReports)]
    known.select("doc", "filename", "format.*").createOrReplaceTempView(f"{prefix}report_formats")
    views = {
        "test_cases": _union([(i, r.cases) for i, r in tests]), "test_reports": _union([(i, r.reports) for i, r in tests]),
        "coverage_files": _union([(i, r.files) for i, r in covered]), "coverage_reports": _union([(i, r.reports) for i, r in covered]),
    }
    for name, rows in views.items():
        if rows is not None:
            rows.createOrReplaceTempView(prefix + name)

    def function(name: str, columns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(doc STRING) RETURNS TABLE ({columns}) RETURN {body}")

    function("detect_format", "id STRING, name STRING, score INT, result_type STRING", f"SELECT id, name, score, result_type FROM {prefix}report_formats f WHERE f.doc = {prefix}detect_format.doc")
    for name, kind, rows, reports, none, wrong in (
        ("parse_report", formats.TEST, "test_cases", "test_reports", NO_PARSER, f"concat({', '.join(_text(x) if x != 'id' else 'f.id' for x in NOT_TESTS)})"),
        ("parse_coverage", formats.COVERAGE, "coverage_files", "coverage_reports", NO_COVERAGE_PARSER, _text(NOT_COVERAGE)),
    ):
        if views[rows] is None:
            continue
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in views[rows].schema)
        # one condition, so that no row is dropped ahead of its error
        checked = f"CASE WHEN f.id IS NULL THEN raise_error({_text(none)}) WHEN f.result_type <> '{kind}' THEN raise_error({wrong}) WHEN r.error IS NOT NULL THEN raise_error(r.error) ELSE c.doc IS NOT NULL END"
        picked = ", ".join(f"c.{f.name}" for f in views[rows].schema)
        function(name, columns, f"SELECT {picked} FROM {prefix}report_formats f LEFT JOIN {prefix}{reports} r ON r.doc = f.doc LEFT JOIN {prefix}{rows} c ON c.doc = f.doc WHERE f.doc = {prefix}{name}.doc AND {checked}")
