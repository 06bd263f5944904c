"""Schemas of the stored tables and of parsed reports."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind.rstrip("!")], not kind.endswith("!")) for name, kind in (f.split(":") for f in text.split())])


_KINDS = {"str": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "bool": T.BooleanType()}

TEST_RUNS = _struct("id:str! branch:str commit_sha:str ci_provider:str framework:str! started_at:str! finished_at:str status:str! total:int passed:int failed:int skipped:int duration_ms:double synced_at:str")
TEST_EXECUTIONS = _struct("id:long! run_id:str! name:str! status:str! duration_ms:double! file_path:str error_message:str retry_count:int! flaky:bool!")
COVERAGE_REPORTS = _struct("id:long! run_id:str! data:str format:str! lines_covered:int! lines_total:int! branches_covered:int! branches_total:int! functions_covered:int! functions_total:int! created_at:str!")
PENDING_UPLOADS = _struct("id:long! run_id:str! payload:str! created_at:str! attempts:int! last_error:str")
SCHEMA_VERSION = _struct("version:int! applied_at:str")

#: Tables by name, in the order in which children follow the runs they belong to.
TABLES = {"test_runs": TEST_RUNS, "test_executions": TEST_EXECUTIONS, "coverage_reports": COVERAGE_REPORTS, "pending_uploads": PENDING_UPLOADS}

#: Columns that a schema version adds to a table; older files lack them and read as 0.
ADDED = {2: {"coverage_reports": ("branches_covered", "branches_total", "functions_covered", "functions_total")}}
LATEST_VERSION = max(ADDED)

#: One row for each test case of a parsed report; ``pos`` keeps the report's order.
TEST_CASES = "doc string, pos bigint, id string, name string, full_name string, status string, duration_ms bigint, error_message string, file_path string, line bigint, retry_attempt int"

#: One row for each file of a parsed coverage report.
FILE_COVERAGE = "doc string, pos bigint, path string, lines_covered bigint, lines_total bigint, branches_covered bigint, branches_total bigint, functions_covered bigint, functions_total bigint"

STATUSES = ("passed", "failed", "skipped", "todo")
