"""The default formats, and reading files of mixed formats."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources import coverage, detect, ignore, json_tests, xml_tests
from verdigris.sources.detect import Format, Registry
from verdigris.sources.reports import CoverageReports, TestReports

TEST, COVERAGE = "testReport", "coverage"

#: Errors of a reader that is given a file of the other kind (``id`` is the format's), or of none.
NOT_TESTS = ("File detected as coverage format (", "id", "), not a test report. Use parse_coverage() instead.")
NOT_COVERAGE, NO_PARSER, NO_COVERAGE_PARSER = "Not a coverage format", "No parser matched the input", "No coverage parser matched the input"

#: Formats in their order, with names and priorities.
DEFAULT = (
    Format("junit", "JUnit XML", 90, TEST, detect.junit, xml_tests.junit),
    Format("jest-vitest-json", "Jest/Vitest JSON", 85, TEST, detect.jest, json_tests.jest),
    Format("playwright-json", "Playwright JSON", 86, TEST, detect.playwright, json_tests.playwright),
    Format("ctrf", "CTRF JSON", 84, TEST, detect.ctrf, json_tests.ctrf),
    Format("lcov", "LCOV Coverage Report", 100, COVERAGE, detect.lcov, coverage.lcov),
    Format("trx", "TRX Test Report", 88, TEST, detect.trx, xml_tests.trx),
    Format("cobertura", "Cobertura Coverage Report", 95, COVERAGE, detect.cobertura, coverage.cobertura),
    Format("jacoco", "JaCoCo Coverage Report", 95, COVERAGE, detect.jacoco, coverage.jacoco),
    Format("clover", "Clover Coverage Report", 95, COVERAGE, detect.clover, coverage.clover),
)

#: Where reports are looked for, and folders whose files are no reports.
DEFAULT_PATTERNS = ("**/.verdigris/reports/**/*.xml", "**/.verdigris/reports/**/*.json", "**/junit*.xml", "**/test-results/**/*.xml", "**/test-reports/**/*.xml", "**/ctrf/**/*.json", "**/ctrf-report.json", "**/coverage/lcov.info", "**/lcov.info")
IGNORE_FILE = ".gitignore"
SKIPPED_FOLDERS = ("fixtures", "__snapshots__", "examples", ".git")


def with_defaults() -> Registry:
    return Registry(DEFAULT)


def glob_pattern(glob: str) -> str:
    """A regular expression for paths below a root: ``**/`` is any folders, ``*`` and ``?`` stay within a name."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def read_files(spark: SparkSession, root: str, patterns: tuple[str, ...] | None = None, modified_after: str | None = None) -> DataFrame:
    """``doc, filename, content`` of the files below ``root`` that fit one of ``patterns`` (all of them by default); one row a file, none below a skipped folder.

    Patterns are of whole paths below ``root``, as in :data:`DEFAULT_PATTERNS`; one without a slash fits names in
    any folder. Paths are filtered before texts are read.
    """
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    path = F.col("_metadata.file_path")
    wanted = ~F.exists(F.split(path, "/"), lambda folder: folder.isin(*SKIPPED_FOLDERS))
    if patterns:
        below = F.regexp_replace(path, "^.*?" + re.escape(root.split("://")[-1].removeprefix("file:").strip("/")) + "/+", "")
        wanted = wanted & F.exists(F.array(*[F.lit(glob_pattern(p if "/" in p else f"**/{p}")) for p in patterns]), lambda p: F.regexp_like(below, p))
    return reader.text(root).filter(wanted).select(path.alias("doc"), F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"))


def _tree(spark: SparkSession, root: str) -> Iterator[tuple[str, int]]:
    """Files below ``root``, hidden ones too, which Spark's own listing leaves out: path below it and time of change."""
    jvm = spark._jvm.org.apache.hadoop.fs
    start = jvm.Path(root)
    system = start.getFileSystem(spark._jsc.hadoopConfiguration())
    open_ = [(system.makeQualified(start), "")]
    while open_:
        folder, below = open_.pop()
        for found in system.listStatus(folder):
            name = found.getPath().getName()
            if not found.isDirectory():
                yield below + name, found.getModificationTime()
            elif name not in SKIPPED_FOLDERS:
                open_.append((found.getPath(), f"{below}{name}/"))


def _text(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def find_reports(spark: SparkSession, root: str, patterns: tuple[str, ...] = DEFAULT_PATTERNS, modified_after: float = 0) -> DataFrame:
    """``doc, filename, content`` of a project's reports: files below ``root`` that fit one of ``patterns``, changed
    at ``modified_after`` (seconds since 1970) or later, and are in no folder that an ignore file shuts.

    The driver lists the project, as Spark does with any folder; only what is found is read. Without reports the
    table is empty.
    """
    root = root.rstrip("/")
    listed = list(_tree(spark, root))
    said = [(p.rpartition("/")[0], _text(spark, f"{root}/{p}")) for p, _ in listed if p.rpartition("/")[2] == IGNORE_FILE]
    rules = ignore.rules(spark.createDataFrame(said, "folder string, content string"))
    fresh = spark.createDataFrame([(p,) for p, at in listed if at >= modified_after * 1000], "path string")
    found = sorted(r["path"] for r in ignore.discovered(fresh, rules, patterns).collect())
    if not found:
        return spark.createDataFrame([], "doc string, filename string, content string")
    raw = spark.read.option("wholetext", True).text([f"{root}/{p}" for p in found])
    return raw.select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"))


def parse(files: DataFrame, registry: Registry | None = None) -> dict[str, TestReports | CoverageReports]:
    """Each detected format's reader over its own files; files of no format are left out.

    ``files`` may have been through :meth:`Registry.detect` already, and be persisted, as each reader reads them.
    """
    registry = registry or with_defaults()
    known = files if "format" in files.columns else registry.detect(files)
    return {f.id: f.read(known.filter(F.col("format.id") == f.id).select("doc", "content")) for f in registry.formats}


def test_cases(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Cases of all test reports among ``files``."""
    found = [r.cases for r in parse(files, registry).values() if isinstance(r, TestReports)]
    out = found[0]
    for cases in found[1:]:
        out = out.unionByName(cases)
    return out


def covered_files(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Files of all coverage reports among ``files``."""
    found = [r.files for r in parse(files, registry).values() if isinstance(r, CoverageReports)]
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out
