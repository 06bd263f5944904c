"""Jest/Vitest, Playwright and CTRF readers: JSON schemas, explodes and window-free groupings.

Suites of Playwright nest to any depth, which no schema says: one pass in Python walks them and gives their specs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.scalars import first_line, project_path, to_millis
from verdigris.sources.reports import TestReports, case, report, summed

JEST = "struct<numTotalTests: bigint, numPassedTests: bigint, numFailedTests: bigint, numPendingTests: bigint, numTodoTests: bigint, numTotalTestSuites: bigint, numPassedTestSuites: bigint, numFailedTestSuites: bigint, numPendingTestSuites: bigint, numRuntimeErrorTestSuites: bigint, startTime: double, success: boolean, wasInterrupted: boolean, openHandles: array<string>, snapshot: struct<total: bigint, matched: bigint, unmatched: bigint, updated: bigint>, testResults: array<struct<name: string, startTime: double, endTime: double, assertionResults: array<struct<fullName: string, title: string, status: string, duration: double, failureMessages: array<string>, location: struct<line: bigint>, meta: string, invocations: bigint, numPassingAsserts: bigint>>>>>"

SPEC = "struct<title: string, id: string, file: string, line: bigint, tests: array<struct<projectName: string, status: string, results: array<struct<status: string, duration: double, retry: int, error: struct<message: string>, errors: array<struct<message: string>>>>>>>"
PLAYWRIGHT = "struct<config: struct<projects: array<struct<id: string, name: string>>>, suites: array<string>, errors: array<struct<message: string>>, stats: struct<startTime: string, duration: double, expected: bigint, unexpected: bigint, flaky: bigint, skipped: bigint>>"

_PROJECTS = "struct<config: struct<projects: array<struct<id: string, name: string>>>>"

CTRF = "struct<reportFormat: string, specVersion: string, results: struct<tool: struct<name: string, version: string>, summary: struct<tests: bigint, passed: bigint, failed: bigint, skipped: bigint, pending: bigint, other: bigint, flaky: bigint, start: double, stop: double, duration: double>, tests: array<struct<name: string, status: string, duration: double, id: string, suite: string, message: string, trace: string, filePath: string, line: bigint, retries: int, flaky: boolean>>>>"


#: Specs in a record batch, about.
BATCH = 5_000
_ARROW_SPECS = pa.schema([("doc", pa.string()), ("many", pa.bool_()), ("before", pa.int64()), ("titles", pa.list_(pa.string())), ("spec", pa.string())])


def _nothing(text: Column, empty: str = "") -> Column:
    return F.nullif(text, F.lit(empty))


def jest(docs: DataFrame) -> TestReports:
    """Jest and Vitest JSON: counts come from the header; the framework from what only one of them writes."""
    parsed = docs.select("doc", "content", F.from_json("content", JEST).alias("r"))
    suites = parsed.select("doc", F.posexplode("r.testResults").alias("s", "suite"))
    tests = suites.select("doc", "s", "suite", F.posexplode("suite.assertionResults").alias("t", "a"))
    place = F.col("s").cast("bigint") * (1 << 31) + F.col("t")
    known = tests.withColumn("n", place)
    status = F.when(F.col("a.status").isin("passed", "failed"), F.col("a.status")).otherwise("skipped")
    span = F.when(F.col("a.duration") >= 0, to_millis(F.col("a.duration")))
    message = F.when(F.size("a.failureMessages") > 0, F.array_join("a.failureMessages", "\n"))
    cases = known.select(*case(doc=F.col("doc"), pos=F.col("n"), id=F.concat(F.lit("tc-"), F.col("s") + 1, F.lit("-"), F.col("t") + 1), name=F.col("a.title"), full_name=F.col("a.fullName"), status=status, duration_ms=span, error_message=message, file_path=project_path(F.col("suite.name")), line=F.col("a.location.line")))
    took = F.col("suite.endTime") - F.col("suite.startTime")
    spans = suites.groupBy("doc").agg(F.sum(F.when(took > 0, to_millis(took))).alias("suite_ms"))
    mark = F.when(F.col("a.meta").isNotNull(), "vitest").when(F.col("a.invocations").isNotNull() | F.col("a.numPassingAsserts").isNotNull(), "jest")
    marks = known.groupBy("doc").agg(F.min_by(mark, F.when(mark.isNotNull(), F.col("n"))).alias("mark"), F.sum(span).alias("test_ms"))
    r = F.col("r")
    header = parsed.join(spans, "doc", "left").join(marks, "doc", "left")
    framework = F.when(r["numRuntimeErrorTestSuites"].isNotNull() | r["openHandles"].isNotNull() | r["wasInterrupted"].isNotNull(), "jest").otherwise(F.coalesce("mark", F.when(F.col("content").contains("vitest") | F.col("content").contains("Vitest"), "vitest"), F.lit("jest")))
    meta = F.to_json(F.struct(*[r[c].alias(c) for c in ("numTotalTestSuites", "numPassedTestSuites", "numFailedTestSuites", "numPendingTestSuites", "success", "startTime")], r["snapshot"].alias("snapshots"), F.when(framework == "jest", r["numRuntimeErrorTestSuites"]).alias("runtimeErrorSuites"), F.when(framework == "jest", r["wasInterrupted"]).alias("wasInterrupted")))
    wrong = r["numTotalTests"].isNull() | r["testResults"].isNull() | r["success"].isNull()
    skipped = F.coalesce(r["numPendingTests"], F.lit(0)) + F.coalesce(r["numTodoTests"], F.lit(0))
    reports = header.select("doc", framework.alias("framework"), r["numPassedTests"].alias("passed"), r["numFailedTests"].alias("failed"), skipped.alias("skipped"), F.lit(0).cast("bigint").alias("flaky"), r["numTotalTests"].alias("total"), F.coalesce("suite_ms", "test_ms").alias("duration_ms"), meta.alias("metadata"), F.when(r.isNull() | wrong, "Failed to parse Jest/Vitest JSON").alias("error"))
    return TestReports(cases, reports)


_SPECS = "doc string, many boolean, before bigint, titles array<string>, spec string"


class _Specs:
    """Specs by column."""

    def __init__(self):
        self.columns: tuple[list, ...] = tuple([] for _ in _ARROW_SPECS)

    def add(self, *row) -> None:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, _ARROW_SPECS, strict=True)], schema=_ARROW_SPECS)


def _tests(spec: object) -> int:
    """How many tests :data:`SPEC` gives a spec: one value that is no object, and it has none."""
    tests = spec.get("tests") if isinstance(spec, dict) else None
    return len(tests) if isinstance(tests, list) and all(t is None or isinstance(t, dict) for t in tests) else 0


def _walked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Specs of suites at every depth from ``doc, many, suites``, the latter a list of JSON texts.

    Suites have the titles above them and their own, unless it is empty or a path. The specs of a suite come ahead
    of its child suites; ``before`` counts the tests of the document's specs before.
    """
    many = lambda x: x if isinstance(x, list) else []
    for batch in rows:
        found = _Specs()
        for doc, several, suites in zip(*(batch.column(i) for i in range(3)), strict=True):
            doc, several, before = doc.as_py(), several.as_py(), 0
            open_ = [((), json.loads(text)) for text in reversed(suites.as_py() or ()) if text]
            while open_:
                titles, suite = open_.pop()
                if not isinstance(suite, dict):
                    continue
                title = suite.get("title")
                if title is not None and not isinstance(title, str):
                    title = json.dumps(title)
                if title and "/" not in title and "\\" not in title:
                    titles = (*titles, title)
                for spec in many(suite.get("specs")):
                    found.add(doc, several, before, titles, json.dumps(spec))
                    before += _tests(spec)
                open_ += [(titles, child) for child in reversed(many(suite.get("suites")))]
                if len(found.columns[0]) >= BATCH:
                    yield found.batch()
                    found = _Specs()
        yield found.batch()


def playwright(docs: DataFrame) -> TestReports:
    """Playwright JSON: one case for each test of a spec, by its last result. Cases are numbered as they are walked, so nothing is shuffled."""
    parsed = docs.select("doc", F.from_json("content", PLAYWRIGHT).alias("r"))
    # suites are read alone, so that a text cut off behind them has none
    suites, projects = F.from_json("content", "struct<suites: array<string>>")["suites"], F.from_json("content", _PROJECTS)["config"]["projects"]
    specs = docs.select(F.col("doc").cast("string"), (F.size(projects) > 1).alias("many"), suites.alias("suites")).mapInArrow(_walked, _SPECS).withColumn("spec", F.from_json("spec", SPEC))
    tests = specs.select("doc", "many", "before", "titles", "spec", F.posexplode("spec.tests").alias("j", "t"))
    last = F.when(F.size("t.results") > 0, F.element_at("t.results", -1))
    tests = tests.withColumn("last", last)
    status = F.when(F.col("t.status") == "expected", "passed").when((F.col("t.status") == "unexpected") & (F.col("last.status") == "timedOut"), "timedOut").when(F.col("t.status") == "unexpected", "failed").when(F.col("t.status") == "flaky", "flaky").otherwise("skipped")
    messages = F.filter(F.transform("last.errors", lambda e: e["message"]), lambda m: m.isNotNull())
    message = F.coalesce(F.when(F.size(messages) > 0, F.array_join(messages, "\n")), F.col("last.error.message"))
    project = F.when(F.col("many"), F.col("t.projectName"))
    full = F.array_join(F.concat("titles", F.array("spec.title")), " > ")
    n = F.col("before") + F.col("j") + 1
    cases = tests.select(*case(doc=F.col("doc"), pos=n, id=F.concat_ws("-", "spec.id", project), name=F.col("spec.title"), full_name=F.when(project.isNotNull(), F.concat(full, F.lit(" ["), project, F.lit("]"))).otherwise(full), status=status, duration_ms=to_millis(F.col("last.duration")), error_message=message, file_path=F.col("spec.file"), line=F.col("spec.line"), retry_attempt=F.col("last.retry")))
    stats = F.col("r.stats")
    names = F.filter(F.transform("r.config.projects", lambda p: p["name"]), lambda p: F.coalesce(p, F.lit("")) != "")
    errors = F.coalesce(F.transform("r.errors", lambda e: e["message"]), F.array().cast("array<string>"))
    meta = F.to_json(F.struct((stats["unexpected"] == 0).alias("ok"), stats["startTime"].alias("startTime"), F.struct(F.size(errors).alias("count"), errors.alias("messages")).alias("globalErrors"), names.alias("projects")))
    total = stats["expected"] + stats["unexpected"] + stats["flaky"] + stats["skipped"]
    reports = parsed.select("doc", F.lit("playwright").alias("framework"), stats["expected"].alias("passed"), stats["unexpected"].alias("failed"), stats["skipped"].alias("skipped"), stats["flaky"].alias("flaky"), total.alias("total"), to_millis(stats["duration"]).alias("duration_ms"), meta.alias("metadata"), F.when(stats.isNull() | F.col("r.suites").isNull(), "Failed to parse Playwright JSON").alias("error"))
    return TestReports(cases, reports)


def ctrf(docs: DataFrame) -> TestReports:
    """CTRF JSON: suites may be a text or a list; durations fall back from explicit to span to sum."""
    parsed = docs.select("doc", F.from_json("content", CTRF).alias("r"))
    tests = parsed.select("doc", F.posexplode("r.results.tests").alias("i", "t"))
    listed = F.from_json("t.suite", "array<string>")
    suites = F.when(F.col("t.suite").startswith("["), listed).when(F.coalesce("t.suite", F.lit("")) != "", F.array("t.suite")).otherwise(F.array().cast("array<string>"))
    raw = F.col("t.status")
    status = F.when(F.col("t.flaky"), "flaky").when(raw.isin("passed", "failed"), raw).otherwise("skipped")
    message = F.coalesce(_nothing(F.col("t.message")), first_line(F.col("t.trace")))
    full = F.array_join(F.concat(suites, F.array("t.name")), " > ")
    cases = tests.select(*case(doc=F.col("doc"), pos=F.col("i"), id=F.coalesce("t.id", F.concat(F.lit("tc-"), F.col("i") + 1)), name=F.col("t.name"), full_name=full, status=status, duration_ms=to_millis(F.col("t.duration")), error_message=message, file_path=F.col("t.filePath"), line=F.col("t.line"), retry_attempt=F.col("t.retries")))
    s = F.col("r.results.summary")
    header = parsed.join(summed(cases).select("doc", "case_ms", F.col("flaky").alias("n_flaky")), "doc", "left")
    explicit = F.when(F.coalesce(s["duration"], F.lit(0.0)) != 0, s["duration"]).when((s["stop"] > s["start"]) & (s["start"] > 0), s["stop"] - s["start"]).otherwise(F.coalesce(F.col("case_ms").cast("double"), F.lit(0.0)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    meta = F.to_json(F.struct(F.col("r.reportFormat").alias("reportFormat"), F.col("r.specVersion").alias("specVersion"), F.col("r.results.tool.version").alias("toolVersion"), s["start"].alias("start"), s["stop"].alias("stop")))
    reports = header.select("doc", F.col("r.results.tool.name").alias("framework"), s["passed"].alias("passed"), s["failed"].alias("failed"), (zero(s["skipped"]) + zero(s["pending"]) + zero(s["other"])).alias("skipped"), F.coalesce(s["flaky"], "n_flaky", F.lit(0)).alias("flaky"), s["tests"].alias("total"), F.when(explicit > 0, to_millis(explicit)).alias("duration_ms"), meta.alias("metadata"), F.when(s.isNull() | F.col("r.results.tests").isNull(), "Failed to parse CTRF JSON").alias("error"))
    return TestReports(cases, reports)
