"""JUnit and TRX readers over element rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.scalars import class_of, method_of, strip, timespan_millis, to_millis
from verdigris.sources.reports import TestReports, case, case_number, report, summed
from verdigris.sources.xml import attr, attr_within, elements, number, only, owner, within


def junit(docs: DataFrame) -> TestReports:
    """JUnit XML: cases in the order of their ends, with the innermost suite's name and file as defaults."""
    rows = elements(docs, "testsuites", "testsuite", "testcase", "failure", "error", "skipped", near=("testcase",), carried=("testsuite",), texts=("failure", "error"), more=("end", "text", "empty", "fault"))
    inner = F.col("tag").isin("failure", "error", "skipped")
    message = F.struct(F.coalesce(attr("message"), F.nullif(strip(F.col("text")), F.lit(""))).alias("message"))
    # a case is the group of its own row and those of its outcomes
    grouped = rows.withColumn("case", owner("testcase")).filter((F.col("tag") == "testcase") | inner).filter("case is not null")
    suite = F.when(within("testsuite").isNotNull(), F.coalesce(attr_within("testsuite", "name"), F.lit("Unknown Suite")))
    found = grouped.groupBy("doc", "case").agg(
        only("testcase", F.col("end")).alias("end"), only("testcase", F.col("attrs")).alias("attrs"), only("testcase", suite).alias("suite_name"), only("testcase", attr_within("testsuite", "file")).alias("suite_file"),
        *[F.min_by(message, F.when(F.col("tag") == t, F.col("id"))).alias(t) for t in ("failure", "error")],
        *[F.bool_or(F.col("tag") == t).alias(n) for t, n in (("skipped", "skip"), ("error", "is_error"), ("failure", "is_failure"))],
    ).filter("end is not null")
    name, cls = F.coalesce(attr("name"), F.lit("Unknown Test")), F.coalesce(attr("classname"), F.col("suite_name"), F.lit("Unknown Suite"))
    status = F.when(F.col("skip"), "skipped").when(F.col("is_error") | F.col("is_failure"), "failed").otherwise("passed")
    message = F.when(F.col("skip"), None).when(F.col("is_error"), F.coalesce(F.col("error.message"), F.lit("Test error"))).when(F.col("is_failure"), F.coalesce(F.col("failure.message"), F.lit("Test failed")))
    n = case_number("end")
    seconds = F.coalesce(number("time", "double"), F.lit(0.0))
    found = found.withColumn("n", n)
    cases = found.select(*case(doc=F.col("doc"), pos=F.col("n"), id=F.concat(F.lit("tc-"), F.col("n").cast("string")), name=name, full_name=F.when(cls == name, name).otherwise(F.concat_ws(" > ", cls, name)), status=status, duration_ms=to_millis(seconds * 1000), error_message=message, file_path=F.coalesce(attr("file"), F.col("suite_file")), line=number("line", "bigint")))
    tops = rows.withColumn("outer", within("testsuite")).groupBy("doc").agg(
        F.sum(F.when((F.col("tag") == "testsuite") & F.col("outer").isNull() & ~F.col("empty"), to_millis(number("time", "double") * 1000))).alias("suite_ms"),
        F.count_if((F.col("tag") == "testsuite") & F.col("outer").isNull()).alias("outer_suites"),
        F.count_if((F.col("tag") == "testsuite") & F.col("outer").isNotNull() & F.col("empty")).alias("inner_empty"),
        F.bool_or(F.col("tag") == "testsuites").alias("rooted"),
        F.max(F.when(F.col("tag") == "testsuites", attr("name"))).alias("root_name"),
        F.max("fault").alias("xml_error"),
    )
    counted = tops.join(summed(cases), "doc", "left")
    count = F.col("outer_suites") + F.when(F.col("rooted"), 0).otherwise(F.col("inner_empty"))
    meta = F.to_json(F.struct(F.col("root_name").alias("suiteName"), count.alias("suiteCount")), {"ignoreNullFields": "false"})
    duration = F.when(F.coalesce("suite_ms", F.lit(0)) > 0, F.col("suite_ms")).otherwise(F.coalesce("case_ms", F.lit(0)))
    reports = report(docs.select("doc"), counted, F.lit("junit"), duration, meta, "No test cases found in XML")
    return TestReports(cases, reports)


def trx(docs: DataFrame) -> TestReports:
    """TRX: results with namespaces stripped; class and method come from the dotted test name."""
    rows = elements(docs, "TestRun", "UnitTestResult", "Message", near=("Results", "UnitTestResult", "ErrorInfo"), texts=("Message",), local=True, more=("end", "text"))
    results = (F.col("tag") == "UnitTestResult") & within("Results").isNotNull() & F.col("end").isNotNull()
    told = (F.col("tag") == "Message") & within("ErrorInfo").isNotNull()
    message = F.nullif(strip(F.col("text")), F.lit(""))
    found = rows.withColumn("case", owner("UnitTestResult")).filter((results | told) & F.col("case").isNotNull()).groupBy("doc", "case").agg(
        only("UnitTestResult", F.col("end")).alias("end"), only("UnitTestResult", F.col("attrs")).alias("attrs"), F.min_by(message, F.when(told, F.col("id"))).alias("message")
    ).filter("end is not null").withColumn("n", case_number("end"))
    full = F.coalesce(attr("testName"), F.lit("Unknown Test"))
    cls, method = class_of(full), method_of(full)
    outcome = F.lower(attr("outcome"))
    status = F.when(outcome == "passed", "passed").when(outcome.isin("failed", "error", "aborted"), "failed").when(outcome == "timeout", "timedOut").otherwise("skipped")
    cases = found.select(*case(doc=F.col("doc"), pos=F.col("n"), id=F.concat(F.lit("tc-"), F.col("n").cast("string")), name=method, full_name=F.when(cls == "", method).otherwise(F.concat_ws(" > ", cls, method)), status=status, duration_ms=F.coalesce(timespan_millis(attr("duration")), F.lit(0)), error_message=F.col("message")))
    runs = rows.groupBy("doc").agg(F.max(F.when(F.col("tag") == "TestRun", attr("id"))).alias("run_id"), F.max(F.when(F.col("tag") == "TestRun", attr("name"))).alias("run_name"))
    counted = runs.join(summed(cases), "doc", "left")
    meta = F.to_json(F.struct(F.col("run_id").alias("runId"), F.col("run_name").alias("runName")), {"ignoreNullFields": "false"})
    return TestReports(cases, report(docs.select("doc"), counted, F.lit("trx"), F.coalesce("case_ms", F.lit(0)), meta, "No test cases found in TRX"))
