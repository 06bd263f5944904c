"""Report documents written from order lines with SQL string functions, to be read back by the parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(lines: DataFrame, item: Column, start: Column | str, end: Column | str, sep: str = "") -> DataFrame:
    """``doc, content``: a text from an item for each line, in order; ``start`` and ``end`` may depend on ``doc``."""
    ordered = F.array_sort(F.collect_list(F.struct("n", item.alias("item"))))
    body = F.array_join(F.transform(ordered, lambda x: x["item"]), sep)
    doc = F.col("doc").cast("string")
    return lines.groupBy("doc").agg(body.alias("body")).select(doc.alias("doc"), _text(start, F.col("body"), end).alias("content"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def junit(lines: DataFrame) -> DataFrame:
    c = F.col
    # failures in each of the ways in which they are written: attribute, text on lines of its own, CDATA, both
    ways = (('<failure message="', '"/>'), ("<failure>\n  \t", "\n</failure>"), ("<error><![CDATA[ ", " ]]></error>"), ('<failure type="x" message="', '">expected &lt;b&gt;\n  at src/x.ts:1</failure>'))
    failed = F
    for i, (before, after) in enumerate(ways):
        failed = failed.when(c("n") % len(ways) == i, _text(before, c("message"), after))
    inner = F.when(c("status") == "failed", failed).when(c("status") == "skipped", "<skipped/>").otherwise("")
    item = _text('<testcase name="', c("name"), '" classname="', c("owner"), '" time="', F.format_string("%.3f", c("ms") / 1000), '">', inner, "</testcase>\n")
    item = F.when(c("n") % 3 == 0, _text('<testsuite name="inner" file="src/lines.test.ts" time="9">', item, "</testsuite>")).otherwise(item)
    return _joined(lines, item, '<?xml version="1.0"?><testsuites name="all"><testsuite name="lines" file="src/lines.test.ts">', "</testsuite></testsuites>")


def trx(lines: DataFrame) -> DataFrame:
    c = F.col
    outcome = F.when(c("status") == "passed", "Passed").when(c("status") == "failed", "Failed").otherwise("NotExecuted")
    inner = F.when(c("status") == "failed", _text("<Output><ErrorInfo><Message>\n ", c("message"), "\r\n</Message><StackTrace>at x</StackTrace></ErrorInfo></Output>")).otherwise("")
    item = _text('<UnitTestResult testName="Shop.', c("owner"), ".", c("name"), '(1)" outcome="', outcome, '" duration="00:00:00.', F.lpad(c("ms").cast("string"), 3, "0"), '0000">', inner, "</UnitTestResult>")
    return _joined(lines, item, '<TestRun id="r" name="n" xmlns="http://microsoft.com/schemas/VisualStudio/TeamTest/2010"><Results>', "</Results></TestRun>")


def jest(lines: DataFrame) -> DataFrame:
    c = F.col
    status = F.when(c("status") == "skipped", "pending").otherwise(c("status"))
    messages = F.when(c("status") == "failed", _text('["', c("message"), '"]')).otherwise("[]")
    item = _text('{"fullName":"', c("owner"), " ", c("name"), '","title":"', c("name"), '","status":"', status, '","duration":', c("ms"), ',"failureMessages":', messages, ',"meta":{}}')
    return _joined(lines, item, '{"numTotalTests":0,"numPassedTests":0,"numFailedTests":0,"numPendingTests":0,"success":true,"startTime":1,"testResults":[{"name":"/work/src/lines.test.ts","startTime":1,"endTime":2,"assertionResults":[', "]}]}", ",")


def playwright(lines: DataFrame) -> DataFrame:
    """Suites of uneven depth, tests with a retry, and in every other document two projects."""
    c = F.col
    status = F.when(c("status") == "passed", "expected").when(c("status") == "failed", "unexpected").otherwise("skipped")
    errors = F.when(c("status") == "failed", _text('[{"message":"', c("message"), '"}]')).otherwise("[]")
    again = c("n") % 4 == 1
    before = F.when(again, '{"status":"failed","duration":1,"retry":0,"errors":[{"message":"first"}]},').otherwise("")
    specs = _text('"specs":[{"title":"', c("name"), '","id":"s', c("n"), '","file":"lines.spec.ts","line":', c("n"), ',"tests":[{"projectName":"one","status":"', status, '","results":[', before, '{"status":"x","duration":', c("ms"), ',"retry":', F.when(again, 1).otherwise(0), ',"errors":', errors, "}]}]}]")
    inner = F.when(c("n") % 3 == 0, _text('"suites":[{"title":"a/b","suites":[{"title":"deep",', specs, "}]}]")).otherwise(specs)
    item = _text('{"title":"', c("owner"), '","file":"lines.spec.ts",', inner, "}")
    projects = F.when(c("doc") % 2 == 1, '{"name":"one"},{"name":"two"}').otherwise('{"name":"one"}')
    head = _text('{"config":{"projects":[', projects, ']},"stats":{"expected":0,"unexpected":0,"flaky":0,"skipped":0,"duration":1},"suites":[{"title":"lines.spec.ts","suites":[{"title":"all","specs":[],"suites":[')
    return _joined(lines, item, head, "]}]}]}", ",")


def ctrf(lines: DataFrame) -> DataFrame:
    c = F.col
    message = F.when(c("status") == "failed", _text(',"message":"', c("message"), '"')).otherwise("")
    item = _text('{"name":"', c("name"), '","status":"', c("status"), '","duration":', c("ms"), ',"suite":["all","', c("owner"), '"]', message, "}")
    return _joined(lines, item, '{"reportFormat":"CTRF","results":{"tool":{"name":"t"},"summary":{"tests":0,"passed":0,"failed":0,"skipped":0,"pending":0,"other":0},"tests":[', "]}}", ",")


def lcov(lines: DataFrame) -> DataFrame:
    """The last record of every fourth document has no end, and its first one no file."""
    c = F.col
    item = _text("TN:\nSF:", c("path"), "\nDA:1,1\nLF:", c("total"), "\nLH:", F.least("hit", "total"), "\nBRF:2\nBRH:1\n")
    odd = c("doc") % 4 == 0
    return _joined(lines, item, F.when(odd, "SF:\nLF:5\nend_of_record\n").otherwise(""), F.when(odd, "").otherwise("end_of_record\n"), "end_of_record\n")


def cobertura(lines: DataFrame) -> DataFrame:
    c = F.col
    hit = F.least("hit", "total")
    body = F.concat(F.repeat(F.lit('<line number="1" hits="1"/>'), hit), F.repeat(F.lit('<line number="2" hits="0" branch="true" condition-coverage="50% (1/2)"/>'), c("total") - hit))
    item = _text('<class name="c" filename="', c("path"), '"><methods><method name="m" hits="', hit - 1, '"/></methods><lines>', body, "</lines></class>")
    own = F.when(c("doc") % 2 == 0, _text(' lines-valid="', c("doc"), '" lines-covered="1" branches-valid="7"')).otherwise("")
    return _joined(lines, item, _text('<coverage line-rate="0.5"', own, "><packages><package><classes>"), "</classes></package></packages></coverage>")


def jacoco(lines: DataFrame) -> DataFrame:
    """Every third document has classes alone, of which those of one file are one."""
    c = F.col
    hit, file = F.least("hit", "total"), F.substring_index("path", "/", -1)
    counters = _text('<counter type="LINE" missed="', c("total") - hit, '" covered="', hit, '"/><counter type="METHOD" missed="1" covered="', hit, '"/>')
    item = F.when(c("doc") % 3 == 0, _text('<class name="src/C', c("n"), '" sourcefilename="', file, '"><method name="m"/>', counters, "</class>")).otherwise(_text('<sourcefile name="', file, '">', counters, "</sourcefile>"))
    return _joined(lines, item, '<report name="r"><package name="src">', "</package></report>")


def clover(lines: DataFrame) -> DataFrame:
    """Files with metrics, and every other one with lines alone: statements, a condition and a method."""
    c = F.col
    hit = F.least("hit", "total")
    metrics = _text('<metrics statements="', c("total"), '" coveredstatements="', hit, '" conditionals="2" coveredconditionals="1" methods="1" coveredmethods="0"/>')
    alone = F.concat(F.repeat(F.lit('<line type="stmt" count="3"/>'), hit), F.repeat(F.lit('<line type="stmt" count="0"/>'), c("total") - hit), F.lit('<line type="cond" truecount="1" falsecount="0"/><line type="method" count="0"/>'))
    item = _text('<file path="', c("path"), '">', F.when(c("n") % 2 == 0, alone).otherwise(metrics), "</file>")
    return _joined(lines, item, '<coverage clover="4"><project><package name="p">', "</package></project></coverage>")
