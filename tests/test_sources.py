import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdigris.plans import adapters, render
from verdigris.sources import coverage, detect, json_tests, keys, xml, xml_tests
from verdigris.sources.registry import DEFAULT, with_defaults
from verdigris.sources.reports import events, with_percentages


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc string, content string")


def cases(reports):
    return [r.asDict() for r in reports.cases.orderBy("doc", "pos").collect()]


def one(reports):
    return reports.reports.first().asDict()


def test_junit(spark):
    text = """﻿<?xml version="1.0"?><testsuites name="all"><testsuite name="s" file="s.ts" time="1.5">
      <testcase name="a" classname="s" time="0.1"/>
      <testcase name="b" time="x"><failure message="no &lt;b&gt;">long</failure><failure message="second"/></testcase>
      <testcase name="c" file="c.ts" line="7" time="0.2"><error><![CDATA[ boom ]]></error></testcase>
      <testsuite name="inner"><testcase name="d" time="-1"><skipped/><failure message="x"/></testcase></testsuite>
      <testcase><failure/></testcase></testsuite></testsuites>"""
    got = xml_tests.junit(docs(spark, text))
    rows = cases(got)
    assert [(r["id"], r["full_name"], r["status"], r["duration_ms"], r["error_message"], r["file_path"], r["line"]) for r in rows] == [
        ("tc-1", "s > a", "passed", 100, None, "s.ts", None),
        ("tc-2", "s > b", "failed", 0, "no &lt;b&gt;", "s.ts", None),
        ("tc-3", "s > c", "failed", 200, "boom", "c.ts", 7),
        ("tc-4", "inner > d", "skipped", 0, None, None, None),
        ("tc-5", "s > Unknown Test", "failed", 0, "Test failed", "s.ts", None),
    ]
    r = one(got)
    assert (r["passed"], r["failed"], r["skipped"], r["total"], r["duration_ms"], r["error"]) == (1, 3, 1, 5, 1500, None)
    assert json.loads(r["metadata"]) == {"suiteName": "all", "suiteCount": 1}


def test_junit_without_cases_or_with_broken_xml(spark):
    got = xml_tests.junit(docs(spark, "<testsuite/>", "<testsuite></x>", "", None))
    assert {r["error"] for r in got.reports.collect()} == {"No test cases found in XML"}
    assert got.cases.count() == 0


def test_trx(spark):
    text = """<t:TestRun xmlns:t="u" id="1" name="n"><t:Results>
      <t:UnitTestResult testName="N.C.M(a: 1.5)" outcome="Passed" duration="00:00:01.5"/>
      <t:UnitTestResult testName="Solo" outcome="Timeout"><t:Output><t:ErrorInfo><t:Message> slow </t:Message></t:ErrorInfo></t:Output></t:UnitTestResult>
      <t:UnitTestResult testName="N.C.S" outcome="NotExecuted"/></t:Results></t:TestRun>"""
    got = xml_tests.trx(docs(spark, text))
    assert [(r["full_name"], r["status"], r["duration_ms"], r["error_message"]) for r in cases(got)] == [("N.C > M(a: 1.5)", "passed", 1500, None), ("Solo", "timedOut", 0, "slow"), ("N.C > S", "skipped", 0, None)]
    r = one(got)
    assert (r["passed"], r["failed"], r["skipped"], r["duration_ms"]) == (1, 1, 1, 1500)
    assert [r["status"] for r in events(got.cases).orderBy("pos").collect()] == ["passed", "failed", "skipped"]


def jest(**more):
    tests = [{"fullName": "s a", "title": "a", "status": "passed", "duration": 1.6, "failureMessages": [], "location": {"line": 3}}, {"fullName": "s b", "title": "b", "status": "pending", "duration": -1, "failureMessages": []}, {"fullName": "s c", "title": "c", "status": "failed", "duration": None, "failureMessages": ["x", "y"]}]
    return json.dumps({"numTotalTests": 3, "numPassedTests": 1, "numFailedTests": 1, "numPendingTests": 1, "numTodoTests": 0, "success": False, "startTime": 1, "testResults": [{"name": "C:\\w\\tests\\a.ts", "startTime": 10, "endTime": 15.4, "assertionResults": tests}], **more})


def test_jest_and_vitest(spark):
    got = json_tests.jest(docs(spark, jest(wasInterrupted=False), jest(note="vitest"), jest(), "{}", "no json"))
    rows = cases(got)[:3]
    assert [(r["full_name"], r["status"], r["duration_ms"], r["error_message"], r["file_path"], r["line"]) for r in rows] == [("s a", "passed", 2, None, "tests/a.ts", 3), ("s b", "skipped", None, None, "tests/a.ts", None), ("s c", "failed", None, "x\ny", "tests/a.ts", None)]
    reports = {r["doc"]: r for r in got.reports.collect()}
    assert [reports[d]["framework"] for d in "012"] == ["jest", "vitest", "jest"]
    assert (reports["0"]["skipped"], reports["0"]["duration_ms"], reports["0"]["error"]) == (1, 5, None)
    assert reports["3"]["error"] and reports["4"]["error"]


def test_playwright(spark):
    spec = lambda title, status, *results: {"title": title, "id": title, "file": "a.spec.ts", "line": 1, "tests": [{"projectName": p, "status": status, "results": list(results)} for p in ("one", "two")]}
    deep = {"title": "deep", "file": "f", "specs": [spec("z", "unexpected", {"status": "failed", "duration": 1}, {"status": "timedOut", "duration": 2.5, "retry": 1, "error": {"message": "late"}})], "suites": []}
    suite = {"title": "a.spec.ts", "file": "f", "specs": [spec("x", "flaky", {"status": "passed", "duration": -4})], "suites": [{"title": "group", "file": "f", "suites": [deep], "specs": [spec("y", "expected")]}]}
    text = json.dumps({"config": {"projects": [{"name": "one"}, {"name": "two"}]}, "suites": [suite, {"title": "b/c", "file": "f", "specs": [spec("w", "odd")]}], "stats": {"startTime": "t", "duration": 9, "expected": 2, "unexpected": 2, "flaky": 2, "skipped": 2}})
    got = json_tests.playwright(docs(spark, text))
    rows = cases(got)
    assert [(r["id"], r["full_name"], r["status"], r["duration_ms"], r["error_message"], r["retry_attempt"]) for r in rows[::2]] == [
        ("x-one", "a.spec.ts > x [one]", "flaky", 0, None, None),
        ("y-one", "a.spec.ts > group > y [one]", "passed", None, None, None),
        ("z-one", "a.spec.ts > group > deep > z [one]", "timedOut", 3, "late", 1),
        ("w-one", "w [one]", "skipped", None, None, None),
    ]
    assert (one(got)["total"], one(got)["failed"]) == (8, 2)


def test_ctrf(spark):
    tests = [{"name": "a", "status": "passed", "duration": 5, "suite": ["s", "t"]}, {"name": "b", "status": "failed", "duration": 1, "suite": "s", "message": "", "trace": "first\r\nsecond", "retries": 2}, {"name": "c", "status": "failed", "duration": 1, "flaky": True, "id": "own"}, {"name": "d", "status": "pending", "duration": 0, "suite": ""}]
    base = {"reportFormat": "CTRF", "results": {"tool": {"name": "tool"}, "summary": {"tests": 4, "passed": 1, "failed": 1, "skipped": 1, "pending": 1, "other": 1, "start": 100, "stop": 150}, "tests": tests}}
    got = json_tests.ctrf(docs(spark, json.dumps(base)))
    assert [(r["id"], r["full_name"], r["status"], r["error_message"], r["retry_attempt"]) for r in cases(got)] == [("tc-1", "s > t > a", "passed", None, None), ("tc-2", "s > b", "failed", "first", 2), ("own", "c", "flaky", None, None), ("tc-4", "d", "skipped", None, None)]
    r = one(got)
    assert (r["framework"], r["skipped"], r["flaky"], r["duration_ms"]) == ("tool", 3, 1, 50)


def files(reports):
    return [(r["path"], r["lines_covered"], r["lines_total"], r["branches_covered"], r["branches_total"], r["functions_covered"], r["functions_total"]) for r in reports.files.orderBy("pos").collect()]


def test_lcov(spark):
    text = "TN:\r\nSF:a.ts\r\nDA:1,1\r\nLF:5\r\nLH:3\r\nLH:4\r\nBRF:2\r\nBRH:x\r\nend_of_record\r\nLF:99\r\nSF:\r\nLF:7\r\nSF:a.ts\r\nFNF:2\r\nFNH:1"
    got = coverage.lcov(docs(spark, text, "nothing"))
    assert files(got) == [("a.ts", 4, 5, 0, 2, 0, 0), ("a.ts", 0, 0, 0, 0, 1, 2)]
    assert [r["error"] is None for r in got.reports.orderBy("doc").collect()] == [True, False]


COBERTURA = """<coverage line-rate="0.5" {root}><packages><package><classes>
 <class filename="a.py"><methods><method hits="1"/><method line-rate="0"/></methods><lines><line hits="1"/><line hits="0" branch="true" condition-coverage="50% (1/2)"/></lines></class>
 <class filename="a.py"><methods/><lines><line hits="2"/><line hits="3"/><line hits="0"/></lines></class>
 <class filename="m.py"><methods><method hits="1"><lines><line hits="1"/></lines></method></methods></class></classes></package></packages></coverage>"""


def test_cobertura(spark):
    got = coverage.cobertura(docs(spark, COBERTURA.format(root="")))
    assert files(got) == [("a.py", 3, 5, 1, 2, 1, 2)]
    assert one(got)["lines_total"] == 5
    own = coverage.cobertura(docs(spark, COBERTURA.format(root='lines-valid="50" lines-covered="40"')))
    r = one(own)
    assert (r["lines_covered"], r["lines_total"], r["branches_total"], r["functions_total"]) == (40, 50, 0, 0)
    assert one(coverage.cobertura(docs(spark, "<x/>")))["error"]


def test_jacoco(spark):
    counter = lambda kind, missed, covered: f'<counter type="{kind}" missed="{missed}" covered="{covered}"/>'
    text = f'<report name="r"><package name="p/q"><class name="p/q/A" sourcefilename="A.java">{counter("LINE", 1, 1)}</class><sourcefile name="A.java">{counter("LINE", 2, 3)}{counter("METHOD", 0, 1)}</sourcefile></package>{counter("LINE", 5, 15)}</report>'
    got = coverage.jacoco(docs(spark, text))
    assert files(got) == [("p/q/A.java", 3, 5, 0, 0, 1, 1)]
    assert one(got)["lines_total"] == 20
    classes = f'<report name="r"><package name="p"><class name="p/A" sourcefilename="A.java">{counter("LINE", 1, 1)}</class><class name="p/A$B" sourcefilename="A.java">{counter("LINE", 0, 4)}</class></package></report>'
    assert files(coverage.jacoco(docs(spark, classes))) == [("p/A.java", 5, 6, 0, 0, 0, 0)]


def test_clover(spark):
    text = '<coverage clover="4"><project name="p"><metrics statements="9" coveredstatements="8"/><package name="k"><file name="a.js" path="/x/a.js"><metrics statements="4" coveredstatements="3" conditionals="2" coveredconditionals="1" methods="1" coveredmethods="1"/><metrics statements="99"/></file><file name="b.js"><line type="stmt" count="1"/><line type="cond" truecount="1" falsecount="0"/><line type="method" count="0"/></file><file name="c.js"/></package></project></coverage>'
    got = coverage.clover(docs(spark, text))
    assert files(got) == [("/x/a.js", 3, 4, 1, 2, 1, 1), ("b.js", 2, 3, 1, 2, 0, 1)]
    assert one(got)["lines_total"] == 9
    assert with_percentages(got.reports).first()["lines_percent"] == 89.0


def detected(spark, filename, content):
    row = with_defaults().detect(spark.createDataFrame([(filename, filename, content)], "doc string, filename string, content string")).first()["format"]
    return (row["id"], row["score"]) if row else None


@pytest.mark.parametrize(
    ("filename", "content", "want"),
    [
        ("a.xml", "<testsuite/>", ("junit", 100)),
        ("a.XML", "<testsuite/>", None),
        ("r.json", '{"numTotalTests":1,"testResults":[],"success":true}', ("jest-vitest-json", 90)),
        ("r.json", '{"config":{},"suites":[],"stats":{}}', ("playwright-json", 90)),
        ("r.json", '{"reportFormat":"CTRF","results":{}}', ("ctrf", 95)),
        ("r.json", '{"results":{"tests":[]}}', ("ctrf", 70)),
        ("x/LCOV.info", "", ("lcov", 100)),
        ("c.txt", "SF:a\nDA:1,1\nend_of_record", ("lcov", 95)),
        ("c.txt", "SF:a\nend_of_record", ("lcov", 80)),
        ("c.txt", "SF:a", None),
        ("a.trx", "<TestRun/>", ("trx", 100)),
        ("a.xml", '<TestRun xmlns="http://microsoft.com/schemas/VisualStudio/TeamTest/2010"/>', ("trx", 95)),
        ("a.xml", "<TestRun/>", ("trx", 70)),
        ("Cobertura.xml", "", ("cobertura", 95)),
        ("c.xml", '<coverage line-rate="1"><classes>', ("cobertura", 85)),
        ("c.xml", '<report><counter type="LINE"/>', ("jacoco", 95)),
        ("c.xml", "<report><sessioninfo/><package/>", ("jacoco", 90)),
        ("c.xml", '<coverage clover="4"><project>', ("clover", 90)),
        ("c.xml", '<coverage><project><metrics statements="1"/>', ("clover", 80)),
        ("a.md", "text", None),
    ],
)
def test_detection(spark, filename, content, want):
    assert detected(spark, filename, content) == want


def test_registry_ties(spark):
    fixed = lambda score: lambda t, n: F.lit(score)
    make = lambda id_, priority, score: detect.Format(id_, id_, priority, "testReport", fixed(score))
    best = lambda *formats: spark.range(1).select(detect.Registry(formats).best(F.lit(""), F.lit("x")).alias("b")).first()["b"]
    assert best(make("a", 1, 60), make("b", 2, 60))["id"] == "b"
    assert best(make("a", 1, 60), make("b", 1, 60))["id"] == "a"
    assert best(make("a", 1, 100), make("b", 9, 100))["id"] == "a"
    assert best(make("a", 1, 49)) is None
    with pytest.raises(ValueError, match="Duplicate parser id: junit"):
        with_defaults().register(DEFAULT[0])


def walked(text, depth, first_object):
    """Keys of a text one character at a time."""
    at, level, key, found = 0, 0, False, []
    while at < len(text):
        c, start = text[at], at
        at += 1
        if c == '"':
            while at < len(text) and text[at] != '"':
                at += 2 if text[at] == "\\" else 1
            if level == depth:
                if key:
                    found.append(text[start + 1 : at])
                key = False
            at += 1
        elif c in "{[":
            level += 1
            key = c == "{" if level == depth else key
        elif c in "}]":
            level = max(0, level - 1)
            if first_object and level == 0:
                return found
        elif c == "," and level == depth:
            key = True
    return found


def test_keys_of_any_text():
    """Malformed texts too: random runs of the characters that matter."""
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choices(['"', "\\", "{", "}", "[", "]", ",", "a", ":", "é"], weights=[6, 2, 4, 2, 2, 2, 3, 3, 2, 1], k=r.randrange(0, 40)))
        for depth in (1, 2, 3):
            for first in (False, True):
                assert keys.keys(text.encode(), depth, first) == walked(text, depth, first), (text, depth, first)


def test_keys_of_many_texts_at_once():
    """Texts that are indexed together don't run into each other: open strings, backslashes and braces end with a text."""
    r = random.Random(6)
    texts = ["".join(r.choices('"\\{}[],aé', weights=[6, 2, 4, 2, 2, 2, 3, 3, 1], k=r.randrange(0, 30))) for _ in range(2000)]
    for depth in (1, 2):
        for first in (False, True):
            assert keys.Texts([t.encode() for t in texts]).keys(depth, first).to_pylist() == [walked(t, depth, first) for t in texts]
    small = ['{"a":{"b":[1,2]},"c":"\\"d"}', None, "x"] * 20000
    began = time.process_time()
    got = keys.both(pa.array(small), 2).to_pylist()
    assert time.process_time() - began < 4
    assert got == [{"top": ["a", "c"], "deep": ["b"]}, {"top": None, "deep": None}, {"top": None, "deep": []}] * 20000


def test_a_text_is_scored_once(spark):
    """The winner is picked from a column of scores, whose expressions are there once in a plan."""
    files = spark.createDataFrame([("d", "<testsuites/>", "out/a.xml")], "doc string, content string, filename string")
    found = with_defaults().detect(files)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<testsuite)") == 1 and found.first()["format"].asDict() == {"id": "junit", "name": "JUnit XML", "score": 100, "result_type": "testReport"}
    fixed = lambda s: lambda text, name: F.lit(s).cast("int")
    make = lambda id_, priority, score: detect.Format(id_, id_, priority, "testReport", fixed(score))
    best = lambda *formats: spark.range(1).select(detect.Registry(formats).best(F.lit(""), F.lit("x")).alias("b")).first()["b"]
    assert best(make("a", -5, 2**31 - 1), make("b", 2**31 - 1, 100))["id"] == "b" and best(make("a", -5, 120), make("b", 9, 70))["score"] == 120
    assert best(make("a", 9, None), make("b", -1, 50))["id"] == "b" and best(make("a", 9, None)) is None and best(make("a", 1, -7)) is None


def test_many_raw_sections_take_linear_time(spark):
    """A section goes to the elements whose text is kept, not to all around it."""
    took = []
    for n in (500, 4000):
        text = "<testsuites><testsuite name='s'><system-out>" + f"<![CDATA[{'x' * 2000}]]>" * n + "</system-out><testcase name='a'/></testsuite></testsuites>"
        out = xml._Buffers()
        began = time.process_time()
        xml._read("d", text, xml.Asked(frozenset({"testcase"}), frozenset({"testcase"}), frozenset({"testsuite"}), frozenset({"failure"}), False), out)
        took.append(time.process_time() - began)
        assert out.batch().num_rows == 2
    assert took[1] < 40 * max(took[0], 0.001)


def test_playwright_suites_of_any_depth(spark):
    """One job, whatever the depth: suites three hundred deep beside flat ones."""
    suite = {"title": "end", "specs": [{"title": "t", "id": "s", "tests": [{"status": "expected"}]}]}
    for i in range(300):
        suite = {"title": f"n{i}", "suites": [suite]}
    text = json.dumps({"config": {}, "suites": [suite, {"title": 7, "specs": [{"title": "u", "tests": [{"status": "skipped"}]}, None], "suites": None}, None], "stats": {}})
    tracker, group = spark.sparkContext.statusTracker(), "suites of any depth"
    table = docs(spark, text)
    spark.sparkContext.setJobGroup(group, group)
    got = json_tests.playwright(table)
    assert len(tracker.getJobIdsForGroup(group)) == 0
    names = [r["full_name"] for r in cases(got)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert names[0].startswith("n299 > n298") and names[0].endswith("n0 > end > t") and names[1] == "7 > u"


def test_keys(spark):
    at = lambda text, depth: spark.range(1).select(detect.keys_at_depth(F.lit(text), depth)).first()[0]
    top = lambda text: spark.range(1).select(detect.top_keys(F.lit(text))).first()[0]
    assert at('{"a":[{"b":1,"c":{"d":2}},{"e":"f"}]}', 3) == ["b", "c", "e"] and at('{"a":[{"b":1,"c":{"d":2}}]}', 4) == ["d"]
    assert at('{"a":{"x":1', 2) == ["x"] and at('["u","v"]', 1) == ["v"] and at("none", 1) == []
    assert top('{"a":{"x":1},"b\\"c":[{"d":2}], "e"') == ["a", 'b\\"c', "e"] and top('{"a":1} {"b":2}') == ["a"] and top('x{"a":1}') == []
    assert top('{"long":"' + 'x\\"' * 20000 + '", "b":') == ["long", "b"]
    got = spark.range(1).select(detect.top_keys(F.lit('{"a":{"x":1},"b":[{"c":2}]}')).alias("one"), detect.keys_at_depth(F.lit('{"a":{"x":1},"b":2}'), 2).alias("two"), detect.top_keys(F.lit("[1]")).alias("none"), detect.keys_at_depth(F.lit("{}"), 0).alias("zero")).first()
    assert (got["one"], got["two"], got["none"], got["zero"]) == (["a", "b"], ["x"], [], [])


def test_cobertura_reads_elements_once(spark):
    """Files, sums and the root's own counts come from one pass; of several roots the last one counts, as it stands."""
    whole = '<coverage lines-valid="9" lines-covered="4">'
    body = '<class filename="f"><methods><method hits="1"/></methods><lines><line hits="1"/><line hits=" 0 "/></lines></class><class filename="g"><methods><method hits="1"/></methods></class>'
    texts = [f"{whole}{body}</coverage>", f"<coverage>{body}</coverage>", f"{whole}<coverage lines-valid='x'>{body}</coverage></coverage>", f"{whole}<coverage lines-valid='7' lines-covered='2' branches-valid='3'/></coverage>", f"<coverage lines-valid='7'>{body}", "<x/>", None]
    got = coverage.cobertura(spark.createDataFrame(list(map(list, enumerate(texts))), "doc int, content string"))
    assert got.reports._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = {str(r["doc"]): (r["lines_covered"], r["lines_total"], r["branches_total"], r["functions_total"], r["error"] is None) for r in got.reports.collect()}
    assert rows == {"0": (4, 9, 0, 0, True), "1": (1, 2, 0, 1, True), "2": (1, 2, 0, 1, True), "3": (2, 7, 3, 0, True), "4": (1, 2, 0, 1, True), "5": (0, 0, 0, 0, False), "6": (0, 0, 0, 0, False)}
    assert len(got.reports.collect()) == len(texts) and sorted({r["path"] for r in got.files.collect()}) == ["f"]


def test_playwright_cases_need_no_exchange(spark):
    """Cases are numbered where they are walked: own specs first, then child suites, values that are no tests left out."""
    test = {"projectName": "p", "status": "expected"}
    spec = lambda title, *tests: {"title": title, "id": title, "tests": list(tests)}
    inner = {"title": "in", "specs": [spec("d", test), spec("e", 1, test)], "suites": [{"title": "deep", "specs": [spec("f", None, test)]}]}
    text = json.dumps({"config": {"projects": [{"name": "p"}, {"name": "q"}]}, "suites": [{"title": "s", "suites": [inner, {"specs": [spec("g", test)]}], "specs": [spec("a", test, test), 5, {"title": "b", "tests": {}}, spec("c", test)]}, {"specs": [spec("h", test)]}], "stats": {"expected": 9}})
    found = json_tests.playwright(spark.createDataFrame([("x", text), ("cut", text[:-3]), ("none", None)], "doc string, content string")).cases
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = [(r["doc"], r["pos"], r["full_name"]) for r in found.orderBy("doc", "pos").collect()]
    names = ["s > a [p]", "s > a [p]", "s > c [p]", "s > in > d [p]", "s > in > deep > f", "s > in > deep > f [p]", "s > g [p]", "h [p]"]
    assert got == [("x", i + 1, n) for i, n in enumerate(names)]


def test_rendering_deals_lines_out_once(spark):
    """Numbering and grouping by document share one exchange."""
    for write in (render.junit, render.playwright, render.cobertura):
        plan = write(adapters.lines(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
