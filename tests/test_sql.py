import pytest
from pyspark.sql import functions as F

from verdigris import sql
from verdigris.functions import scalars
from verdigris.sources.detect import Format, Registry
from verdigris.sources.registry import DEFAULT

FILES = [
    ("a.xml", '<testsuite name="s"><testcase name="x" time="1"/><testcase name="y"><failure message="boom"/></testcase></testsuite>'),
    ("lcov.info", "SF:a.ts\nLF:4\nLH:3\nend_of_record"),
    ("empty.xml", "<testsuite/>"),
    ("note.md", "nothing"),
]


@pytest.fixture(scope="module")
def attached(spark):
    sql.attach(spark, spark.createDataFrame([(n, n, t) for n, t in FILES], "doc string, filename string, content string"), prefix="t_")
    return spark


def test_scalar_functions_are_the_columns(spark):
    sql.register(spark)
    rows = spark.createDataFrame([("Timeout 12345 at /x/y/a.ts:3:4\t id=9 ", "é"), ("abc", "abd"), ("", "x"), ("same", "same")], "a string, b string")
    got = rows.selectExpr("normalize_error(a) n", "edit_distance(a, b) d", "error_similarity(a, b) s", "health_label(75D) l", "health_label(-1D) c", "coverage_percentage(1, 3) p", "coverage_percentage(0, 0) z", "pass_rate(1, 4) r", "round2(1.005D) t").collect()
    a, b = F.col("a"), F.col("b")
    want = rows.select(scalars.normalize_error(a, True), scalars.edit_distance(a, b), scalars.similarity(a, b), scalars.health_label(F.lit(75.0)), F.lit("critical"), F.lit(33.0), F.lit(0.0), F.lit(25.0), scalars.round2(F.lit(1.005))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert "PythonUDF" not in rows.selectExpr("normalize_error(a)")._jdf.queryExecution().executedPlan().toString()


def test_views_and_table_functions(attached):
    q = lambda text: [tuple(r) for r in attached.sql(text).collect()]
    assert q("SELECT name, status FROM t_parse_report('a.xml') ORDER BY pos") == [("x", "passed"), ("y", "failed")]
    assert q("SELECT path, lines_covered, lines_total FROM t_parse_coverage('lcov.info')") == [("a.ts", 3, 4)]
    assert q("SELECT id, score FROM t_detect_format('a.xml')") == [("junit", 100)]
    assert q("SELECT doc, id FROM t_report_formats WHERE doc = 'note.md'") == [("note.md", None)]
    assert q("SELECT format, count(*) FROM t_test_cases GROUP BY format") == [("junit", 2)]
    assert q("SELECT c.format, r.lines_covered FROM t_coverage_files c JOIN t_coverage_reports r USING (doc)") == [("lcov", 3)]


@pytest.mark.parametrize(
    ("call", "error"),
    [
        ("t_parse_report('lcov.info')", r"File detected as coverage format \(lcov\), not a test report. Use parse_coverage\(\) instead."),
        ("t_parse_report('note.md')", "No parser matched the input"),
        ("t_parse_report('empty.xml')", "No test cases found in XML"),
        ("t_parse_coverage('a.xml')", "Not a coverage format"),
        ("t_parse_coverage('note.md')", "No coverage parser matched the input"),
    ],
)
def test_files_of_the_wrong_kind(attached, call, error):
    with pytest.raises(Exception, match=error):
        attached.sql(f"SELECT * FROM {call}").collect()


def test_formats_of_your_own(spark):
    """A registry's further format is read by the same views."""
    own = Format("lines", "Lines", 1, "testReport", lambda t, n: F.when(n.endswith(".lines"), 100).otherwise(0), DEFAULT[0].read)
    files = spark.createDataFrame([("x.lines", "x.lines", FILES[0][1])], "doc string, filename string, content string")
    sql.attach(spark, files, Registry((*DEFAULT, own)), prefix="own_")
    assert [tuple(r) for r in spark.sql("SELECT format, name FROM own_parse_report('x.lines') ORDER BY pos").collect()] == [("lines", "x"), ("lines", "y")]
