import os

import pytest

from verdigris.sources import ignore
from verdigris.sources.registry import DEFAULT_PATTERNS, find_reports


def table(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def rules(spark, files):
    return ignore.rules(spark.createDataFrame(list(files.items()), "folder string, content string"))


CASES = [
    ({"": "*.log"}, {"a.log", "x/b.log"}, {"a.txt", "log"}),
    ({"": "build/"}, {"build/a", "x/build/y/b"}, {"y/build", "x/builds/a"}),
    ({"": "/build"}, {"build/a", "build"}, {"x/build/a"}),
    ({"": "a/*.txt"}, {"a/b.txt"}, {"a/c/b.txt", "x/a/b.txt"}),
    ({"": "a/**/b"}, {"a/b", "a/x/y/b"}, {"c/a/b"}),
    ({"": "docs/**"}, {"docs/a", "docs/a/b"}, {"docs"}),
    ({"": "*.xml\n!keep.xml"}, {"a.xml"}, {"keep.xml", "x/keep.xml"}),
    ({"": "!keep.xml\n*.xml"}, {"keep.xml"}, set()),
    ({"": "out/\n!out/keep.xml"}, {"out/keep.xml"}, set()),  # no way back below an ignored folder
    ({"": "*.tmp", "x": "!*.tmp"}, {"a.tmp", "y/a.tmp"}, {"x/a.tmp", "x/y/a.tmp"}),
    ({"x": "/a"}, {"x/a", "x/a/b"}, {"a", "x/y/a"}),
    ({"": "# note\n\n\\#a\n\\!b\nc\\ \n[ab]?.t  "}, {"#a", "!b", "c ", "ax.t"}, {"# note", "cx.t", "axx.t"}),
    ({"": "[!a]x"}, {"bx"}, {"ax"}),
    ({"": None}, set(), {"a"}),
]


@pytest.mark.parametrize(("files", "gone", "stays"), CASES)
def test_rules(spark, files, gone, stays):
    got = {r["path"] for r in ignore.ignored(table(spark, *gone, *stays, None, ""), rules(spark, files)).collect()}
    assert got == gone


def test_patterns_open_ignored_folders(spark):
    """A pattern finds its files below a folder that is ignored, if it names the folder."""
    paths = ("test-reports/a.xml", "x/test-reports/deep/b.xml", "coverage/lcov.info", "node_modules/p/junit.xml", "junit-1.xml", "src/a.ts", "dist/test-results/c.xml", "other.xml")
    got = ignore.discovered(table(spark, *paths), rules(spark, {"": "test-reports\ncoverage/\nnode_modules\n*.xml\ndist"}), DEFAULT_PATTERNS)
    assert {r["path"] for r in got.collect()} == {"test-reports/a.xml", "x/test-reports/deep/b.xml", "coverage/lcov.info", "junit-1.xml"}
    assert ignore.discovered(table(spark), rules(spark, {"": ""}), DEFAULT_PATTERNS).count() == 0


def test_reports_of_a_project(spark, tmp_path):
    """Hidden folders are read, shut ones and old files are not."""
    for name in (".verdigris/reports/a.xml", "test-results/b.xml", "build/junit.xml", "sub/gone/junit-2.xml", "sub/kept/junit-3.xml", "fixtures/junit.xml", "test-results/old.xml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"<testsuite name='{name}'/>")
    (tmp_path / ".gitignore").write_text("build/\n.verdigris\n*.xml\n")
    (tmp_path / "sub" / ".gitignore").write_text("/gone\n")
    os.utime(tmp_path / "test-results/old.xml", (1000, 1000))
    got = find_reports(spark, str(tmp_path), modified_after=2000)
    assert sorted(r["filename"] for r in got.collect()) == ["a.xml", "b.xml", "junit-3.xml"]
    assert find_reports(spark, str(tmp_path / "fixtures"), ("*.json",)).count() == 0
