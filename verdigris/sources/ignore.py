"""Ignore files over tables of paths: ordered rules, the last match wins, folders hand theirs down.

A path's folders and the path itself are entries; each entry meets the rules of all folders above it by a join on
the folder. Of an entry's matches the last one of the deepest folder decides, and what lies in an ignored folder is
ignored. Folders are judged once, however many files they hold.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.sources.discovery import pattern_folders

RULE = "struct<regex: string, negated: boolean, folder_only: boolean>"


def rule(line: str) -> dict | None:
    """A line of an ignore file as a regular expression of paths below its folder; null for blank lines and comments."""
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line.removeprefix("\\") if line[:2] in ("\\!", "\\#") else line
    folder_only, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.removeprefix("/")
    out, at = "" if anchored else "(?:.*/)?", 0
    while at < len(line):
        if line.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif line.startswith("/**", at) and at + 3 == len(line):
            out, at = out + "/.+", at + 3
        elif line[at] in "*?":
            out, at = out + ("[^/]*" if line[at] == "*" else "[^/]"), at + 1
        elif line[at] == "[" and (end := line.find("]", at + 2)) > 0:
            inside = line[at + 1 : end]
            out, at = out + "(?!/)[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]", end + 1
        else:
            at += line[at] == "\\" and at + 1 < len(line)
            out, at = out + re.escape(line[at]), at + 1
    return {"regex": f"^{out}$", "negated": negated, "folder_only": folder_only} if line else None


def rules(files: DataFrame) -> DataFrame:
    """``folder, depth, line, regex, negated, folder_only`` of ignore files ``files (folder, content)``.

    ``folder`` is relative to the root, which is ``''``. Null contents have no rules.
    """
    lines = files.select("folder", F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))
    parsed = lines.withColumn("rule", F.udf(lambda text: rule(text), RULE)("text")).filter("rule is not null")
    return parsed.select("folder", _depth(F.col("folder")).alias("depth"), "line", "rule.*")


def _depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def _above(path: Column) -> Column:
    """Folders above a path, the root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def judged(entries: DataFrame, rules_: DataFrame) -> DataFrame:
    """``entry`` of those ``entries (entry, folder)`` that a rule ignores, whatever becomes of the folders above.

    ``folder`` tells whether the entry is one.
    """
    spread = entries.select("entry", F.col("folder").alias("is_folder"), F.explode(_above(F.col("entry"))).alias("folder"))
    below = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.expr("substr(entry, length(folder) + 2)"))
    met = spread.join(rules_, "folder").filter(F.regexp_like(below, F.col("regex")) & (F.col("is_folder") | ~F.col("folder_only")))
    last = met.groupBy("entry").agg(F.max_by("negated", F.struct("depth", "line")).alias("negated"))
    return last.filter("not negated").select("entry")


def _folders(paths: DataFrame) -> DataFrame:
    return paths.select("path", F.explode(_above(F.col("path"))).alias("entry")).filter("entry <> ''")


def ignored(paths: DataFrame, rules_: DataFrame) -> DataFrame:
    """Distinct ``path`` of ``paths (path)`` that the rules ignore: themselves or one of their folders.

    Paths are relative to the root with ``/`` between names. Nulls and empty paths are not ignored.
    """
    paths = paths.select("path").filter("path <> ''").distinct()
    within = _folders(paths)
    entries = within.select("entry", F.lit(True).alias("folder")).distinct().union(paths.select("path", F.lit(False)))
    gone = judged(entries, rules_)
    return within.join(gone, "entry", "left_semi").select("path").union(paths.join(gone, paths["path"] == gone["entry"], "left_semi")).distinct()


def discovered(paths: DataFrame, rules_: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Distinct ``path`` of reports: those that fit a pattern and lie in no ignored folder.

    Patterns win over ignore files for files, and for the folders that a pattern names, which stay open.
    """
    fits = lambda wanted, path: F.exists(F.array(*[F.lit(rule(p)["regex"]) for p in wanted]), lambda regex: F.regexp_like(path, regex))
    paths = paths.select("path").filter("path <> ''").distinct().filter(fits(patterns, F.col("path")))
    within = _folders(paths)
    named = [folder for p in patterns for folder in pattern_folders(p)]
    shut = within.select("entry", F.lit(True).alias("folder")).distinct()
    shut = shut.filter(~fits(named, F.col("entry"))) if named else shut
    return paths.join(within.join(judged(shut, rules_), "entry", "left_semi").select("path").distinct(), "path", "left_anti")
