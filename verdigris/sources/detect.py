"""Format detection as score columns, and the registry of formats."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.sources.keys import scanned

#: The score that wins at once, and the least that counts.
CERTAIN, LEAST = 100, 50
#: More than any score.
_BEYOND = 1 << 40


def _has(text: Column, *parts: str) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & text.contains(p)
    return out


def _score(*cases: tuple[Column, int]) -> Column:
    out = F
    for when, score in cases:
        out = out.when(when, score)
    return out.otherwise(0)


def top_keys(text: Column) -> Column:
    """Keys of the outer JSON object; of malformed text, those that a scan of its first object finds."""
    return F.coalesce(F.json_object_keys(text), scanned(text)["top"], F.array().cast("array<string>"))


def keys_at_depth(text: Column, depth: int) -> Column:
    """Keys of JSON objects at a depth; objects in arrays are one deeper, depth 0 has none."""
    none = F.array().cast("array<string>")
    return F.coalesce(scanned(text, depth)["deep"], none) if depth > 0 else none


def _json(text: Column, name: Column) -> Column:
    """The text of a file named as JSON, which alone is scanned for keys."""
    return F.when(name.endswith(".json"), text)


def _all_keys(text: Column, *keys: str) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, keys)), top_keys(text))) == 0


def junit(t: Column, name: Column) -> Column:
    return _score((name.endswith(".xml") & _has(t, "<testsuite"), 100))


def jest(t: Column, name: Column) -> Column:
    return _score((_all_keys(_json(t, name), "numTotalTests", "testResults", "success"), 90))


def playwright(t: Column, name: Column) -> Column:
    return _score((_all_keys(_json(t, name), "config", "suites", "stats"), 90))


def ctrf(t: Column, name: Column) -> Column:
    t = _json(t, name)
    marked = _all_keys(t, "reportFormat") & t.contains('"CTRF"')
    shaped = _all_keys(t, "results") & F.array_contains(keys_at_depth(t, 2), "tests")
    return _score((marked, 95), (shaped, 70))


def lcov(t: Column, name: Column) -> Column:
    lower = F.lower(name)
    named = lower.endswith(".lcov") | (F.substring_index(lower, "/", -1) == "lcov.info")
    record = _has(t, "SF:", "end_of_record")
    return _score((named, 100), (record & (t.contains("DA:") | t.contains("LF:")), 95), (record, 80))


def trx(t: Column, name: Column) -> Column:
    run = t.contains("<TestRun")
    xml = name.endswith(".xml") & run
    return _score((name.endswith(".trx") & run, 100), (xml & t.contains("microsoft.com/schemas/VisualStudio/TeamTest"), 95), (xml, 70))


def _xml(name: Column, word: str, *cases: tuple[Column, int]) -> Column:
    lower = F.lower(name)
    return F.when(lower.endswith(".xml"), _score((lower.contains(word), 95), *cases)).otherwise(0)


def cobertura(t: Column, name: Column) -> Column:
    rated = _has(t, "<coverage", "line-rate=")
    return _xml(name, "cobertura", (rated & t.contains("<packages"), 95), (rated & (t.contains("branch-rate=") | t.contains("<classes")), 85), (rated, 70))


def jacoco(t: Column, name: Column) -> Column:
    counted = _has(t, "<report", "<counter type=")
    return _xml(name, "jacoco", (counted & (t.contains('type="LINE"') | t.contains('type="BRANCH"')), 95), (_has(t, "<report", "<sessioninfo", "<package"), 90), (counted, 75))


def clover(t: Column, name: Column) -> Column:
    measured = _has(t, "<coverage", "<project", "<metrics")
    return _xml(name, "clover", (measured & (t.contains("coveredstatements=") | _has(t, "methods=", "coveredmethods=")), 95), (_has(t, "<coverage", "clover=", "<project"), 90), (measured & t.contains("statements="), 80))


@dataclass(frozen=True)
class Format:
    """A report format: its score of a text and file name, and its reader of ``doc, content`` rows."""

    id: str
    name: str
    priority: int
    result_type: str
    score: Callable[[Column, Column], Column]
    read: Callable[[DataFrame], object] | None = None


class Registry:
    """Formats in the order of registration; ids are unique."""

    def __init__(self, formats: tuple[Format, ...] = ()):
        self.formats: list[Format] = []
        for f in formats:
            self.register(f)

    def register(self, new: Format) -> None:
        if any(f.id == new.id for f in self.formats):
            raise ValueError(f"Duplicate parser id: {new.id}")
        self.formats.append(new)

    def ids(self) -> list[str]:
        return [f.id for f in self.formats]

    def get(self, id_: str) -> Format:
        return next(f for f in self.formats if f.id == id_)

    def scores(self, content: Column, filename: Column) -> Column:
        """Each format's score, as an array in their order. Only the file's own name counts, not its folder."""
        base = F.substring_index(filename, "/", -1)
        return F.array(*[f.score(content, base).cast("int") for f in self.formats])

    def winner(self, scores: Column) -> Column:
        """Of :meth:`scores`, the winning format as ``struct(id, name, score, result_type)``, null if none reaches 50.

        A score of 100 wins at once, the earliest such; else the highest score, then priority, then the earliest.
        """
        n = len(self.formats)
        ranked = sorted(range(n), key=lambda i: (self.formats[i].priority, -i))
        rank = F.array(*[F.lit(ranked.index(i)) for i in range(n)])
        named = F.array(*[F.struct(*map(F.lit, (f.id, f.name, f.result_type))) for f in (self.formats[i] for i in ranked)])
        # numbers in the order of the formats: a score, or the place of a certain one beyond all scores, and the rank
        number = lambda s, i: F.when(s == CERTAIN, F.lit(_BEYOND) - i).otherwise(s.cast("bigint")) * n + rank[i]

        def told(top: Column) -> Column:
            score, names = F.floor(top / n), named[F.pmod(top, F.lit(n)).cast("int")]
            score = F.when(score > _BEYOND - n, CERTAIN).otherwise(score).cast("int")
            return F.when(score >= LEAST, F.struct(names["col1"].alias("id"), names["col2"].alias("name"), score.alias("score"), names["col3"].alias("result_type")))

        return F.transform(F.array(F.array_max(F.transform(scores, number))), told)[0]

    def best(self, content: Column, filename: Column) -> Column:
        """The winning format of a text and file name, see :meth:`winner`."""
        return self.winner(self.scores(content, filename))

    def detect(self, files: DataFrame) -> DataFrame:
        """``files (doc, filename, content)`` with ``format``. Scores are a column of their own first, so that a text is searched once."""
        return files.withColumn("format", self.scores(F.col("content"), F.col("filename"))).withColumn("format", self.winner(F.col("format")))
