"""Coverage readers: LCOV over lines; Cobertura, JaCoCo and Clover group the element rows once by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.scalars import condition_counts, strip_bom
from verdigris.sources.reports import COUNTS, KINDS, CoverageReports, totals
from verdigris.sources.xml import attr, attr_within, elements, number, only, owner, within

#: LCOV's counters by what they count.
LCOV_COUNTERS = {"lines_covered": "LH", "lines_total": "LF", "branches_covered": "BRH", "branches_total": "BRF", "functions_covered": "FNH", "functions_total": "FNF"}
JACOCO_COUNTERS = {"lines": "LINE", "branches": "BRANCH", "functions": "METHOD"}


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)


def _reports(docs: DataFrame, name: str, sums: DataFrame, own: DataFrame | None, has: DataFrame | None, missing: str) -> DataFrame:
    """Report rows: a document's own counts where it has them, else the sums of its files."""
    out = docs.select("doc").join(sums, "doc", "left")
    if own is not None:
        out = out.join(own.select("doc", F.struct(*COUNTS).alias("own")), "doc", "left")
    out = out.join(has.select("doc").distinct().withColumn("has", F.lit(True)), "doc", "left") if has is not None else out.withColumn("has", F.col("n_files") > 0)
    return _told(out, name, missing)


def _told(rows: DataFrame, name: str, missing: str) -> DataFrame:
    """Report rows of documents with the sums of their files, perhaps counts of their ``own``, and whether each ``has`` a report at all."""
    picked = [_zero(c) for c in COUNTS]
    if "own" in rows.columns:
        picked = [F.when(F.col("own").isNotNull(), F.coalesce(F.col(f"own.{c}"), F.lit(0))).otherwise(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c) for c in COUNTS]
    return rows.select("doc", F.lit(name).alias("format"), *picked, F.when(~F.coalesce("has", F.lit(False)), missing).alias("error"))


def lcov(docs: DataFrame) -> CoverageReports:
    """LCOV: a section runs from ``SF:`` to ``end_of_record``, the next ``SF:`` or the end; the last value of a counter holds."""
    lines = docs.select("doc", F.posexplode(F.split(strip_bom(F.col("content")), "\n")).alias("at", "raw")).select("doc", "at", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("line"))
    before = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.sum(F.col("line").startswith("SF:").cast("int")).over(before))
    inside = Window.partitionBy("doc", "section").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.filter("section > 0").withColumn("ended", F.coalesce(F.sum((F.col("line") == "end_of_record").cast("int")).over(inside), F.lit(0))).filter("ended = 0")
    value = F.coalesce(F.trim(F.substring_index("line", ":", -1)).try_cast("bigint"), F.lit(0))
    last = [F.coalesce(F.max_by(value, F.when(F.col("line").startswith(f"{k}:"), F.col("at"))), F.lit(0)).alias(c) for c, k in LCOV_COUNTERS.items()]
    sections = lines.groupBy("doc", "section").agg(F.max(F.when(F.col("line").startswith("SF:"), F.substring("line", 4, 1 << 30))).alias("path"), *last).filter("path <> ''")
    files = sections.select("doc", F.col("section").alias("pos"), "path", *COUNTS)
    return CoverageReports(files, _reports(docs, "lcov", totals(files), None, None, "No coverage sections found in LCOV"))


def cobertura(docs: DataFrame) -> CoverageReports:
    """Cobertura: classes merged by file name; files without lines outside methods are left out."""
    rows = elements(docs, "coverage", "line", "method", near=("methods",), carried=("class",), more=())
    in_methods = within("methods").isNotNull()
    line, method = (F.col("tag") == "line") & ~in_methods, (F.col("tag") == "method") & in_methods
    hits = F.coalesce(number("hits"), F.lit(0)) > 0
    covered, total = condition_counts(attr("condition-coverage"))
    branched = line & (attr("branch") == "true") & covered.isNotNull() & total.isNotNull()
    ran = hits | (F.coalesce(number("line-rate", "double"), F.lit(0.0)) > 0)
    root, path = F.col("tag") == "coverage", F.when(line | method, attr_within("class", "filename"))
    written = {"lines_covered": "lines-covered", "lines_total": "lines-valid", "branches_covered": "branches-covered", "branches_total": "branches-valid"}
    of_root = [F.max_by(number(a), F.when(root, F.col("id"))).alias(f"root_{c}") for c, a in written.items()]
    # one pass: a row for each file, and one without a path that has the counts of the last root
    grouped = rows.withColumn("path", path).filter(root | F.col("path").isNotNull()).groupBy("doc", "path").agg(
        F.min(F.when(line, F.col("id"))).alias("pos"), F.count_if(line & hits).alias("lines_covered"), F.count_if(line).alias("lines_total"),
        F.coalesce(F.sum(F.when(branched, covered)), F.lit(0)).alias("branches_covered"), F.coalesce(F.sum(F.when(branched, total)), F.lit(0)).alias("branches_total"),
        F.count_if(method & ran).alias("functions_covered"), F.count_if(method).alias("functions_total"),
        *of_root,
    )
    files = grouped.filter("path is not null AND lines_total > 0").select("doc", "pos", "path", *[_zero(c) for c in COUNTS])
    told = F.col("root_lines_covered").isNotNull() & F.col("root_lines_total").isNotNull()
    own = {c: F.max(F.when(told, F.coalesce(F.col(f"root_{c}"), F.lit(0)))) if c in written else F.lit(0) for c in COUNTS}
    sums = [F.sum(F.when(F.col("lines_total") > 0, F.col(c))).alias(c) for c in COUNTS]
    both = grouped.groupBy("doc").agg(*sums, *[c.alias(f"own_{n}") for n, c in own.items()], F.bool_or(F.col("path").isNull()).alias("has"))
    both = both.withColumn("own", F.when(F.col("own_lines_total").isNotNull(), F.struct(*[F.col(f"own_{c}").alias(c) for c in COUNTS])))
    return CoverageReports(files, _told(docs.select("doc").join(both, "doc", "left"), "cobertura", "No coverage element found in Cobertura XML"))


def _counters(when: Column) -> list[Column]:
    """In a group of rows, JaCoCo's counters ``when`` holds: the last of a kind counts."""
    missed, covered = F.coalesce(number("missed"), F.lit(0)), F.coalesce(number("covered"), F.lit(0))
    picks = []
    for kind in KINDS:
        last = F.max_by(F.struct(covered.alias("c"), (missed + covered).alias("t")), F.when(when & (attr("type") == JACOCO_COUNTERS[kind]), F.col("id")))
        picks += [F.coalesce(last["c"], F.lit(0)).cast("bigint").alias(f"{kind}_covered"), F.coalesce(last["t"], F.lit(0)).cast("bigint").alias(f"{kind}_total")]
    return picks


def jacoco(docs: DataFrame) -> CoverageReports:
    """JaCoCo: source files; without any, classes merged by their source file. The report's own counters win."""
    rows = elements(docs, "report", "sourcefile", "class", "counter", near=("sourcefile", "class"), carried=("package",), more=("empty", "parent"))
    counter = F.col("tag") == "counter"
    kind = F.when(owner("sourcefile").isNotNull(), "sourcefile").when(owner("class").isNotNull(), "class")
    owned = rows.filter(counter | F.col("tag").isin("sourcefile", "class")).withColumn("kind", kind).filter("kind is not null").withColumn("owner", F.coalesce(owner("sourcefile"), owner("class")))
    itself = F.col("tag") == F.col("kind")
    name, package = F.coalesce(attr("name"), F.lit("")), F.coalesce(attr_within("package", "name"), F.lit(""))
    folder = F.when(name.contains("/"), F.regexp_replace(name, "/[^/]*$", ""))
    of_source = F.when(package == "", name).otherwise(F.concat_ws("/", package, name))
    of_class = F.when(attr("sourcefilename").isNull(), name).otherwise(F.concat_ws("/", folder, attr("sourcefilename")))
    path = F.when(itself & ~F.col("empty"), F.when(F.col("kind") == "sourcefile", of_source).otherwise(of_class))
    each = owned.groupBy("doc", "kind", "owner").agg(F.first(path, ignorenulls=True).alias("path"), *_counters(counter)).filter("path is not null")
    each = each.withColumn("sourced", F.bool_or(F.col("kind") == "sourcefile").over(Window.partitionBy("doc")))
    # a source file stands for itself, classes of one file are one
    alone = F.when(F.col("kind") == "sourcefile", F.col("owner"))
    files = each.filter((F.col("kind") == "sourcefile") == F.col("sourced")).groupBy("doc", "path", alone.alias("alone")).agg(F.min("owner").alias("pos"), *[F.sum(c).alias(c) for c in COUNTS]).select("doc", "pos", "path", *COUNTS)
    tops = rows.filter(counter & (F.col("parent") == "report")).groupBy("doc").agg(*_counters(counter)).filter("lines_total > 0 OR branches_total > 0")
    return CoverageReports(files, _reports(docs, "jacoco", totals(files), tops, rows.filter("tag = 'report'"), "No report element found in JaCoCo XML"))


def clover(docs: DataFrame) -> CoverageReports:
    """Clover: a file's first metrics win over its lines; project metrics ahead of packages and files are the totals."""
    rows = elements(docs, "coverage", "package", "file", "line", "metrics", near=("file",), more=("empty", "parent"))
    value = lambda name: F.coalesce(number(name), F.lit(0))
    measures = {
        "lines_covered": value("coveredstatements"), "lines_total": F.coalesce(number("statements"), number("ncloc"), number("loc"), F.lit(0)),
        "branches_covered": value("coveredconditionals"), "branches_total": value("conditionals"),
        "functions_covered": value("coveredmethods"), "functions_total": value("methods"),
    }
    measured = F.struct(*[c.cast("bigint").alias(n) for n, c in measures.items()])
    kind, ran = F.when(F.col("tag") == "line", attr("type")), (value("count") > 0).cast("bigint")
    sides = (value("truecount") > 0).cast("bigint") + (value("falsecount") > 0).cast("bigint")
    known = kind.isin("stmt", "cond", "method")
    hit = F.when(kind == "cond", (sides > 0).cast("bigint")).otherwise(ran)
    inner = rows.withColumn("file", owner("file")).filter("file is not null").filter(known | F.col("tag").isin("file", "metrics"))
    path = F.when(~F.col("empty"), F.coalesce(attr("path"), attr("name"), F.lit("")))
    sums = {
        "lines_covered": F.when(known, hit), "lines_total": F.when(known, 1), "branches_covered": F.when(kind == "cond", sides), "branches_total": F.when(kind == "cond", 2),
        "functions_covered": F.when(kind == "method", ran), "functions_total": F.when(kind == "method", 1),
    }
    both = inner.groupBy("doc", "file").agg(only("file", path).alias("path"), F.min_by(measured, F.when(F.col("tag") == "metrics", F.col("id"))).alias("m"), F.count_if(known).alias("n"), *[F.coalesce(F.sum(v), F.lit(0)).alias(c) for c, v in sums.items()])
    files = both.filter("path is not null AND (m is not null OR n > 0)").select("doc", F.col("file").alias("pos"), "path", *[F.when(F.col("m").isNotNull(), F.col(f"m.{c}")).otherwise(F.col(c)).cast("bigint").alias(c) for c in COUNTS])
    begun = rows.filter(F.col("tag").isin("package", "file")).groupBy("doc").agg(F.min("id").alias("begun"))
    metrics = rows.filter((F.col("tag") == "metrics") & (F.col("parent") == "project")).select("doc", "id", measured.alias("m"))
    early = metrics.join(begun, "doc", "left").filter("begun is null OR id < begun").groupBy("doc").agg(F.max_by("m", "id").alias("m"))
    own = early.select("doc", "m.*").filter("lines_total > 0 OR functions_total > 0")
    return CoverageReports(files, _reports(docs, "clover", totals(files), own, rows.filter("tag = 'coverage'"), "No coverage element found in Clover XML"))
