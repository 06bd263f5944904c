"""Failure clusters: greedy leaders over normalised errors, run by run.

In the order of first ids, a pattern joins the first leader that it is similar to, or leads. Patterns are settled
in rounds. In each, the first open patterns of every run, a block of bounded size, are compared with one another:
one leads if no earlier leader of its block is similar. Then all open patterns are compared with the new leaders,
as rows of a join that spreads over runs and lengths, and what finds one is settled. A later block is compared
with nothing but itself, as what is open is similar to no leader so far, so the leaders are those of one pass in
order. Blocks grow while most of their patterns lead, where few pairs are similar.

Pairs meet by run and band of length, as similar texts have nearly the same length. Of these, a bag of bytes rules
out most: each edit changes the count of one class of bytes by one at most on either side. What is left is measured,
up to the distance that counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.scalars import byte_chars, normalize_error, strip, truncate_bytes
from verdigris.steps import drop, saved

#: Bytes of an error that count, the similarity reported, the bucket of failures without a file.
ERROR_BYTES, THRESHOLD, NO_FILE = 500, 0.7, "(unknown file)"
#: Patterns of a run that are compared with one another in a round: at first, and at most.
BLOCK, LARGEST_BLOCK = 128, 4096
#: Classes of bytes in a bag.
CLASSES = 16
_CLASS_BYTES = ["".join(chr(b) for b in range(c, 256, CLASSES)) for c in range(CLASSES)]


def patterns(failures: DataFrame) -> DataFrame:
    """``run_id, pattern, first``: the distinct texts of each run's errors with the first id of each."""
    return failures.groupBy("run_id", "pattern").agg(F.min("id").alias("first"))


def band(length: Column) -> Column:
    """Lengths of similar texts differ by a factor of 0.7 at most, so their bands by one."""
    return F.floor(F.log(length.cast("double")) / F.lit(-math.log(0.699))).cast("int")


def _measured(found: DataFrame) -> DataFrame:
    """With ``raw``, a character for each byte, ``long``, its length, ``band``, and a bag of its bytes, ``bag0`` and on."""
    raw = found.withColumn("raw", byte_chars(F.col("pattern"))).withColumn("long", F.length("raw"))
    bags = {f"bag{i}": F.col("long") - F.length(F.translate("raw", chars, "")) for i, chars in enumerate(_CLASS_BYTES)}
    return raw.withColumns(bags | {"band": band(F.col("long"))})


def _near(a: str, b: str) -> Column:
    """A similarity of 0.7 or more of two measured patterns, in whole numbers: 10 * distance <= 3 * longer."""
    one, other = (lambda name: F.col(f"{a}.{name}")), (lambda name: F.col(f"{b}.{name}"))
    longer = F.greatest(one("long"), other("long"))
    most = (longer * 3 / 10).cast("int")
    more, less = (sum((F.greatest(x(f"bag{i}") - y(f"bag{i}"), F.lit(0)) for i in range(CLASSES)), F.lit(0)) for x, y in ((one, other), (other, one)))
    return (F.abs(one("long") - other("long")) <= most) & (more <= most) & (less <= most) & (F.call_function("levenshtein", one("raw"), other("raw"), most) >= 0)


def _beside(found: DataFrame) -> DataFrame:
    """Each row three times, with its own band and the next ones as ``band``."""
    return found.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))


def _leads(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaders of one run's block from ``first`` and ``near``, an earlier pattern of the block that is similar."""
    table = pa.Table.from_batches(list(rows)).sort_by("first")
    run, first, near = table.column("run_id"), table.column("first").to_pylist(), table.column("near").to_pylist()
    leaders: set[int] = set()
    for one, pairs in groupby(zip(first, near, strict=True), key=lambda x: x[0]):
        if not any(x in leaders for _, x in pairs):
            leaders.add(one)
    found = pa.array(sorted(leaders), pa.int64())
    yield pa.RecordBatch.from_arrays([run.combine_chunks().take(pa.array([0] * len(found), pa.int64())) if len(found) else pa.array([], run.type), found], ["run_id", "first"])


def block_leaders(heads: DataFrame) -> DataFrame:
    """``run_id, first`` of the leaders among measured patterns, of which a run has a block at most."""
    a, b = heads.alias("a"), _beside(heads).alias("b")
    pairs = a.join(b, (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.band") == F.col("b.band")) & (F.col("b.first") < F.col("a.first")) & _near("a", "b"), "left")
    rows = pairs.select("a.run_id", "a.first", F.col("b.first").alias("near"))
    kind = heads.schema["run_id"].dataType.simpleString()
    return rows.groupBy("run_id").applyInArrow(_leads, f"run_id {kind}, first bigint")


def assign(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """``run_id, pattern, first, leader, leads``: of :func:`patterns`, each with the pattern that leads its
    cluster and the first id of that one. Null run ids are a run. Empty tables give no rows."""
    keyed = found.withColumn("run", F.struct(F.col("run_id")))  # equal for nulls too
    open_ = saved(_measured(keyed.drop("run_id").withColumnRenamed("run", "run_id").filter("pattern <> ''")))
    settled = found.filter("pattern = ''").select("run_id", "pattern", "first", F.col("pattern").alias("leader"), F.col("first").alias("leads"))
    order = Window.partitionBy("run_id").orderBy("first")
    while most := open_.groupBy("run_id").count().agg(F.max("count")).first()[0]:
        last = most <= block
        heads = open_ if last else saved(open_.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= block).drop("turn"))
        new = heads.join(block_leaders(heads), ["run_id", "first"], "left_semi")
        new = new if last else saved(new)
        a, b = open_.alias("a"), _beside(new).alias("b")
        met = a.join(b, (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.band") == F.col("b.band")) & (F.col("b.first") <= F.col("a.first")) & _near("a", "b"), "left")
        best = F.min(F.when(F.col("b.first").isNotNull(), F.struct(F.col("b.first").alias("leads"), F.col("b.pattern").alias("leader")))).alias("best")
        done = met.groupBy("a.run_id", "a.pattern", "a.first").agg(best)
        done = done if last else saved(done)
        settled = settled.union(done.filter("best is not null").select("run_id.run_id", "pattern", "first", "best.leader", "best.leads"))
        if last:  # the block was all that was open
            break
        if 2 * new.count() > heads.count():
            block = min(2 * block, LARGEST_BLOCK)
        drop(open_, heads, new)
        open_ = saved(_measured(done.filter("best is null").drop("best")))
    return settled


def clusters(failures: DataFrame) -> DataFrame:
    """``run_id, pattern, count, test_names, file_paths, similarity, silent, first``.

    ``failures`` are rows of failed tests. Failures without an error are clusters by file, ``silent`` 1. ``first``
    is the smallest id of a cluster. The order within a run is that of :func:`ordered`: largest first, then those
    with an error, then by first id.
    """
    failures = failures.withColumns({"file_path": F.coalesce("file_path", F.lit("")), "error_message": F.coalesce("error_message", F.lit(""))})
    text = truncate_bytes(normalize_error(F.col("error_message"), unicode=True), ERROR_BYTES)
    said = saved(failures.filter(strip(F.col("error_message")) != "").select("run_id", "id", "name", "file_path", text.alias("pattern")))
    led = assign(patterns(said)).select(F.col("run_id").alias("of_run"), F.col("pattern").alias("of_pattern"), "leader", "leads")
    by_error = said.join(led, F.col("run_id").eqNullSafe(F.col("of_run")) & (F.col("pattern") == F.col("of_pattern"))).select("run_id", "id", "name", "file_path", F.col("leader").alias("pattern"), F.lit(0).alias("silent"), F.col("leads").alias("first"))
    file = F.when(F.col("file_path") == "", NO_FILE).otherwise(F.col("file_path"))
    blank = failures.filter(strip(F.col("error_message")) == "").withColumn("pattern", F.concat(F.lit("Failed tests in "), file, F.lit(" (no error message captured)")))
    firsts = blank.groupBy(F.col("run_id").alias("of_run"), F.col("pattern").alias("of_pattern")).agg(F.min("id").alias("first"))
    silent = blank.join(firsts, F.col("run_id").eqNullSafe(F.col("of_run")) & (F.col("pattern") == F.col("of_pattern"))).select("run_id", "id", "name", "file_path", "pattern", F.lit(1).alias("silent"), "first")
    members = by_error.unionByName(silent).groupBy("run_id", "pattern", "silent", "first").agg(F.count("*").cast("int").alias("count"), F.collect_list(F.struct("id", "name")).alias("names"), F.array_sort(F.collect_set(F.when(F.col("file_path") != "", F.col("file_path")))).alias("file_paths"))
    return members.select("run_id", "pattern", "count", F.transform(F.array_sort("names"), lambda m: m["name"]).alias("test_names"), "file_paths", F.lit(THRESHOLD).alias("similarity"), "silent", "first")


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("run_id", F.desc("count"), "silent", "first")
