"""Quality rules with cross-document line frequency.

Base rules look at one text: its length and its repetition. Then normalised lines are hashed, the
distinct documents of each host that have a line are counted, lines that more than a few have are removed,
and documents that keep too little are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.scratch import saved
from verdigris.llm.text import SPACE, as_bytes, batches, hashed, mixed, ngrams

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: Fixed values of the base rules: fewest words, largest share (percent) of words in repeated windows, the window.
LEAST_WORDS, REPEATED_PERCENT, WINDOW = 10, 20, 5

#: Parts that the rows with one line are dealt into, so that a very common line isn't one task.
SALT = 16

_OUT = "doc_id bigint, host string, doc_key binary, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, line_hashes array<bigint>, line_words array<int>"

_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def _lines(text: bytes) -> tuple[int, list[int], list[int]]:
    """Lines equal to an earlier one; the normalised lines' hashes and numbers of words."""
    seen, again, keys, sizes = set(), 0, [], []
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            again += line in seen
            seen.add(line)
            keys.append(xxhash.xxh3_64_intdigest(b" ".join(words).lower()) - (1 << 63))
            sizes.append(len(words))
    return again, keys, sizes


def _repeats(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, its words inside windows that it has twice or more."""
    n = len(h)
    grams = ngrams(h, WINDOW)
    if not len(grams):
        return np.zeros(len(first) - 1, np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = owner[: len(grams)] == owner[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    keys = mixed(grams[at] + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice = at[order[same[1:] | same[:-1]]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:n]) > 0)])
    return covered[first[1:]] - covered[first[:-1]]


def _measured(docs: DataFrame) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = as_bytes(batch.column(2))
            for lo, hi in batches(texts):
                part = texts[lo:hi]
                h, s, e, first, data = hashed(part)
                raw = np.frombuffer(data, np.uint8)
                points = np.concatenate([[0], np.cumsum(~_CONTINUES[raw] & ~SPACE[raw])])
                ends = np.cumsum([len(t) + 1 for t in part]) - 1
                starts = ends - [len(t) for t in part]
                lines = [_lines(t) for t in part]
                cols = [
                    batch.column(0).slice(lo, hi - lo),
                    batch.column(1).slice(lo, hi - lo),
                    pa.array([xxhash.xxh3_128_digest(t) for t in part], pa.binary()),
                    pa.array(np.diff(first)),
                    pa.array(points[ends] - points[starts]),
                    pa.array([len(t) - len(t.translate(None, SYMBOLS)) for t in part], pa.int64()),
                    pa.array([x[0] for x in lines], pa.int64()),
                    pa.array(_repeats(h, first)),
                    pa.array([x[1] for x in lines], pa.list_(pa.int64())),
                    pa.array([x[2] for x in lines], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, _OUT)


def judge(docs: DataFrame, least: int = 5, keep_share: float = 0.3) -> DataFrame:
    """One row for each row of ``docs``: base counts, ``base_failed, n_removed_words, kept``.

    A line is removed where more than ``least`` distinct documents of its host have it; documents are
    distinct by text, so copies of one text don't remove each other. A document is depleted, and not kept,
    if fewer than LEAST_WORDS words or less than ``keep_share`` of its words are left. ``source`` is the
    host; null is a host. Null and empty texts have no words and fail the base rules. Repeated rows are
    judged alike; clashing column names of ``docs`` don't matter.
    """
    rows = saved(_measured(docs).withColumn("row", F.monotonically_increasing_id()))
    one = rows.select("host", "doc_key", "line_hashes").groupBy("host", "doc_key").agg(F.first("line_hashes").alias("line_hashes"))
    lines = one.select("host", F.explode(F.array_distinct("line_hashes")).alias("line")).select(F.xxhash64("host", "line").alias("key"))
    frequent = lines.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > least).select("key")
    # a frequent line of a large host is in many rows: each has as many parts as SALT
    limit = frequent.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    each = rows.select("row", "host", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("line"))
    words = each.select("row", F.xxhash64("host", "line.line_hashes").alias("key"), F.pmod("row", F.lit(SALT)).cast("int").alias("part"), F.col("line.line_words").alias("words"))
    removed = words.join(limit, ["key", "part"]).groupBy("row").agg(F.sum("words").alias("n_removed_words"))
    out = rows.drop("line_hashes", "line_words", "doc_key", "host").join(removed, "row", "left").drop("row")
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("bigint"))
    left = F.col("n_words") - F.col("n_removed_words")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    depleted = (left < LEAST_WORDS) | (left < keep_share * F.col("n_words"))
    return out.withColumns({"base_failed": failed, "kept": ~failed & ~depleted})
