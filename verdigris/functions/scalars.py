"""Scalar functions as Spark expressions; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rewrites of error messages, in the order in which they apply.
ERROR_REWRITES = (
    (r"\s+", " "),
    (r"(?i)[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", "<uuid>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?Z?", "<timestamp>"),
    (r"/.+/([^/]+\.[jt]sx?):\d+(:\d+)?", "$1:<line>"),
    (r"(?i)\bid[=:]\s*\d+", "id=<id>"),
    (r"\b\d{4,}\b", "<id>"),
    (r"(?i)0x[a-f0-9]+", "<address>"),
    (r"\s+", " "),
)

#: Health labels by the least score.
HEALTH_LABELS = ((90, "excellent"), (75, "good"), (50, "fair"), (25, "poor"))

PATH_ROOTS = ("tests", "test", "__tests__", "src")


def normalize_error(message: Column, unicode: bool = False) -> Column:
    """An error message with its variable parts replaced. ``unicode`` widens \\s, \\d and \\b beyond ASCII."""
    for pattern, to in ERROR_REWRITES:
        message = F.regexp_replace(message, ("(?U)" if unicode else "") + pattern, to)
    return strip(message)


def strip(text: Column) -> Column:
    """The text without white space, of any kind, at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def byte_chars(text: Column) -> Column:
    """The text with one character for each of its UTF-8 bytes, so that character functions count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def truncate_bytes(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes of the text, cut between characters."""
    raw = byte_chars(text)
    head = F.substring(raw, 1, limit)
    # the cut is inside a character if the next byte continues one
    whole = F.when(F.substring(raw, limit + 1, 1).rlike("^[\\u0080-\\u00BF]$"), F.regexp_replace(head, "[\\u00C0-\\u00FF][\\u0080-\\u00BF]*$", "")).otherwise(head)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8"))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in bytes."""
    return F.levenshtein(byte_chars(a), byte_chars(b))


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 if one is empty, else 1 less the distance for each byte of the longer."""
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - edit_distance(a, b) / longer)


def similar(a: Column, b: Column) -> Column:
    """A similarity of 0.7 or more, in whole numbers: 10 * distance <= 3 * longer."""
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    shorter = F.least(F.octet_length(a), F.octet_length(b))
    near = (10 * (longer - shorter) <= 3 * longer) & (10 * edit_distance(a, b) <= 3 * longer)
    return (a == b) | ((a != "") & (b != "") & near)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_text(text: Column, part: str) -> Column:
    """Substring search that ignores the case of A-Z only; wildcards are ordinary characters."""
    return ascii_lower(text).contains(part.translate({c: c + 32 for c in range(65, 91)}))


def escape_like(text: str) -> str:
    r"""A LIKE pattern's literal: ``\``, ``%`` and ``_`` escaped by ``\``."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def round2(value: Column) -> Column:
    """Two decimals, halves away from zero."""
    return F.round(value * 100) / 100


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def percentage(covered: Column, total: Column) -> Column:
    """A whole percentage; 0 of nothing."""
    return F.when(total == 0, 0.0).otherwise(F.round(covered / F.nullif(total, F.lit(0)) * 100))


def pass_rate(passed: Column, total: Column) -> Column:
    return F.when(total > 0, passed / F.nullif(total, F.lit(0)) * 100).otherwise(0.0)


def health_label(score: Column) -> Column:
    out = F
    for least, label in HEALTH_LABELS:
        out = out.when(score >= least, label)
    return out.otherwise("critical")


def to_millis(value: Column) -> Column:
    """A whole number of milliseconds: halves up, not below 0; null and non-finite values stay null."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 9e18)
    return F.when(finite, F.greatest(F.lit(0), F.round(F.when(finite, value)).cast("bigint")))


def timespan_millis(text: Column) -> Column:
    """Milliseconds of ``[d.]HH:mm:ss[.f]``; parts that are no numbers and other shapes count as 0."""
    parts = F.split(text, ":")
    whole = lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0))
    first = F.split(F.get(parts, F.lit(0)), r"\.")
    days = F.when(F.size(first) > 1, whole(F.get(first, F.lit(0)))).otherwise(0)
    hours = whole(F.get(first, F.size(first) - 1))
    seconds = F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0))
    total = ((days * 24 + hours) * 60 + whole(F.get(parts, F.lit(1)))) * 60 + seconds
    return F.when(F.size(parts) >= 3, F.greatest(F.lit(0), F.round(total * 1000).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def class_of(test_name: Column) -> Column:
    """What stands before the last dot of a dotted name, arguments aside; empty without a dot."""
    plain = F.rtrim(F.substring_index(test_name, "(", 1))
    return F.when(plain.contains("."), F.regexp_replace(plain, r"\.[^.]*$", "")).otherwise("")


def method_of(test_name: Column) -> Column:
    """What follows the class, with the arguments."""
    cls = class_of(test_name)
    return F.when(cls == "", test_name).otherwise(F.substring(test_name, F.char_length(cls) + 2, F.char_length(test_name)))


def project_path(path: Column) -> Column:
    """A path from its first folder named tests, test, __tests__ or src on, else its last part."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    at = F.array_min(F.array(*[F.when(F.array_position(parts, r) > 0, F.array_position(parts, r)) for r in PATH_ROOTS]))
    return F.when(at.isNotNull(), F.array_join(F.slice(parts, at.cast("int"), F.size(parts)), "/")).otherwise(F.element_at(parts, -1))


def first_line(text: Column) -> Column:
    """The first line of a non-empty text, else null."""
    return F.when(text != "", F.element_at(F.split(text, "\r?\n", 2), 1))


def condition_counts(text: Column) -> tuple[Column, Column]:
    """Covered and all branches of ``... (N/M)``; null where there are none."""
    pick = lambda i: F.regexp_extract(text, r"\(([^/)]*)/([^)]*)\)", i).try_cast("int")
    return pick(1), pick(2)


def ellipsis(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes, the last three of them dots where something is cut."""
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(truncate_bytes(text, limit - 3), F.lit("...")))


def plural(count: Column, word: str) -> Column:
    return F.concat_ws(" ", count.cast("string"), F.when(count == 1, word).otherwise(word + "s"))


def trend_arrow(trend: Column) -> Column:
    return F.when(trend == "improving", "↑").when(trend == "declining", "↓").otherwise("→")


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def local_name(tag: Column) -> Column:
    return F.substring_index(tag, ":", -1)


def rfc3339_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
