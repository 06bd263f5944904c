"""Bounded samples of labelled rows for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text divides by 5. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, label`` (0.0 or 1.0) of at most ``rows`` documents, chosen by a hash of the id.

    Held-out rows, null ids and labels other than 0 and 1 are left out, as are ids with both labels.
    """
    y = F.col(label).cast("int")
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & y.isin(0, 1))
    agreed = usable.groupBy("doc_id").agg(F.min(y).alias("lo"), F.max(y).alias("hi")).filter("lo = hi")
    return agreed.select("doc_id", F.col("lo").cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
