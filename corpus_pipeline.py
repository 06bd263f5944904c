"""A training corpus from documents: each stage works on all that the one before it kept.

Stages take rows with nulls in any column, repeated rows, empty and very long texts and further columns of any
name, which come out unchanged; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import jaccard, mixing, packing, passages, quality
from verdigris.llm.scratch import saved, short_batches


#: Words that tasks of the last stage remember, fewer than alone: executors still hold memory of the stages before.
PACK_WORDS = 90_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Texts alone decide: null and empty ones are judged as empty
    texts, repeated rows alike, and null ids are no matter. Without labels every document stays."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that with the smallest id; null ids come last. Texts
    without words are no duplicates of one another, so all of their rows stay."""
    return jaccard.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand in two places go, and ``n_chars`` follows; other texts stay as they are.
    A text that loses all its words is empty, a null text becomes an empty one, and no row goes."""
    hidden = docs.toDF(*[c if c == "text" else f"column_{i}" for i, c in enumerate(docs.columns)])
    kept = passages.remove(hidden, rejoin=False)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}
    return kept.select(*[new.get(c, F.col(f"column_{i}")).alias(c) for i, c in enumerate(docs.columns)])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources come near their target words. A null source is a source; rows that
    agree in id and text are repeated alike, and those of a source without words go."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths; a null or empty text gives its end id alone."""
    short_batches(spark)
    return packing.decompose(docs, public_tokenizers.path("word_bpe_49k.json"), words=PACK_WORDS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
