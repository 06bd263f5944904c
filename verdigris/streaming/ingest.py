"""Report files as a stream of executions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.sources import registry as formats
from verdigris.sources.reports import events

FILES = "value string"


def report_stream(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """``doc, filename, content`` of files as they appear below ``folder``."""
    raw = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once).text(folder)
    return raw.select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"))


def ingest(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parse each batch's test reports and append their executions to ``path``; a batch that is tried again
    replaces its own folder, so no execution is stored twice."""

    def write(batch: DataFrame, number: int) -> None:
        known = formats.with_defaults().detect(batch).persist()  # read once, for all formats
        try:
            events(formats.test_cases(known)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            known.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failure_counts(executions: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Failures and executions of each test, kept up to date over a stream of ``name, status``."""
    counts = executions.filter(F.col("status").isin("passed", "failed")).groupBy("name").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failures"))
    return counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
