import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdigris.llm import scratch


class Cluster:
    """A session of a cluster without a checkpoint folder."""

    class conf:
        get = staticmethod(lambda name, default: default)

    class sparkContext:
        master = "spark://host:7077"


def test_a_cluster_needs_a_shared_folder(spark):
    with pytest.raises(ValueError, match="checkpoint.dir"):
        scratch.folder(Cluster)
    assert scratch.folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_tables_are_written_read_and_dropped(spark):
    made = scratch.saved(spark.range(5).withColumn("x", F.col("id") * 2))
    assert made.agg(F.sum("x")).first()[0] == 20 and made._scratch_path in scratch._written
    scratch.drop(made)
    assert made._scratch_path not in scratch._written
    assert scratch.small(spark.range(3), 3) and not scratch.small(spark.range(4), 3)
    assert scratch.fresh(spark.range(1), "ID") == "ID_"


def test_saved_steps_get_short_batches(spark, monkeypatch):
    """Arrow batches of wide rows are bounded while a step is saved; the session's setting comes back."""
    monkeypatch.setattr(scratch, "BATCH_BYTES", 1 << 16)
    before = spark.conf.get(scratch._BATCH, None)

    def sizes(rows):
        for batch in rows:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    got = scratch.saved(spark.range(2000, numPartitions=1).selectExpr("repeat('x', 1000) AS text").mapInArrow(sizes, "n bigint"))
    assert sum(r["n"] for r in got.collect()) == 2000 and max(r["n"] for r in got.collect()) < 100
    assert spark.conf.get(scratch._BATCH, None) == before
    scratch.drop(got)


def test_short_batches_keep_a_bound_of_the_session(spark):
    before = spark.conf.get(scratch._BATCH, None)
    try:
        spark.conf.unset(scratch._BATCH)
        scratch.short_batches(spark)
        assert spark.conf.get(scratch._BATCH) == str(scratch.BATCH_BYTES)
        spark.conf.set(scratch._BATCH, "1000")
        scratch.short_batches(spark)
        assert spark.conf.get(scratch._BATCH) == "1000"
    finally:
        spark.conf.unset(scratch._BATCH) if before is None else spark.conf.set(scratch._BATCH, before)
