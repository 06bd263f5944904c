"""Tables written between two steps, in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch of a step whose result is saved.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Sessions of the tables written and not dropped yet, by path.
_written: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder on one machine; a cluster needs a folder that all executors share.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="verdigris-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def place(spark: SparkSession) -> str:
    """A path of its own in the shared folder, deleted at exit."""
    path = f"{folder(spark)}/step-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; cuts its lineage."""
    spark = df.sparkSession
    path = place(spark)
    with _short_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def short_batches(spark: SparkSession) -> None:
    """From now on Python steps get Arrow batches of at most BATCH_BYTES, unless the session has a bound."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Python steps get Arrow batches of at most BATCH_BYTES: the JVM and Python hold each several times."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`saved` that no later step reads."""
    for df in tables:
        _delete(df.sparkSession, df._scratch_path)


def release() -> None:
    """Delete all tables made so far, when what was computed from them is written elsewhere."""
    for path, spark in list(_written.items()):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


@atexit.register
def _clean() -> None:
    try:
        release()
    except Exception:  # the session has ended already
        return


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one above that."""
    return df.limit(rows + 1).count() <= rows


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
