"""Reading the tables of a dataset folder."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that Spark hands to Python at a time, where the session keeps Spark's own default: texts are
#: long, and several workers share an executor's memory.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000")


def small_batches(spark: SparkSession) -> None:
    """Sets the rows of a batch for this session, unless its user has chosen a number."""
    name, default, rows = BATCH
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, rows)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that no later loss of executors repeats its work.

    The cluster names the folder in spark.checkpoint.dir.  Only a local session, as in tests, may leave
    that unset and gets a folder of its own; elsewhere it is an error.
    """
    spark = df.sparkSession
    small_batches(spark)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def release() -> None:
    """Gives memory that a finished batch has freed back to the system: workers that wait keep little of
    the memory that all workers of an executor share."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)
