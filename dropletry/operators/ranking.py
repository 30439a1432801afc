"""Numbering rows by a total order without bringing them into one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def saved(df: DataFrame) -> DataFrame:
    """``df`` in the cluster's checkpoint folder, which every executor shares.

    Only a local session, as in tests, may leave spark.checkpoint.dir unset and gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with their places, from 0, in a total order.

    They are sorted in ranges; the ranges' sizes, a row each, turn places within a range into places in
    all.
    """
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = saved(ranged.withColumns({"_range": F.spark_partition_id(), "_inside": inside}))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    earlier = sizes.select(F.col("_range").alias("_other"), F.col("n").alias("_size"))
    starts = sizes.join(F.broadcast(earlier), F.col("_other") < F.col("_range"), "left").groupBy("_range").agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")
