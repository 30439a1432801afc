"""UMI dedup over a stream of observations; an extension, as the batch operator has no such form."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dedup_umis(stream: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """The first arrival of each (snp_id, cell_id, umi); keys older than ``delay`` are forgotten."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["snp_id", "cell_id", "umi"])
