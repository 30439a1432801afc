"""op7: the 20 nearest vectors by inner product of every twentieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.llm import neighbours
from dropletry.llm.tables import table


def query(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)
