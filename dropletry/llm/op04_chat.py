"""op4: every conversation with its roles repaired at least cost, rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dropletry.llm import chat
from dropletry.llm.tables import table


def query(spark: SparkSession, folder: str) -> DataFrame:
    return chat.conversations(table(spark, folder, "conversations")).withColumnRenamed("conversation", "conv_id")
