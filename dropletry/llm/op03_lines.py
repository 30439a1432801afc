"""op3: all documents without the lines that an earlier line of any document nearly repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dropletry.llm import lines
from dropletry.llm.tables import table


def query(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup(table(spark, folder, "documents").select("doc_id", "text"), counts=True)
