"""op8: the log10 probability of every document under the mixing model and under word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dropletry.llm import mixing
from dropletry.llm.tables import table
from dropletry.llm.toxicity import id_hash


def query(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.score(table(spark, folder, "documents"), id_hash("doc_id", 7) == 2)
