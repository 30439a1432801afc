"""op10: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dropletry.llm import extraction
from dropletry.llm.tables import table


def query(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")
