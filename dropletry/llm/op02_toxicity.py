"""op2: the toxicity of every document, learnt from two of three folds of the labelled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.llm import toxicity
from dropletry.llm.tables import table

THRESHOLD = 0.7


def model(spark: SparkSession, folder: str, docs: DataFrame) -> toxicity.Model:
    labels = table(spark, folder, "labels").where(toxicity.id_hash("doc_id", 3) != 1)
    return toxicity.train(docs, labels)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.score(docs, model(spark, folder, docs)).select(
        "doc_id",
        (toxicity.id_hash("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
