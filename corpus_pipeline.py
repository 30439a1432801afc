"""The corpus pipeline: toxic documents go, repeated lines go, one document of each group of near
copies stays, and what is left is packed into training sequences.

Defined results, stage by stage: a null text counts as an empty one and stays null; rows with a null id
stay through the first three stages; rows that share an id are judged alike, and near copies leave all
rows of the id that stays; of equal texts the smallest id stays; empty texts are no copies of each other;
a text whose lines all go becomes empty; columns of any other name come through unchanged until packing,
which has its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.llm import jaccard, lines, op02_toxicity, op09_packing, toxicity
from dropletry.llm.tables import checkpointed, free_name, small_batches, table

#: SQL expresses neither the classifier nor the packing; tests hold the rows against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold, as they came."""
    small_batches(spark)
    column = free_name(docs, "_toxicity")
    scored = toxicity.score(docs, op02_toxicity.model(spark, sf_dir, docs), score_column=column)
    return scored.where(F.col(column) < op02_toxicity.THRESHOLD).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines; n_chars counts what is left."""
    cleaned = lines.dedup(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else cleaned


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The earliest document of each group that links of 0.8 or more make."""
    return jaccard.first_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 4096 tokens."""
    return op09_packing.digest(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near copies", keep_one_of_near_copies), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
