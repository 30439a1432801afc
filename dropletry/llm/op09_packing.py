"""op9: all documents packed into sequences of at most 4096 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.llm import packing
from dropletry.llm.op01_bpe import VOCABULARY
from dropletry.llm.tables import table


def digest(docs: DataFrame) -> DataFrame:
    """The pieces of packed documents, each with the checksum of its ids."""
    found = packing.pack(docs, public_tokenizers.path(VOCABULARY))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return digest(table(spark, folder, "documents"))
