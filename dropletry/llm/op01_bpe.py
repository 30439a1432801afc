"""op1: ids and decoded text of every document, as digests."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.llm import bpe
from dropletry.llm.tables import table

VOCABULARY = "word_bpe_49k.json"


def digests(ids: str, path: str):
    """Count and hash of a document's ids, and hash of the text they decode to."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def bpe_digests(rows: pd.Series) -> pd.DataFrame:
        c = bpe.codec(path)
        out = []
        for r in rows:
            a = np.asarray(r, "<u4")
            out.append((len(a), hashlib.sha256(a.tobytes()).hexdigest(), hashlib.sha256(c.decode(a).encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return bpe_digests(ids)


def query(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", digests(bpe.encode("text", path), path).alias("d")).select("doc_id", "d.*")
