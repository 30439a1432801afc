"""op5: every document's bytes stored as a TIFF page, read back, with digests and features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dropletry.llm import tiff
from dropletry.llm.tables import table

#: A payload is a multiple of so many bytes, and an image so wide.
UNIT, WIDTH = 576, 64


@F.pandas_udf(T.BinaryType())
def stored(texts: pd.Series) -> pd.Series:
    """The TIFF file of each text's UTF-8 bytes, filled up with 255."""
    out = []
    for t in texts:
        raw = (t or "").encode()
        raw += b"\xff" * (-len(raw) % UNIT if raw else UNIT)
        out.append(tiff.encode([np.frombuffer(raw, np.uint8).reshape(-1, WIDTH, 1)]))
    return pd.Series(out, index=texts.index, dtype=object)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    files = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), stored("text").alias("media"))
    return tiff.read_pages(files).select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.expr("crc32(substring(pixels, -32, 32))").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%dx%d mean %.3f stddev %.3f entropy %.4f", "width", "height", "mean", "stddev", "entropy").alias("feature"),
    )
