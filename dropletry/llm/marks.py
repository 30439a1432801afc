"""Bit maps of bounded size over hashed values: they tell which rows a later pass needs, and may only let too many through."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a map at least and at most.
LEAST, MOST = 1 << 20, 1 << 27
#: Bits that Spark's own bitmap functions keep together.
BUCKET = 32768


def map_bits(values: int) -> int:
    """Bits of a map of so many values: about eight for each, within the bounds."""
    return min(MOST, max(LEAST, 1 << (8 * values).bit_length()))


def place(column: Column, bits: int) -> Column:
    """The bit of a hashed (long) value."""
    return F.pmod(column, F.lit(bits)).cast("int")


def bit_map(values: DataFrame, column: Column, bits: int) -> np.ndarray:
    """The map of a column of longs; built in pieces by Spark, so that the driver gets ``bits`` bits at most."""
    rows = values.select((place(column, bits).cast("long") + 1).alias("m"))
    pieces = rows.groupBy(F.bitmap_bucket_number("m").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("m")).alias("bits")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for b, raw in zip(pieces["b"].to_pylist(), pieces["bits"].to_pylist()):
        out[(b - 1) * BUCKET // 8 :][: BUCKET // 8] = np.frombuffer(raw, np.uint8)[: len(out) - (b - 1) * BUCKET // 8]
    return out


def marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each bit is set."""
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def is_marked(shared, column: Column, bits: int) -> Column:
    """Whether a row's hashed value is in a broadcast map."""

    @F.pandas_udf("boolean")
    def hit(m: pd.Series) -> pd.Series:
        return pd.Series(marked(shared.value, m.to_numpy()), index=m.index)

    return hit(place(column, bits))
