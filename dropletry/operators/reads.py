"""Reads and bases: filters, tags, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of alignment flags that exclude a read.
DEFAULT_EXCLUDE, SECOND_EXCLUDE = 0x0F04, 0x0704


def passing(reads: DataFrame, min_mapq: int = 20, exclude: int = DEFAULT_EXCLUDE | SECOND_EXCLUDE) -> DataFrame:
    """Reads (mapq, flag) of sufficient mapping quality without an excluded flag."""
    return reads.where((F.col("mapq") >= min_mapq) & (F.col("flag").bitwiseAND(F.lit(exclude)) == 0))


def usable_bases(bases: DataFrame, min_bq: int = 13, cap_bq: int = 40, min_tail: int = 0) -> DataFrame:
    """Bases (bq, rpos, read_len) of sufficient quality, away from the read's ends; quality is capped."""
    kept = bases.where((F.col("bq") >= min_bq) & (F.col("rpos") >= min_tail - 1) & (F.col("rpos") + min_tail <= F.col("read_len")))
    return kept.withColumn("bq", F.least("bq", F.lit(cap_bq)))


def allele_code(base: Column, ref: Column, alt: Column) -> Column:
    """0 reference, 1 alternative, 2 another base."""
    return F.when(base == ref, 0).when(base == alt, 1).otherwise(2)


def whitelisted(reads: DataFrame, barcodes: DataFrame, key: str = "barcode") -> DataFrame:
    """Reads of the listed barcodes."""
    return reads.join(barcodes.select(key).distinct(), key, "left_semi")


def tagged(reads: DataFrame, tag: str, column: str, skip_empty: bool = False) -> DataFrame:
    """``column``: the value of a tag (tags: map), "." where it is missing or, if asked, no row."""
    value = F.col("tags")[tag]
    return reads.where(value.isNotNull()).withColumn(column, value) if skip_empty else reads.withColumn(column, F.coalesce(value, F.lit(".")))


def read_class(n_new: Column, n_redundant: Column, n_low: Column, n_other: Column) -> Column:
    """Of the bases a read puts on variants, the class that counts it: each read has one."""
    return (
        F.when(n_new > 1, "MULTI").when(n_new == 1, "PASS").when(n_redundant > 0, "REDUNDANT").when(n_low > 0, "LOWQUAL").when(n_other > 0, "N").otherwise("NONE")
    )
