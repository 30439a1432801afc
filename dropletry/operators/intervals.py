"""Intervals on contigs, 1-based and closed at both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_overlaps(rows: DataFrame, touching: bool = False, width: int = 1 << 16) -> DataFrame:
    """(chrom, beg, end) with overlapping intervals merged; those that only touch merge if asked.

    Intervals are walked within bins of ``width`` begins.  What reaches into a bin from before, and how
    many merged ones begin before it, follow from a row for each bin; so no task walks a whole contig.
    """
    bins = Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("chrom", "bin").orderBy("beg", "end")
    placed = rows.select("chrom", "beg", "end").distinct().withColumn("bin", F.floor(F.col("beg") / width))
    before = placed.groupBy("chrom", "bin").agg(F.max("end").alias("most")).withColumn("reach", F.max("most").over(bins)).drop("most")
    reach = F.greatest("reach", F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(reach.isNull() | (F.col("beg") > reach + int(touching)), 1).otherwise(0)
    marked = placed.join(before, ["chrom", "bin"]).withColumn("new", new).drop("reach")
    upto = marked.withColumn("own", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    starts = marked.groupBy("chrom", "bin").agg(F.sum("new").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(bins), F.lit(0))).drop("n")
    islands = upto.join(starts, ["chrom", "bin"]).groupBy("chrom", (F.col("start") + F.col("own")).alias("island"))
    return islands.agg(F.min("beg").alias("beg"), F.max("end").alias("end")).drop("island")


def total_length(merged: DataFrame) -> DataFrame:
    """The positions that merged intervals cover on each contig."""
    return merged.groupBy("chrom").agg(F.sum(F.col("end") - F.col("beg") + 1).cast("long").alias("bases"))


def _bins(beg: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(beg / width), F.floor(end / width)))


def range_join(left: DataFrame, right: DataFrame, width: int, keys: list[str] | None = None, contained: bool = False) -> DataFrame:
    """Pairs of a left (a_beg, a_end) and a right (b_beg, b_end) interval that overlap, once each.

    ``keys`` must be equal besides; ``contained``: the left one lies within the right one.  Both
    sides are spread over the bins of ``width`` positions that they touch and meet by equality; a
    pair counts in the first bin that it shares.
    """
    keys = keys or ["chrom"]
    a = left.withColumn("bin", _bins(F.col("a_beg"), F.col("a_end"), width))
    b = right.withColumn("bin", _bins(F.col("b_beg"), F.col("b_end"), width))
    meets = (F.col("a_beg") <= F.col("b_end")) & (F.col("b_beg") <= F.col("a_end"))
    if contained:
        meets = (F.col("b_beg") <= F.col("a_beg")) & (F.col("a_end") <= F.col("b_end"))
    first = F.floor(F.greatest("a_beg", "b_beg") / width) == F.col("bin")
    return a.join(b, [*keys, "bin"]).where(meets & first).drop("bin")


def parse_region(text: Column) -> Column:
    """struct(chrom, beg, end, strand) of chr:beg-end, chr:beg:len:strand or a whole chr."""
    part = F.split(text, "[:]")
    dashed = F.split(part[1], "-")
    is_dash, is_len = F.size(part) == 2, F.size(part) >= 3
    beg = F.when(is_dash, dashed[0].cast("long")).when(is_len, part[1].cast("long")).otherwise(F.lit(1))
    end = F.when(is_dash & (F.size(dashed) > 1), dashed[1].cast("long")).when(is_len, part[1].cast("long") + part[2].cast("long") - 1)
    return F.struct(part[0].alias("chrom"), beg.cast("long").alias("beg"), end.cast("long").alias("end"), F.when(F.size(part) >= 4, part[3]).alias("strand"))


def overlap_bases(a_beg: Column, a_end: Column, b_beg: Column, b_end: Column) -> Column:
    """The positions that two intervals share."""
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_beg, b_beg) + 1, F.lit(0))


def within_region(rows: DataFrame, chrom: str, beg: int, end: int) -> DataFrame:
    """Intervals (chrom, beg, end) cut to a region; those outside it are left out."""
    cut = rows.where((F.col("chrom") == chrom) & (F.col("beg") <= end) & (F.col("end") >= beg))
    return cut.withColumns({"beg": F.greatest("beg", F.lit(beg)), "end": F.least("end", F.lit(end))})


def shared_contigs(reads: DataFrame, variants: DataFrame) -> DataFrame:
    """(chrom, read_at, variant_at) of the contigs that both lists (chrom, at) name, and in_order: whether
    the lists agree up to there; callers refuse lists that don't, or share nothing.  A row for each contig."""
    both = reads.select("chrom", F.col("at").alias("read_at")).join(variants.select("chrom", F.col("at").alias("variant_at")), "chrom")
    before = F.max("variant_at").over(Window.orderBy("read_at").rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("in_order", F.coalesce(before < F.col("variant_at"), F.lit(True)))


def chunked_paths(contigs: DataFrame, pattern: str, unit: int) -> DataFrame:
    """(chrom, beg, end, path) for each stretch of ``unit`` positions of the contigs (chrom, length): the
    pattern with {CHR}, {BEG} and {END} filled in."""
    rows = contigs.select("chrom", "length", F.explode(F.sequence(F.lit(1).cast("long"), F.col("length"), F.lit(unit).cast("long"))).alias("beg"))
    rows = rows.withColumn("end", F.least(F.col("beg") + unit - 1, F.col("length")))
    path = F.lit(pattern)
    for name, column in (("{CHR}", F.col("chrom")), ("{BEG}", F.col("beg").cast("string")), ("{END}", F.col("end").cast("string"))):
        path = F.replace(path, F.lit(name), column)
    return rows.select("chrom", "beg", "end", path.alias("path"))
