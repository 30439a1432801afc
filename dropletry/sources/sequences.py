"""Reads without alignments (FASTQ) and reference sequences (FASTA) from numbered lines.

A line's number is what tells records apart, so lines come with ``at``, counted from 0 in each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dropletry.operators.ranking import saved


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): the lines of text files with their numbers.

    Spark numbers rows within a partition; the partitions' sizes, a row each, give the rest.
    """
    rows = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("id"))
    rows = rows.withColumns({"part": F.shiftright("id", 33), "own": F.col("id").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("file", "part").agg(F.count("*").alias("n"), F.min("own").alias("first"))
    earlier = sizes.select("file", F.col("part").alias("before"), F.col("n").alias("m"))
    starts = sizes.join(earlier, "file").where("before <= part").groupBy("file", "part").agg(F.sum(F.when(F.col("before") < F.col("part"), F.col("m")).otherwise(0)).alias("start"), F.first("first").alias("first"))
    return rows.join(F.broadcast(starts), ["file", "part"]).select("file", (F.col("start") + F.col("own") - F.col("first")).alias("at"), "value")


def fastq(lines: DataFrame) -> DataFrame:
    """(file, record, name, seq, qual) of lines (file, at, value), four to a record; records whose sequence
    and qualities differ in length are left out."""
    of = lambda k: F.max(F.when(F.col("at") % 4 == k, F.col("value")))
    rows = lines.groupBy("file", F.floor(F.col("at") / 4).alias("record")).agg(of(0).alias("name"), of(1).alias("seq"), of(3).alias("qual"))
    return rows.where(F.length("seq") == F.length("qual")).withColumn("name", F.regexp_extract("name", r"^@(\S*)", 1))


def fasta(lines: DataFrame) -> DataFrame:
    """(chrom, pos0, seq) of lines (at, value): upper-cased stretches of the sequences, with the place of
    each one's first base.  Lines may be of any width; those before the first header are left out.

    Lines are sorted in ranges.  Within a range a running count of headers and a running sum of lengths tell
    sequences and places; what the lines before a range's first header carry on comes from the ranges before
    it: their last headers and the bases after those, a row for each range.
    """
    ranged = lines.select("at", "value").where(F.col("value") != "").repartitionByRange("at")
    ranged = saved(ranged.withColumn("_range", F.spark_partition_id()))
    head = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S*)", 1))
    bases = F.when(F.col("value").startswith(">"), 0).otherwise(F.length("value"))
    upto = Window.partitionBy("_range").orderBy("at")
    rows = ranged.withColumns({"head": head, "bases": bases, "turn": F.count(head).over(upto)})
    upto = Window.partitionBy("_range", "turn").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"own": F.first("head").over(upto), "pos0": F.sum("bases").over(upto) - F.col("bases")})
    last = rows.groupBy("_range", "turn").agg(F.first("own").alias("own"), F.sum("bases").alias("bases"))
    last = last.groupBy("_range").agg(F.max_by(F.struct("own", "bases"), "turn").alias("x")).orderBy("_range")
    carried, chrom, place = [], None, 0
    for r in last.collect():
        carried.append((r["_range"], chrom, place))
        chrom, place = (r["x"]["own"], r["x"]["bases"]) if r["x"]["own"] is not None else (chrom, place + r["x"]["bases"])
    before = F.broadcast(lines.sparkSession.createDataFrame(carried, "_range int, _chrom string, _place long"))
    rows = rows.where("head is null").join(before, "_range")
    begun = F.col("turn") > 0
    rows = rows.select(F.when(begun, F.col("own")).otherwise(F.col("_chrom")).alias("chrom"), (F.col("pos0") + F.when(begun, 0).otherwise(F.col("_place"))).alias("pos0"), F.upper("value").alias("seq"))
    return rows.where("chrom is not null")


def blocks(stretches: DataFrame, width: int) -> DataFrame:
    """Stretches (chrom, pos0, seq) of any width cut and joined to blocks of one width; the last of a sequence
    may be shorter."""
    first, last = F.floor(F.col("pos0") / width), F.floor((F.col("pos0") + F.length("seq") - 1) / width)
    rows = stretches.where(F.length("seq") > 0).withColumn("block", F.explode(F.sequence(first, last)))
    beg = F.greatest(F.col("pos0"), F.col("block") * width)
    piece = F.substring("seq", (beg - F.col("pos0") + 1).cast("int"), (F.least(F.col("pos0") + F.length("seq"), (F.col("block") + 1) * width) - beg).cast("int"))
    rows = rows.select("chrom", "block", beg.alias("beg"), piece.alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("beg", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy("chrom", "block").agg(joined.alias("seq")).select("chrom", (F.col("block") * width).alias("pos0"), "seq")


def bases_at(stretches: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """Points (chrom, pos: from 1) with the reference's base there; ``width``: of the blocks."""
    keyed = points.withColumn("pos0", F.floor((F.col("pos") - 1) / width) * width)
    return keyed.join(stretches, ["chrom", "pos0"]).withColumn("base", F.expr("substring(seq, cast(pos - pos0 as int), 1)")).drop("pos0", "seq")


def bases_between(blocks: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """Ranges (key: one each, chrom, beg, end: from 1, closed) with the reference's bases there, over as many
    blocks of that width as they touch; bases outside of the sequence are left out."""
    keyed = ranges.withColumn("block", F.explode(F.sequence(F.floor((F.col("beg") - 1) / width), F.floor((F.col("end") - 1) / width))))
    rows = keyed.withColumn("pos0", F.col("block") * width).join(blocks, ["chrom", "pos0"])
    beg = F.greatest(F.col("beg") - 1 - F.col("pos0"), F.lit(0))
    piece = F.substring("seq", (beg + 1).cast("int"), (F.least(F.col("end") - F.col("pos0"), F.lit(width)) - beg).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", piece.alias("piece")))), lambda x: x["piece"]), "")
    return rows.groupBy("key").agg(joined.alias("bases"))
