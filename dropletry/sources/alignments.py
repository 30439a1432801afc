"""Text alignments (SAM): reads with tags, bases on variants, aligned blocks, and a writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.sources.variants import first_of_each_key


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, chrom, pos0, mapq, cigar, seq, qual, tags (map) of every record; headers are left out, and
    of a repeated tag all but the first.

    Compressed files are read by their suffix; a path may be a pattern.
    """
    return parse_sam(spark.read.text(path))


def parse_sam(lines: DataFrame) -> DataFrame:
    """The records of lines (value), as ``read_sam`` gives them."""
    lines = lines.where(~F.col("value").startswith("@") & (F.col("value") != ""))
    f = F.split("value", "\t")
    pair = lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 6, 1 << 30).alias("value"))
    tags = first_of_each_key(F.transform(F.slice(f, 12, 1 << 20), pair))
    return lines.select(
        F.get(f, F.lit(0)).alias("qname"), F.get(f, F.lit(1)).try_cast("int").alias("flag"), F.get(f, F.lit(2)).alias("chrom"), (F.get(f, F.lit(3)).try_cast("long") - 1).alias("pos0"), F.get(f, F.lit(4)).try_cast("int").alias("mapq"),
        F.get(f, F.lit(5)).alias("cigar"), F.get(f, F.lit(9)).alias("seq"), F.get(f, F.lit(10)).alias("qual"), tags.alias("tags"),
    )


def in_regions(reads: DataFrame, regions: list[tuple[str, int, int]]) -> DataFrame:
    """Reads that start in one of some regions (chrom, beg, end), 1-based and closed: a predicate that a
    sorted layout prunes by; a read that two regions hold comes once."""
    test = F.lit(False)
    for chrom, beg, end in regions:
        test = test | ((F.col("chrom") == chrom) & F.col("pos0").between(beg - 1, end - 1))
    return reads.where(test)


def overlapping(reads: DataFrame, intervals: DataFrame, width: int = 1024) -> DataFrame:
    """Reads that overlap an interval (chrom, beg, end; 1-based, closed) of a list of any length, once each;
    by the places of the read's first and last aligned base."""
    from dropletry.operators.alleles import read_ends
    from dropletry.operators.intervals import merge_overlaps, range_join

    targets = merge_overlaps(intervals).withColumnsRenamed({"beg": "b_beg", "end": "b_end"})
    placed = reads.withColumns({"a_beg": F.col("pos0") + 1, "a_end": read_ends(F.col("pos0"), F.col("cigar"))["end"]})
    hits = range_join(placed, targets, width)
    # Merged targets are apart, so a read over several of them counts at the first.
    first = hits.groupBy(*(c for c in reads.columns if c != "tags"), F.to_json("tags").alias("tags")) if "tags" in reads.columns else hits.groupBy(*reads.columns)
    out = first.agg(F.min("b_beg").alias("b_beg")).drop("b_beg")
    return out.withColumn("tags", F.from_json("tags", "map<string,string>")).select(reads.columns) if "tags" in reads.columns else out.select(reads.columns)


def cigar_parts(cigar: Column) -> Column:
    """The operations of a CIGAR string as structs (n, op)."""
    part = lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("long").alias("n"), F.substring(x, -1, 1).alias("op"))
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[A-Z=])"), 1), part)


def aligned_blocks(reads: DataFrame) -> DataFrame:
    """One row for each run of aligned bases: beg and end in the reference (0-based, end excluded), and
    rpos, the place in the read where it starts.

    M advances both; D and N the reference; S and I the read; other operations advance neither.
    """
    moved = lambda parts, ops: F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s + F.when(p["op"].isin(*ops), p["n"]).otherwise(0))
    rows = reads.withColumn("_parts", cigar_parts(F.col("cigar"))).select("*", F.posexplode("_parts").alias("_k", "_p"))
    before = F.slice(F.col("_parts"), F.lit(1), F.col("_k"))
    beg = F.col("pos0") + moved(before, "MDN")
    rows = rows.withColumn("beg", beg).withColumn("rpos", moved(before, "MSI")).where(F.col("_p")["op"] == "M")
    return rows.withColumn("end", F.col("beg") + F.col("_p")["n"]).drop("_parts", "_k", "_p")


def bases_on_variants(reads: DataFrame, snps: DataFrame, width: int = 128) -> DataFrame:
    """One row for each variant (snp_id, chrom, pos: 1-based) that an aligned block covers: the read's
    columns with snp_id, base, bq, rpos (from 0) and read_len.  Deleted and skipped places give none."""
    blocks = aligned_blocks(reads).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("beg") / width), F.floor((F.col("end") - 1) / width))))
    points = snps.withColumn("_bin", F.floor((F.col("pos") - 1) / width))
    hits = blocks.join(points, ["chrom", "_bin"]).where((F.col("pos") > F.col("beg")) & (F.col("pos") <= F.col("end")))
    at = F.col("rpos") + F.col("pos") - 1 - F.col("beg")
    hits = hits.withColumn("rpos", at.cast("int"))
    return hits.withColumns({
        "base": F.substring("seq", F.col("rpos") + 1, F.lit(1)), "bq": F.ascii(F.substring("qual", F.col("rpos") + 1, F.lit(1))) - 33, "read_len": F.length("seq"),
    }).drop("_bin", "beg", "end")


def write_sam(reads: DataFrame, path: str) -> None:
    """Records as text in the order of chrom and position; tags are written as strings."""
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.concat(t["key"], F.lit(":Z:"), t["value"])), "\t")
    core = F.concat_ws("\t", "qname", "flag", "chrom", (F.col("pos0") + 1).cast("string"), "mapq", "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", "qual")
    line = F.when(F.size("tags") > 0, F.concat_ws("\t", core, tags)).otherwise(core)
    reads.orderBy("chrom", "pos0", "qname").select(line.alias("value")).write.mode("overwrite").text(path, compression="gzip")
