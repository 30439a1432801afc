"""Variant calls in text (VCF): a reader, genotypes in long form, and a writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.functions.filters import alleles_of


def first_of_each_key(pairs: Column) -> Column:
    """A map of pairs (key, value); of those that share a key the first one counts."""
    keys = F.transform(pairs, lambda p: p["key"])
    return F.map_from_entries(F.filter(pairs, lambda p, k: F.array_position(keys, p["key"]) == k + 1))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos (1-based), id, ref, alts, qual, filters, info (map; flags map to ""), and samples, an
    array of maps from FORMAT keys to values, in the header's order.  "." is null.  Of a key that is given more
    than once the first value counts; values without a key are left out."""
    return parse_vcf(spark.read.text(path))


def parse_vcf(lines: DataFrame) -> DataFrame:
    """The records of lines (value), as ``read_vcf`` gives them."""
    lines = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    f = F.split("value", "\t")
    known = lambda c: F.when(c != ".", c)
    pair = lambda x: F.struct(F.split(x, "=", 2)[0].alias("key"), F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit("")).alias("value"))
    info = first_of_each_key(F.transform(F.filter(F.split(F.get(f, F.lit(7)), ";"), lambda x: (x != ".") & (x != "")), pair))
    keys = F.split(F.get(f, F.lit(8)), ":")
    zipped = lambda v: F.zip_with(F.slice(keys, F.lit(1), F.size(v)), F.slice(v, F.lit(1), F.size(keys)), lambda k, x: F.struct(k.alias("key"), x.alias("value")))
    sample = lambda x: first_of_each_key(zipped(F.split(x, ":")))
    return lines.select(
        F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("pos"), known(F.get(f, F.lit(2))).alias("id"), F.get(f, F.lit(3)).alias("ref"), F.split(F.get(f, F.lit(4)), ",").alias("alts"), known(F.get(f, F.lit(5))).try_cast("float").alias("qual"),
        F.when(F.get(f, F.lit(6)) == ".", F.array().cast("array<string>")).otherwise(F.split(F.get(f, F.lit(6)), ";")).alias("filters"), info.alias("info"),
        F.when(F.size(f) > 9, F.transform(F.slice(f, 10, 1 << 20), sample)).alias("samples"),
    )


def sample_names(spark: SparkSession, path: str, header: str | None = None) -> list[str]:
    """The samples of a file, from its one header line, or from that of another file named ``header``."""
    line = spark.read.text(header or path).where(F.col("value").startswith("#CHROM")).first()
    return line["value"].split("\t")[9:] if line else []


def read_variants(spark: SparkSession, path: str, include: Column | None = None, exclude: Column | None = None, filters: list[str] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """``read_vcf`` with its filters: wanted FILTER values, a list of variants, and one condition to include
    or to exclude records by."""
    from dropletry.operators.genotypes import with_filters

    if include is not None and exclude is not None:
        raise ValueError("records are either included or excluded by a condition")
    rows = with_filters(read_vcf(spark, path), filters or [])
    rows = rows if keys is None else extracted(rows, keys)
    return rows.where(F.coalesce(include, F.lit(False))) if include is not None else rows.where(~F.coalesce(exclude, F.lit(False))) if exclude is not None else rows


def genotypes(variants: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """(chrom, pos, ref, alt, sample, alleles: their numbers, gt: those that are not the reference's).

    gt is null where an allele is missing; alleles holds null there, and one number where haploid.

    ``keep``: these samples only, in the order of their names.
    """
    rows = variants.select("chrom", "pos", "ref", F.col("alts")[0].alias("alt"), F.posexplode("samples").alias("at", "s"))
    called = alleles_of(F.col("s")["GT"])
    gt = F.when(F.forall(called, lambda a: a.isNotNull()), F.size(F.filter(called, lambda a: a > 0)).cast("long"))
    rows = rows.withColumn("sample", F.get(F.array(*(F.lit(n) for n in names)), F.col("at"))).withColumns({"alleles": called, "gt": gt}).drop("s", "at")
    return rows.where(F.col("sample").isin(sorted(keep))) if keep else rows


def extracted(variants: DataFrame, keys: DataFrame) -> DataFrame:
    """The variants whose chrom, pos, ref and alternative alleles, all of them in their order, are listed; keys:
    (chrom, pos, ref, and alts: an array, or alt: its text with commas)."""
    alts = F.col("alts") if "alts" in keys.columns else F.split("alt", ",")
    listed = keys.select("chrom", "pos", "ref", alts.alias("alts")).distinct()
    return variants.join(listed, ["chrom", "pos", "ref", "alts"], "left_semi").select(variants.columns)


def sample_text(fields: dict[str, Column]) -> tuple[str, Column]:
    """FORMAT and a sample's text of fields in their order; a missing value is "."."""
    return ":".join(fields), F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit(".")) for c in fields.values()))


def write_vcf(calls: DataFrame, path: str, samples: int, form: str = "GT:GQ") -> None:
    """One line for each variant (chrom, pos, ref, alt, s0, s1, ...: the samples' texts in ``form``), sorted."""
    columns = [f"s{k}" for k in range(samples)]
    head = "\n".join(["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *columns])])
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit(form), *(F.coalesce(c, F.lit("./.")) for c in columns))
    body = calls.orderBy("chrom", "pos").select(line.alias("value"))
    calls.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).unionByName(body).write.mode("overwrite").text(path, compression="gzip")
