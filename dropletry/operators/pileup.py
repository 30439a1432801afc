"""The sparse droplet-by-variant pileup: one observation for each (variant, droplet, UMI)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dropletry.operators.ranking import numbered


def dedup_umis(obs: DataFrame, order: list[str]) -> DataFrame:
    """The first allele and quality of each (snp_id, cell_id, umi), and how many reads gave one."""
    first = F.min_by(F.struct("allele", "bq"), F.struct(*order, "allele", "bq"))
    return obs.groupBy("snp_id", "cell_id", "umi").agg(first.alias("b"), F.count("*").alias("n_dup")).select("snp_id", "cell_id", "umi", "b.allele", "b.bq", "n_dup")


def cell_counters(unique: DataFrame) -> DataFrame:
    """Reads, distinct (variant, UMI), UMIs and variants of each droplet."""
    return unique.groupBy("cell_id").agg(
        F.sum("n_dup").alias("n_read"), F.count("*").alias("n_umi_w_snp"), F.count_distinct("umi").alias("n_umi"), F.count_distinct("snp_id").alias("n_snp")
    )


def passing_cells(cells: DataFrame, min_read: int = 0, min_umi: int = 0, min_snp: int = 0) -> DataFrame:
    """Droplets with enough of each; an unknown number of UMIs does not fail a droplet."""
    return cells.where((F.col("n_read") >= min_read) & (F.coalesce("n_umi", F.lit(min_umi)) >= min_umi) & (F.col("n_snp") >= min_snp))


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, id): dense ids from 0 in the order in which keys appear."""
    seen = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("first"))
    return numbered(seen, "id", F.col("first"), F.col(key)).select(key, "id")


def pileup_strings(unique: DataFrame) -> DataFrame:
    """The written form: for each (cell_id, snp_id) the alleles and qualities in the order of UMIs."""
    ordered = F.array_sort(F.collect_list(F.struct("umi", "allele", "bq")))
    rows = unique.groupBy("cell_id", "snp_id").agg(ordered.alias("o"))
    join = lambda f: F.array_join(F.transform("o", f), "")
    return rows.select("cell_id", "snp_id", join(lambda x: x["allele"].cast("string")).alias("alleles"), join(lambda x: F.chr(x["bq"] + 33)).alias("baseqs"))


def parse_pileup_strings(rows: DataFrame, min_bq: int = 13, cap_bq: int = 40) -> DataFrame:
    """Observations back from their written form; UMIs are numbered by their place."""
    pos = F.sequence(F.lit(1), F.length("alleles"))
    one = rows.where(F.length("alleles") > 0).select("*", F.explode(pos).alias("umi"))
    bases = one.select("cell_id", "snp_id", "umi", F.expr("cast(substring(alleles, umi, 1) as int)").alias("allele"), F.expr("ascii(substring(baseqs, umi, 1)) - 33").alias("bq"))
    return bases.where(F.col("bq") >= min_bq).withColumn("bq", F.least("bq", F.lit(cap_bq)))
