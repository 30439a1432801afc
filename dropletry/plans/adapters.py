"""The tables of a dataset folder in the roles of reads, droplets, variants, donors and genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.operators.genotypes import call_posterior

#: Total order of reads.
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]
DONORS = 5

OBS = """obs AS (SELECT l_suppkey AS cell_id, l_partkey AS snp_id, l_orderkey % 4 AS umi,
  CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS allele, CAST(l_quantity AS INTEGER) AS bq,
  l_shipdate, l_orderkey, l_linenumber, l_extendedprice FROM lineitem)"""
UNIQUE = OBS + """, uniq AS (SELECT snp_id, cell_id, umi, allele, bq, n_dup FROM (
  SELECT *, count(*) OVER (PARTITION BY snp_id, cell_id, umi) AS n_dup,
    row_number() OVER (PARTITION BY snp_id, cell_id, umi ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, allele, bq) AS r
  FROM obs) WHERE r = 1)"""
SNPS = "snps AS (SELECT p_partkey AS snp_id, 0.05e0 + 0.9e0 * (p_size - 1) / 49e0 AS af FROM part)"
CALLS = """calls AS (SELECT p_partkey AS snp_id, d AS donor, 0.05e0 + 0.9e0 * (p_size - 1) / 49e0 AS af, p_size / 50e0 AS r2,
  CASE WHEN (p_partkey + d) % 11 = 0 THEN NULL ELSE (d * 7 + p_partkey * 3 + (p_partkey * d) % 5) % 3 END AS gt
  FROM part CROSS JOIN range(5) t(d))"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """One base of a read on a variant: cell_id, snp_id, umi, allele, bq and the read's order."""
    allele = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("snp_id"), (F.col("l_orderkey") % 4).alias("umi"), allele.alias("allele"),
        F.col("l_quantity").cast("int").alias("bq"), *ORDER,
    )


def variants(spark: SparkSession, folder: str) -> DataFrame:
    """snp_id and the frequency of its alternative allele, strictly between 0 and 1."""
    return table(spark, folder, "part").select(F.col("p_partkey").alias("snp_id"), (F.lit(0.05) + F.lit(0.9) * (F.col("p_size") - 1) / F.lit(49.0)).alias("af"))


def donor_calls(spark: SparkSession, folder: str) -> DataFrame:
    """snp_id, donor, gt (null where missing), af, r2."""
    rows = table(spark, folder, "part").select("p_partkey", "p_size", F.explode(F.array(*(F.lit(d).cast("long") for d in range(DONORS)))).alias("d"))
    gt = (F.col("d") * 7 + F.col("p_partkey") * 3 + (F.col("p_partkey") * F.col("d")) % 5) % 3
    return rows.select(
        F.col("p_partkey").alias("snp_id"), F.col("d").alias("donor"), F.when((F.col("p_partkey") + F.col("d")) % 11 != 0, gt).alias("gt"),
        (F.lit(0.05) + F.lit(0.9) * (F.col("p_size") - 1) / F.lit(49.0)).alias("af"), (F.col("p_size") / F.lit(50.0)).alias("r2"),
    )


def donor_posteriors(spark: SparkSession, folder: str) -> DataFrame:
    """snp_id and p, the 3 genotype probabilities of each donor one after another."""
    gp = [c.alias(f"gp{g}") for g, c in enumerate(call_posterior(F.col("gt"), F.col("af"), 0.01))]
    rows = donor_calls(spark, folder).select("snp_id", "donor", *gp)
    one = lambda d, g: F.max(F.when(F.col("donor") == d, F.col(f"gp{g}")))
    return rows.groupBy("snp_id").agg(F.array(*(one(d, g) for d in range(DONORS) for g in range(3))).alias("p"))
