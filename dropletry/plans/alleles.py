"""Queries on alleles, reads as values, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.functions.logs import log10_binomial, log10_factorial, log10_sum, phred_of_error, pl_of, probability_of_pl
from dropletry.operators import alleles as a
from dropletry.plans.adapters import table
from dropletry.sources import alignments

_BEFORE = "ACACACGTGTTTACGCGCAT"
_REF, _ALT = "substring('ACGTACGTTTACAC', {0} % 9 + 1, {0} % 5 + 1)", "substring('ACGTACGTTTACAC', {0} % 7 + 1, {0} % 4 + 1)"


def part(s: SparkSession, f: str) -> DataFrame:
    """A variant for each part: pos, ref, alt and the bases before it."""
    cast = lambda x: F.expr(x.format("cast(p_partkey as int)"))
    before = F.left(F.lit(_BEFORE), (F.col("p_partkey") % 20 + 1).cast("int"))
    return table(s, f, "part").select("p_partkey", (F.col("p_partkey") + 100).alias("pos"), cast(_REF).alias("ref"), cast(_ALT).alias("alt"), before.alias("before"))


def variant_is_normalized(s: SparkSession, f: str) -> DataFrame:
    return part(s, f).select("p_partkey", a.is_normalized(F.col("ref"), F.array("alt")).alias("normal"))


def variant_normalize(s: SparkSession, f: str) -> DataFrame:
    return part(s, f).select("p_partkey", a.normalized(F.col("pos"), F.col("ref"), F.col("alt"), F.col("before")).alias("v")).select("p_partkey", "v.*")


def variant_probes(s: SparkSession, f: str) -> DataFrame:
    rows = part(s, f).withColumn("bases", F.left("before", F.length("ref")))
    both = a.probes(F.col("ref"), F.col("alt"), F.col("before"), F.reverse("before"), 5)
    return rows.select("p_partkey", a.consistent_reference(F.col("ref"), F.col("bases")).alias("fits"), both.alias("p")).select("p_partkey", "fits", "p.*")


def sv_type_reduce(s: SparkSession, f: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("<CN"), "p_size", F.lit(">"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("<VN"), "p_size", F.lit(">")))
    kind = kind.when(F.col("p_size") % 4 == 2, "<CNx>").otherwise("<DEL>")
    return table(s, f, "part").groupBy(a.reduced_sv_type(kind).alias("kind")).agg(F.count("*").alias("n"))


def vntr_units(s: SparkSession, f: str) -> DataFrame:
    seq = F.repeat(F.left(F.lit("ACAGTC"), (F.col("p_partkey") % 6 + 1).cast("int")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(s, f, "part").select("p_partkey", a.repeat_unit(seq).alias("u")).select("p_partkey", "u.motif", "u.copies")


def variant_text(s: SparkSession, f: str) -> DataFrame:
    return part(s, f).select("p_partkey", a.variant_text(F.lit("1"), F.col("pos"), F.col("ref"), F.array("alt", "before")).alias("text"))


def ploidy_by_sex(s: SparkSession, f: str) -> DataFrame:
    chrom = F.element_at(F.array(*(F.lit(x) for x in ("1", "chrX", "Y", "MT"))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    rows = table(s, f, "customer").select("c_custkey", chrom.alias("chrom"), (F.col("c_custkey") * 200000).alias("pos"), (F.col("c_custkey") % 2 == 1).alias("male"))
    return rows.groupBy("chrom", "male", a.ploidy(F.col("chrom"), F.col("pos"), F.col("male")).alias("ploidy")).agg(F.count("*").alias("n"))


def genotype_index(s: SparkSession, f: str) -> DataFrame:
    x, y = F.col("p_size") % 5, F.col("p_partkey") % 5
    return table(s, f, "part").select("p_partkey", a.genotype_index(x, y).cast("long").alias("at"), a.genotype_count(F.col("p_size"), 2).alias("diploid"), a.genotype_count(F.col("p_size"), 3).alias("triploid"))


def iupac_codes(s: SparkSession, f: str) -> DataFrame:
    base = lambda c: F.substring(F.lit("ACGTN"), (c % 5 + 1).cast("int"), F.lit(1))
    rows = table(s, f, "part").select(a.iupac(base(F.col("p_size")), base(F.col("p_partkey"))).alias("code"), F.round(a.phred_score(F.col("p_size") % 10 / 10), 6).alias("score"))
    return rows.groupBy("code", "score").agg(F.count("*").alias("n"))


def kmer_codes(s: SparkSession, f: str) -> DataFrame:
    return part(s, f).select("p_partkey", a.kmer_code(F.concat("ref", "alt")).alias("code"))


def thinning(s: SparkSession, f: str) -> DataFrame:
    return table(s, f, "customer").where(a.thinned(F.col("c_name"), 0.3, 7)).select("c_custkey")


def aligned(s: SparkSession, f: str) -> DataFrame:
    """A read for each order: 3S, b M, 2I, 4D, e M, 5N, 2M, 1H at pos0."""
    b, e = F.col("o_orderkey") % 20 + 1, F.col("o_custkey") % 30 + 1
    rows = table(s, f, "orders").select("o_orderkey", F.lit("1").alias("chrom"), F.col("o_custkey").alias("pos0"), b.alias("b"), e.alias("e"))
    seq = F.left(F.repeat(F.lit("ACGTTGCA"), F.lit(9)), (F.col("b") + F.col("e") + 7).cast("int"))
    return rows.withColumns({"cigar": F.concat(F.lit("3S"), "b", F.lit("M2I4D"), "e", F.lit("M5N2M1H")), "seq": seq, "qual": F.translate(seq, "ACGT", "+5?I")})


def cigar_ends(s: SparkSession, f: str) -> DataFrame:
    return aligned(s, f).select("o_orderkey", a.read_ends(F.col("pos0"), F.col("cigar")).alias("x")).select("o_orderkey", "x.*")


def cigar_blocks(s: SparkSession, f: str) -> DataFrame:
    return alignments.aligned_blocks(aligned(s, f)).select("o_orderkey", "beg", "end", "rpos")


def cigar_bases(s: SparkSession, f: str) -> DataFrame:
    snps = table(s, f, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("snp_id"), F.lit("1").alias("chrom"), (F.col("c_custkey") + 10).alias("pos"))
    return alignments.bases_on_variants(aligned(s, f), snps, 32).select("o_orderkey", "snp_id", "rpos", "base", F.col("bq").cast("int").alias("bq"))


def log10_toolbox(s: SparkSession, f: str) -> DataFrame:
    n, p = F.col("p_size"), F.col("p_size") / 51.0
    r = lambda c: F.round(c, 6)
    return table(s, f, "part").select(
        "p_partkey", r(log10_factorial(n)).alias("factorial"), r(log10_binomial(n, F.floor(n / 3).cast("int"))).alias("choose"), r(log10_sum(F.log10(p), F.log10(p / 3))).alias("total"),
        pl_of(p).alias("pl"), r(probability_of_pl(n)).alias("prob"), phred_of_error(p).alias("phred"),
    ).distinct()


QUERIES = {
    "variant_is_normalized": variant_is_normalized, "variant_normalize": variant_normalize, "variant_probes": variant_probes, "sv_type_reduce": sv_type_reduce, "vntr_units": vntr_units,
    "variant_text": variant_text, "ploidy_by_sex": ploidy_by_sex, "genotype_index": genotype_index, "iupac_codes": iupac_codes, "kmer_codes": kmer_codes, "thinning": thinning,
    "cigar_ends": cigar_ends, "cigar_blocks": cigar_blocks, "cigar_bases": cigar_bases, "log10_toolbox": log10_toolbox,
}

# ---- The same in SQL ----
_R, _A = _REF.format("p_partkey"), _ALT.format("p_partkey")
_PART = f"v AS (SELECT p_partkey, p_partkey + 100 AS pos, {_R} AS ref, {_A} AS alt, substr('{_BEFORE}', 1, p_partkey % 20 + 1) AS before FROM part)"
_READ = "r AS (SELECT o_orderkey, o_custkey AS pos0, o_orderkey % 20 + 1 AS b, o_custkey % 30 + 1 AS e FROM orders)"
_BLOCKS = _READ + ", k AS (SELECT o_orderkey, pos0 AS beg, pos0 + b AS stop, 3 AS rpos FROM r UNION ALL SELECT o_orderkey, pos0 + b + 4, pos0 + b + 4 + e, b + 5 FROM r UNION ALL SELECT o_orderkey, pos0 + b + e + 9, pos0 + b + e + 11, b + e + 5 FROM r)"
_HASH = "list_reduce(list_prepend({1}::BIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 101 + c) % 4294967296)"
ORACLE_SQL = {
    "variant_is_normalized": f"WITH {_PART} SELECT p_partkey, ref = alt OR (len(ref) = 1 AND len(alt) = 1) OR NOT (right(ref, 1) = right(alt, 1) OR (len(ref) > 1 AND len(alt) > 1 AND ref[1] = alt[1])) AS normal FROM v",
    "variant_normalize": f"""WITH RECURSIVE {_PART}, x AS (SELECT p_partkey, pos - len(before) AS start, before || ref AS r, before || alt AS a, ref, alt, pos FROM v WHERE ref <> alt),
      t AS (SELECT p_partkey, start, r, a FROM x UNION ALL SELECT p_partkey, start, r[:-2], a[:-2] FROM t WHERE len(r) > 1 AND len(a) > 1 AND right(r, 1) = right(a, 1)),
      e AS (SELECT p_partkey, start, r, a FROM t QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY len(r)) = 1),
      h AS (SELECT p_partkey, start, r, a FROM e UNION ALL SELECT p_partkey, start + 1, r[2:], a[2:] FROM h WHERE len(r) > 1 AND len(a) > 1 AND r[1] = a[1])
      SELECT p_partkey, start AS pos, r AS ref, a AS alt FROM h QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY len(r)) = 1 UNION ALL SELECT p_partkey, pos, ref, alt FROM v WHERE ref = alt""",
    "variant_probes": f"WITH {_PART} SELECT p_partkey, len(ref) <= len(before) AND starts_with(before, ref) AS fits, right(before, 5) || ref || left(reverse(before), 5) AS ref, right(before, 5) || alt || left(reverse(before), 5) AS alt FROM v",
    "sv_type_reduce": "SELECT CASE p_size % 4 WHEN 0 THEN '<CNV>' WHEN 1 THEN '<VNTR>' WHEN 2 THEN '<CNx>' ELSE '<DEL>' END AS kind, count(*) AS n FROM part GROUP BY 1",
    "vntr_units": "SELECT p_partkey, CASE WHEN n > 1 THEN unit END AS motif, CAST(CASE WHEN n > 1 THEN n END AS INTEGER) AS copies FROM (SELECT p_partkey, p_partkey % 4 + 1 AS n, substr('ACAGTC', 1, p_partkey % 6 + 1) AS unit FROM part)",
    "variant_text": f"WITH {_PART} SELECT p_partkey, '1:' || pos || ':' || ref || ':' || CASE WHEN alt <= before THEN alt || ',' || before ELSE before || ',' || alt END AS text FROM v",
    "ploidy_by_sex": f"WITH c AS (SELECT ['1', 'chrX', 'Y', 'MT'][c_nationkey % 4 + 1] AS chrom, c_custkey * 200000 AS pos, c_custkey % 2 = 1 AS male FROM customer) SELECT chrom, male, CAST(CASE WHEN chrom = 'chrX' THEN CASE WHEN male AND pos BETWEEN {a.X_BEGIN} AND {a.X_END} THEN 1 ELSE 2 END WHEN chrom = 'Y' THEN CASE WHEN male THEN 1 ELSE 0 END WHEN chrom = 'MT' THEN 1 ELSE 2 END AS INTEGER) AS ploidy, count(*) AS n FROM c GROUP BY ALL",
    "genotype_index": "SELECT p_partkey, CAST(least(p_size % 5, p_partkey % 5) + greatest(p_size % 5, p_partkey % 5) * (greatest(p_size % 5, p_partkey % 5) + 1) // 2 AS BIGINT) AS at, CAST(p_size * (p_size + 1) // 2 AS BIGINT) AS diploid, CAST(p_size * (p_size + 1) * (p_size + 2) // 6 AS BIGINT) AS triploid FROM part",
    "iupac_codes": "WITH b AS (SELECT substr('ACGTN', p_size % 5 + 1, 1) AS x, substr('ACGTN', p_partkey % 5 + 1, 1) AS y, p_size % 10 / 10 AS p FROM part) SELECT CASE WHEN x = 'N' OR y = 'N' THEN 'N' WHEN x = y THEN x ELSE CASE least(x, y) || greatest(x, y) WHEN 'AC' THEN 'M' WHEN 'AG' THEN 'R' WHEN 'AT' THEN 'W' WHEN 'CG' THEN 'S' WHEN 'CT' THEN 'Y' ELSE 'K' END END AS code, round(CASE WHEN p = 0 THEN 99e0 ELSE least(99e0, -4.3429e0 * ln(p)) END, 6) AS score, count(*) AS n FROM b GROUP BY 1, 2",
    "kmer_codes": f"WITH {_PART} SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(ref || alt, ''), lambda c: (strpos('ACGT', c) - 1)::BIGINT)), lambda x, y: x * 4 + y) AS code FROM v",
    "thinning": f"SELECT c_custkey FROM customer WHERE {_HASH.format('c_name', 7)} % 65535 < 19660",
    "cigar_ends": f"WITH {_READ} SELECT o_orderkey, pos0 + b + e + 11 AS \"end\", pos0 - 3 AS clip_beg, pos0 + b + e + 12 AS clip_end, b + e + 17 AS ops FROM r",
    "cigar_blocks": f"WITH {_BLOCKS} SELECT o_orderkey, beg, stop AS \"end\", CAST(rpos AS BIGINT) AS rpos FROM k",
    "cigar_bases": f"WITH {_BLOCKS}, s AS (SELECT c_custkey AS snp_id, c_custkey + 10 AS pos FROM customer WHERE c_custkey % 5 = 0), h AS (SELECT o_orderkey, snp_id, CAST(rpos + pos - 1 - beg AS INTEGER) AS rpos FROM k JOIN s ON pos > beg AND pos <= stop) SELECT o_orderkey, snp_id, rpos, substr('ACGTTGCA', rpos % 8 + 1, 1) AS base, CAST(ord(translate(substr('ACGTTGCA', rpos % 8 + 1, 1), 'ACGT', '+5?I')) - 33 AS INTEGER) AS bq FROM h",
    "log10_toolbox": "WITH x AS (SELECT p_partkey, p_size AS n, p_size // 3 AS k, p_size / 51e0 AS p FROM part), f AS (SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: log10(i))) AS fn, coalesce(list_sum(list_transform(range(1, k + 1), lambda i: log10(i))), 0) AS fk, coalesce(list_sum(list_transform(range(1, n - k + 1), lambda i: log10(i))), 0) AS fr FROM x) SELECT DISTINCT p_partkey, round(fn, 6) AS factorial, round(fn - fk - fr, 6) AS choose, round(log10(p + p / 3), 6) AS total, CAST(floor(-10 * log10(p) + 0.5e0) AS INTEGER) AS pl, round(pow(10, -n / 10e0), 6) AS prob, CAST(floor(-10 * log10(p) + 0.5e0) AS INTEGER) AS phred FROM f",
}
