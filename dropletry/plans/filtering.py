"""Queries that filter variant records, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.functions import filters as p
from dropletry.plans.adapters import table


def records(s: SparkSession, f: str) -> DataFrame:
    """An order as a variant record: QUAL, TYPE, AC (several values, some missing), DP (one a sample)."""
    lines = table(s, f, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity", "l_suppkey").alias("x"))
    many = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    ac = F.transform("xs", lambda x: F.when(x["l_partkey"] % 5 != 0, x["l_quantity"]))
    dp = F.transform("xs", lambda x: (x["l_partkey"] % 40).cast("double"))
    return table(s, f, "orders").join(many, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("QUAL"), F.col("o_orderstatus").alias("STATUS"), F.col("o_orderpriority").alias("ID"), ac.alias("AC"), dp.alias("DP"), F.transform("xs", lambda x: x["l_quantity"]).alias("GQ")
    )


def called(s: SparkSession, f: str) -> DataFrame:
    """A part as a record with alleles and the genotypes of six samples, one of them haploid."""
    one = lambda k: F.when((F.col("p_partkey") + k) % 7 == 0, "./.").when(F.lit(k == 5), ((F.col("p_partkey") * 2 + F.col("p_size")) % 3).cast("string")).otherwise(F.concat_ws("/", (F.col("p_partkey") * (k + 1) + F.col("p_size")) % 3, (F.col("p_size") * (k + 2) + k) % 3))
    alts = F.array(F.element_at(F.array(*(F.lit(x) for x in ("C", "AT", "*", "<DEL>", "A]2:9]", "GT"))), F.col("p_size") % 6 + 1), F.element_at(F.array(*(F.lit(x) for x in ("G", "ACC", "."))), F.col("p_size") % 3 + 1))
    rows = table(s, f, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "A").otherwise("AG").alias("ref"), alts.alias("alts"), F.array(*(one(k) for k in range(6))).alias("texts"), F.array(F.col("p_partkey") % 30, F.col("p_size") % 25).alias("ad"))
    return rows.withColumn("gts", F.transform("texts", p.alleles_of))


def tests() -> dict[str, Column]:
    """Filters of the records."""
    c = {n: F.col(n) for n in ("QUAL", "STATUS", "ID", "AC", "DP", "GQ")}
    qual = F.array("QUAL")
    return {
        "predicate_compare": p.any_value(qual, ">", 100) & (p.any_text(c["STATUS"], ["O", "F"]) | p.any_value(F.array(c["QUAL"] / 2), "<", 30)),
        "predicate_any_element": p.any_value(c["AC"], ">=", 45),
        "predicate_missing": p.any_value(c["AC"], "!=", 10) & p.any_value(F.array(F.array_max("AC")), ">", 40),
        "predicate_regex": p.matches(c["ID"], "^[12]-urg", ignore_case=True) | ~p.matches(c["ID"], "[A-Z]"),
        "predicate_aggregates": (p.mean(c["GQ"]) > 30) & (p.median(c["GQ"]) < 35) & (F.size(p.known(c["GQ"])) > 2),
        "predicate_subscript": p.any_value(p.at(c["GQ"], 0), ">", 25) & p.any_value(p.after(c["GQ"], 1), "<", 20),
        "predicate_same_sample": p.same_sample(p.by_sample(c["DP"], ">", 20), p.by_sample(c["GQ"], ">", 30)),
        "predicate_any_sample": p.any_value(c["DP"], ">", 20) & p.any_value(c["GQ"], ">", 30),
        "predicate_pass_share": p.passing_share(p.by_sample(c["DP"], ">", 20)) >= 0.5,
        "predicate_sample_subscript": p.any_value(p.of_samples(c["DP"], ["a", "b", "c"], ["b", "c"]), ">", 35),
        "predicate_arithmetic": p.any_value(F.zip_with("DP", "GQ", lambda x, y: (x + y) * 2 - x / 4), ">", 150),
        "predicate_stdev": (p.stdev(c["GQ"]) > 12.3) & (p.total(c["GQ"]) > 100) & (F.abs(F.array_min("GQ") - F.array_max("GQ")) < 40),
        "predicate_text_functions": (F.length("ID") > 7) & (p.phred(F.lit(1) / c["QUAL"]) > 20),
        "predicate_id_list": p.any_text(c["ID"], ["1-URGENT", "5-LOW"]),
        "predicate_smpl_aggregates": p.same_sample(F.transform(p.per_sample(F.arrays_zip("DP", "GQ"), lambda x: F.array_max(F.array(x["DP"], x["GQ"]))), lambda x: x > 45)),
    }


def predicate_genotypes(s: SparkSession, f: str) -> DataFrame:
    """How many samples of each record are of each kind of genotype."""
    return called(s, f).select("p_partkey", *(p.passing_samples(p.genotype_is(k, F.col("gts"))).cast("long").alias(f"n_{k}" if k != "aA" else "n_het_alt") for k in p.GENOTYPES))


def predicate_derived(s: SparkSession, f: str) -> DataFrame:
    g, a = F.col("gts"), F.col("alts")
    r = lambda c: F.round(c, 6)
    return called(s, f).select(
        "p_partkey", p.allele_number(g).alias("an"), p.allele_count(g, a)[0].alias("ac1"), p.allele_count(g, a)[1].alias("ac2"), p.minor_count(g, a)[0].alias("mac1"), r(p.frequency(g, a)[0]).alias("af1"),
        r(p.minor_frequency(g, a)[1]).alias("maf2"), p.missing_samples(g).alias("n_missing"), F.size(g).alias("n_samples"), r(p.missing_samples(g) / F.size(g)).alias("f_missing"), F.size(a).alias("n_alt"), p.length_change(F.col("ref"), a)[0].alias("ilen1"),
    )


def predicate_types(s: SparkSession, f: str) -> DataFrame:
    rows = called(s, f).select(p.kind_of(F.col("ref"), F.col("alts")[0]).alias("kind"), p.any_kind(F.col("ref"), F.col("alts"), "snp").alias("any_snp"))
    return rows.groupBy("kind", "any_snp").agg(F.count("*").alias("n"))


def predicate_binomial(s: SparkSession, f: str) -> DataFrame:
    return called(s, f).select("p_partkey", F.round(p.binomial(F.col("ad")), 6).alias("p"))


#: The filters in SQL.
WHERE = {
    "predicate_compare": "qual > 100 AND (status IN ('O','F') OR qual / 2 < 30)",
    "predicate_any_element": "len(list_filter(ac, lambda x: x >= 45)) > 0",
    "predicate_missing": "len(list_filter(ac, lambda x: x IS NULL OR x <> 10)) > 0 AND list_max(ac) > 40",
    "predicate_regex": "regexp_matches(id, '^[12]-urg', 'i') OR NOT regexp_matches(id, '[A-Z]')",
    "predicate_aggregates": "list_avg(gq) > 30 AND list_median(gq) < 35 AND len(gq) > 2",
    "predicate_subscript": "gq[1] > 25 AND len(list_filter(gq[2:], lambda x: x < 20)) > 0",
    "predicate_same_sample": "len(list_filter(range(1, len(dp) + 1), lambda i: dp[i] > 20 AND gq[i] > 30)) > 0",
    "predicate_any_sample": "list_max(dp) > 20 AND list_max(gq) > 30",
    "predicate_pass_share": "len(list_filter(dp, lambda x: x > 20)) / len(dp) >= 0.5",
    "predicate_sample_subscript": "dp[2] > 35 OR dp[3] > 35",
    "predicate_arithmetic": "len(list_filter(range(1, len(dp) + 1), lambda i: (dp[i] + gq[i]) * 2 - dp[i] / 4 > 150)) > 0",
    "predicate_stdev": "list_stddev_pop(gq) > 12.3e0 AND list_sum(gq) > 100 AND abs(list_min(gq) - list_max(gq)) < 40",
    "predicate_text_functions": "len(id) > 7 AND -10 * log10(1 / qual) > 20",
    "predicate_id_list": "id IN ('1-URGENT', '5-LOW')",
    "predicate_smpl_aggregates": "len(list_filter(range(1, len(dp) + 1), lambda i: greatest(dp[i], gq[i]) > 45)) > 0",
}


def filtered(name: str):
    return lambda s, f: records(s, f).where(tests()[name]).select("o_orderkey")


QUERIES = {name: filtered(name) for name in WHERE}
QUERIES |= {"predicate_genotypes": predicate_genotypes, "predicate_derived": predicate_derived, "predicate_types": predicate_types, "predicate_binomial": predicate_binomial}

# ---- The same in SQL ----
_RECORDS = """x AS (SELECT l_orderkey, list(CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) AS ac,
    list(CAST(l_partkey % 40 AS DOUBLE) ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) AS dp, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) AS gq FROM lineitem GROUP BY 1),
  rec AS (SELECT o_orderkey, CAST(o_totalprice / 1000 AS FLOAT) AS qual, o_orderstatus AS status, o_orderpriority AS id, ac, dp, gq FROM orders JOIN x ON o_orderkey = l_orderkey)"""
_ALLELES = ["(CASE WHEN (p_partkey + {k}) % 7 = 0 THEN [NULL, NULL]::INTEGER[] ELSE [(p_partkey * {a} + p_size) % 3, (p_size * {b} + {k}) % 3]::INTEGER[] END)".format(k=k, a=k + 1, b=k + 2) for k in range(5)]
_ALLELES.append("(CASE WHEN (p_partkey + 5) % 7 = 0 THEN [NULL, NULL]::INTEGER[] ELSE [(p_partkey * 2 + p_size) % 3]::INTEGER[] END)")
_CALLED = f"""r AS (SELECT p_partkey, p_size, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'AG' END AS ref, ['C', 'AT', '*', '<DEL>', 'A]2:9]', 'GT'][p_size % 6 + 1] AS alt1, ['G', 'ACC', '.'][p_size % 3 + 1] AS alt2, [{', '.join(_ALLELES)}] AS gts FROM part)"""
_KINDS = {
    "mis": "x[1] IS NULL", "hap": "len(x) = 1", "hom": "len(x) = 2 AND x[1] = x[2]", "het": "len(x) = 2 AND x[1] <> x[2]", "ref": "x[1] = 0 AND (len(x) = 1 OR x[2] = 0)", "alt": "x[1] IS NOT NULL AND list_max(x) > 0",
    "rr": "len(x) = 2 AND x[1] = 0 AND x[2] = 0", "ra": "len(x) = 2 AND list_min(x) = 0 AND list_max(x) > 0", "het_alt": "len(x) = 2 AND list_min(x) > 0 AND x[1] <> x[2]", "aa": "len(x) = 2 AND list_min(x) > 0 AND x[1] = x[2]",
    "r": "len(x) = 1 AND x[1] = 0", "a": "len(x) = 1 AND x[1] > 0",
}
_KIND1 = "CASE WHEN alt1 = '*' THEN 'overlap' WHEN alt1 = 'A]2:9]' THEN 'bnd' WHEN alt1 = '<DEL>' THEN 'other' WHEN len(alt1) = len(ref) AND len(ref) = 1 THEN 'snp' WHEN len(alt1) = len(ref) THEN 'mnp' ELSE 'indel' END"
_KIND2 = "alt2 <> '.' AND len(alt2) = 1 AND len(ref) = 1"
ORACLE_SQL = {name: f"WITH {_RECORDS} SELECT o_orderkey FROM rec WHERE {sql}" for name, sql in WHERE.items()}
ORACLE_SQL |= {
    "predicate_genotypes": f"WITH {_CALLED} SELECT p_partkey, " + ", ".join(f"len(list_filter(gts, lambda x: coalesce({t}, false))) AS n_{k}" for k, t in _KINDS.items()) + " FROM r",
    "predicate_derived": f"WITH {_CALLED}, e AS (SELECT *, list_filter(flatten(gts), lambda x: x IS NOT NULL) AS every FROM r), c AS (SELECT *, len(every) AS an, len(list_filter(every, lambda x: x = 1)) AS c1, len(list_filter(every, lambda x: x = 2)) AS c2, len(list_filter(gts, lambda x: x[1] IS NULL)) AS m FROM e) SELECT p_partkey, CAST(an AS INTEGER) AS an, CAST(c1 AS INTEGER) AS ac1, CAST(c2 AS INTEGER) AS ac2, CAST(least(c1, an - c1) AS INTEGER) AS mac1, round(c1 / an, 6) AS af1, round(least(c2 / an, 1 - c2 / an), 6) AS maf2, CAST(m AS INTEGER) AS n_missing, 6 AS n_samples, round(m / 6, 6) AS f_missing, 2 AS n_alt, CAST(CASE WHEN len(alt1) <> len(ref) THEN len(alt1) - len(ref) END AS INTEGER) AS ilen1 FROM c",
    "predicate_types": f"WITH {_CALLED} SELECT {_KIND1} AS kind, {_KIND1} = 'snp' OR ({_KIND2}) AS any_snp, count(*) AS n FROM r GROUP BY 1, 2",
    "predicate_binomial": "WITH d AS (SELECT p_partkey, p_partkey % 30 AS a, p_size % 25 AS b FROM part), t AS (SELECT *, list_transform(range(0, least(a, b) + 1), lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2e0))) AS x FROM d) SELECT p_partkey, round(CASE WHEN a = b THEN 1e0 ELSE least(1e0, 2 * list_sum(x)) END, 6) AS p FROM t",
}
