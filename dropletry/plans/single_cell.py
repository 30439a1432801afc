"""Queries from reads to calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.operators import clusters, demux, genotypes, likelihood, packed, pileup, reads
from dropletry.operators.ranking import saved
from dropletry.plans.adapters import CALLS, DONORS, OBS, ORDER, SNPS, UNIQUE, donor_calls, donor_posteriors, observations, table, variants

ALPHAS = [0.0, 0.5]
CLUSTERS = 3


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def unique(s: SparkSession, f: str) -> DataFrame:
    return pileup.dedup_umis(observations(s, f), ORDER)


def likelihoods(s: SparkSession, f: str) -> DataFrame:
    return likelihood.genotype_pairs(unique(s, f))


def read_filter_flags(s: SparkSession, f: str) -> DataFrame:
    rows = table(s, f, "lineitem").select("l_linestatus", F.col("l_quantity").cast("int").alias("mapq"), (F.col("l_orderkey") % 4096).cast("int").alias("flag"))
    return reads.passing(rows).groupBy("l_linestatus").agg(F.count("*").alias("n"), F.sum("flag").cast("long").alias("flags"))


def base_quality_filter_cap(s: SparkSession, f: str) -> DataFrame:
    rows = table(s, f, "lineitem").select("l_returnflag", F.col("l_quantity").cast("int").alias("bq"), (F.col("l_partkey") % 100).alias("rpos"), F.lit(100).alias("read_len"))
    kept = reads.usable_bases(rows, min_tail=5).withColumn("allele", reads.allele_code(F.col("l_returnflag"), F.lit("R"), F.lit("A")))
    return kept.groupBy("allele", "bq").agg(F.count("*").alias("n"), F.sum("rpos").cast("long").alias("places"))


def whitelist_semi_join(s: SparkSession, f: str) -> DataFrame:
    listed = table(s, f, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("barcode"))
    rows = table(s, f, "lineitem").select(F.col("l_suppkey").alias("barcode"), "l_quantity")
    return reads.whitelisted(rows, listed).groupBy("barcode").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("bases"))


def missing_tag_policy(s: SparkSession, f: str) -> DataFrame:
    tags = F.when(F.col("user_id") % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("CB"), F.col("event_type")))
    rows = reads.tagged(table(s, f, "events").select(tags.alias("tags"), "value"), "CB", "barcode")
    return rows.groupBy("barcode").agg(F.count("*").alias("n"))


def read_class_counts(s: SparkSession, f: str) -> DataFrame:
    low, other = F.col("bq") < 13, F.col("allele") == 2
    one = observations(s, f).groupBy("l_orderkey").agg(F.count_if(~low & ~other).alias("a"), F.count_if(~low & other).alias("b"), F.count_if(low & ~other).alias("c"), F.count_if(low & other).alias("d"))
    return one.groupBy(reads.read_class(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("class")).agg(F.count("*").alias("n"))


def cell_counters(s: SparkSession, f: str) -> DataFrame:
    return pileup.passing_cells(pileup.cell_counters(unique(s, f)), min_umi=2, min_snp=5)


def first_seen_ids(s: SparkSession, f: str) -> DataFrame:
    return pileup.first_seen(observations(s, f), "cell_id", ORDER)


def written_and_read(s: SparkSession, f: str) -> DataFrame:
    back = pileup.parse_pileup_strings(pileup.pileup_strings(unique(s, f)))
    return back.groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("bq").cast("long").alias("bq"), F.sum("allele").cast("long").alias("alleles"))


def allele_freq(s: SparkSession, f: str) -> DataFrame:
    return r6(genotypes.allele_counts(donor_calls(s, f)), "af", "af_pseudo", "callrate")


def variant_filter(s: SparkSession, f: str) -> DataFrame:
    return genotypes.passing_variants(genotypes.allele_counts(donor_calls(s, f)), 2, 0.9).select("snp_id", "ac", "an", "mac")


def gt_to_posterior(s: SparkSession, f: str) -> DataFrame:
    rows = donor_calls(s, f)
    return r6(rows.select("snp_id", "donor", *(c.alias(f"gp{g}") for g, c in enumerate(genotypes.call_posterior(F.col("gt"), F.col("af"), 0.01)))), "gp0", "gp1", "gp2")


def geno_error_mix(s: SparkSession, f: str) -> DataFrame:
    gp = genotypes.call_posterior(F.col("gt"), F.col("af"), 0.01)
    rows = donor_calls(s, f).select("snp_id", "donor", "r2", *(c.alias(f"gp{g}") for g, c in enumerate(gp)))
    mean = rows.groupBy("snp_id").agg(*(F.avg(f"gp{g}").alias(f"m{g}") for g in range(3)))
    mixed = genotypes.mixed_with_mean([F.col(f"gp{g}") for g in range(3)], [F.col(f"m{g}") for g in range(3)], F.col("r2"), 0.1, 0.2)
    # A row for each variant is no small table, whatever Spark guesses.
    return r6(rows.join(mean.hint("merge"), "snp_id").select("snp_id", "donor", *(c.alias(f"x{g}") for g, c in enumerate(mixed))), "x0", "x1", "x2")


def gp_normalize(s: SparkSession, f: str) -> DataFrame:
    rows = table(s, f, "part").select(F.col("p_partkey").alias("snp_id"), *((F.col("p_size") * w % 7 / F.lit(7.0)).alias(f"w{g}") for g, w in enumerate((1, 3, 5))))
    out = genotypes.normalized([F.col(f"w{g}") for g in range(3)], 0.001)
    return r6(rows.select("snp_id", *(c.alias(f"gp{g}") for g, c in enumerate(out))), "gp0", "gp1", "gp2")


def pl_em_af(s: SparkSession, f: str) -> DataFrame:
    rows = donor_calls(s, f)
    lik = [F.when(F.col("gt").isNull(), F.lit(1.0)).when(F.col("gt") == g, F.lit(0.98)).otherwise(F.lit(0.01)).alias(f"l{g}") for g in range(3)]
    return r6(genotypes.frequency_by_em(rows.select("snp_id", *lik), 10), "af")


def gl9_pileup(s: SparkSession, f: str) -> DataFrame:
    return r6(likelihoods(s, f), *(f"g{k}" for k in range(9)))


def singlet_score(s: SparkSession, f: str) -> DataFrame:
    return r6(likelihood.singlet_scores(likelihoods(s, f), variants(s, f)), "sng_llk", "dbl_llk", "score")


def singlet_rank(s: SparkSession, f: str) -> DataFrame:
    return likelihood.ranked(singlet_score(s, f)).select("cell_id", "score", "rank")


def seeded(s: SparkSession, f: str) -> DataFrame:
    return table(s, f, "supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_suppkey") % CLUSTERS).cast("int").alias("cluster"))


def cluster_merge_gl(s: SparkSession, f: str) -> DataFrame:
    return r6(clusters.merged(likelihoods(s, f), seeded(s, f)), "c0", "c1", "c2")


def cell_cluster_distance(s: SparkSession, f: str) -> DataFrame:
    gl = likelihoods(s, f)
    return r6(likelihood.distances(gl, clusters.merged(gl, seeded(s, f)), variants(s, f)), "llk0", "llk2")


def cluster_vcf_fields(s: SparkSession, f: str) -> DataFrame:
    return clusters.genotype_fields(clusters.merged(likelihoods(s, f), seeded(s, f)), variants(s, f)).select("cluster", "snp_id", "n_cell", "gt")


def em_llk(s: SparkSession, f: str) -> DataFrame:
    gl = likelihoods(s, f)
    post = clusters.cluster_posteriors(clusters.merged(gl, seeded(s, f)), variants(s, f), CLUSTERS)
    return clusters.pair_likelihoods(gl, post, CLUSTERS)


def em_one_step(s: SparkSession, f: str) -> DataFrame:
    return r6(em_llk(s, f), "llk")


def em_calls(s: SparkSession, f: str) -> DataFrame:
    return r6(demux.calls(demux.best_and_next(em_llk(s, f))), "best_llk", "next_llk")


def droplets(s: SparkSession, f: str) -> DataFrame:
    """Packed droplets with their singlet scores; reads are dealt by droplet once, and nothing is shuffled after."""
    dealt = observations(s, f).repartition("cell_id")
    return packed.of_likelihoods(likelihood.genotype_pairs(pileup.dedup_umis(dealt, ORDER)), variants(s, f))


def greedy(cells: DataFrame) -> DataFrame:
    return clusters.greedy_packed(cells, likelihood.ranked(cells.select("cell_id", "score")).select("cell_id", "rank"), CLUSTERS)


def greedy_clusters(s: SparkSession, f: str) -> DataFrame:
    return greedy(droplets(s, f))


def em_full(s: SparkSession, f: str) -> DataFrame:
    cells = droplets(s, f)
    return r6(clusters.em_packed(cells, greedy(cells), CLUSTERS), "best_llk", "next_llk")


def vote_clusters(s: SparkSession, f: str) -> DataFrame:
    rows = observations(s, f).select("cell_id", (F.col("snp_id") % 4).cast("int").alias("cluster"), F.when(F.col("allele") == 0, 1).otherwise(-1).alias("vote"))
    return clusters.votes(rows)


def pairs(s: SparkSession, f: str) -> DataFrame:
    return likelihood.donor_pairs(likelihood.mixtures(unique(s, f), ALPHAS), donor_posteriors(s, f), DONORS, ALPHAS)


def demux_pair_llk(s: SparkSession, f: str) -> DataFrame:
    return r6(pairs(s, f), "llk")


def demux_best_next(s: SparkSession, f: str) -> DataFrame:
    return r6(demux.best_and_next(pairs(s, f)), "sng_best_llk", "sng_next_llk", "dbl_best_llk", "dbl_next_llk")


def demux_posterior(s: SparkSession, f: str) -> DataFrame:
    return r6(demux.posteriors(pairs(s, f), DONORS), "sng_posterior", "sng_only_posterior", "log_total")


def demux_call(s: SparkSession, f: str) -> DataFrame:
    return r6(demux.calls(demux.best_and_next(pairs(s, f))), "best_llk", "next_llk")


QUERIES = {
    "read_filter_flags": read_filter_flags, "base_quality_filter_cap": base_quality_filter_cap, "whitelist_semi_join": whitelist_semi_join,
    "missing_tag_policy": missing_tag_policy, "read_class_counts": read_class_counts, "umi_dedup": unique, "cell_counters": cell_counters,
    "first_seen_ids": first_seen_ids, "pileup_strings": lambda s, f: pileup.pileup_strings(unique(s, f)), "pileup_round_trip": written_and_read,
    "allele_freq": allele_freq, "variant_filter_mac_callrate": variant_filter, "gt_to_posterior": gt_to_posterior, "geno_error_mix": geno_error_mix,
    "gp_normalize": gp_normalize, "pl_em_af": pl_em_af, "gl9_pileup": gl9_pileup, "singlet_score": singlet_score, "singlet_rank": singlet_rank,
    "cluster_merge_gl": cluster_merge_gl, "cell_cluster_distance": cell_cluster_distance, "cluster_vcf_fields": cluster_vcf_fields, "em_one_step": em_one_step,
    "em_calls": em_calls, "greedy_clusters": greedy_clusters, "em_full": em_full, "vote_clusters": vote_clusters, "demux_pair_llk": demux_pair_llk,
    "demux_best_next": demux_best_next, "demux_posterior": demux_posterior, "demux_call": demux_call,
}

# ---- The same in SQL ----
_E = "CASE WHEN bq > 1 THEN pow(0.1e0, bq * 0.1e0) ELSE 0.75e0 END"
_STATES = [(a, b) for a in range(3) for b in range(3)]
_P = ["(1-af)*(1-af)", "2*af*(1-af)", "af*af"]


def _plus(terms: list[str]) -> str:
    return " + ".join(terms)


def _gl(names: str = UNIQUE) -> str:
    s = ", ".join(f"coalesce(sum(CASE WHEN allele <= 1 THEN ln((1-e) * (CASE WHEN allele = 0 THEN {1 - (a + b) / 4}e0 ELSE {(a + b) / 4}e0 END) + e/4) END), 0e0) AS s{k}" for k, (a, b) in enumerate(_STATES))
    top = "greatest(" + ", ".join(f"s{k}" for k in range(9)) + ")"
    e = ", ".join(f"exp(s{k} - {top}) AS e{k}" for k in range(9))
    h = ", ".join(f"greatest(e{k} / ({_plus([f'e{i}' for i in range(9)])}), 1e-6) AS h{k}" for k in range(9))
    g = ", ".join(f"h{k} / ({_plus([f'h{i}' for i in range(9)])}) AS g{k}" for k in range(9))
    return f"""{names}, gs AS (SELECT cell_id, snp_id, count(*) AS n_obs, {s} FROM (SELECT *, {_E} AS e FROM uniq) GROUP BY 1, 2),
      ge AS (SELECT cell_id, snp_id, n_obs, {e} FROM gs), gh AS (SELECT cell_id, snp_id, n_obs, {h} FROM ge), gl AS (SELECT cell_id, snp_id, n_obs, {g} FROM gh)"""


_ONE = _plus([f"g{4 * g} * {_P[g]}" for g in range(3)])
_TWO = _plus([f"g{k} * {_P[a]} * {_P[b]}" for k, (a, b) in enumerate(_STATES)])
_SCORES = f"""{_gl()}, {SNPS}, scores AS (SELECT cell_id, count(*) AS n_snp, CAST(sum(n_obs) AS BIGINT) AS n_obs, sum(ln({_ONE})) AS sng, sum(ln({_TWO})) AS dbl
  FROM gl JOIN snps USING (snp_id) GROUP BY 1)"""
_SCORE_ROWS = "SELECT cell_id, n_snp, n_obs, round(sng, 6) AS sng_llk, round(dbl, 6) AS dbl_llk, round(sng - dbl, 6) AS score FROM scores"
_MERGED = f"""{_gl()}, {SNPS}, ms AS (SELECT s_suppkey % 3 AS cluster, snp_id, count(*) AS n_cell, sum(ln(g0)) AS s0, sum(ln(g4)) AS s1, sum(ln(g8)) AS s2
    FROM gl JOIN supplier ON cell_id = s_suppkey GROUP BY 1, 2),
  me AS (SELECT cluster, snp_id, n_cell, exp(s0 - greatest(s0, s1, s2)) AS e0, exp(s1 - greatest(s0, s1, s2)) AS e1, exp(s2 - greatest(s0, s1, s2)) AS e2 FROM ms),
  mh AS (SELECT cluster, snp_id, n_cell, greatest(e0 / (e0+e1+e2), 1e-6) AS h0, greatest(e1 / (e0+e1+e2), 1e-6) AS h1, greatest(e2 / (e0+e1+e2), 1e-6) AS h2 FROM me),
  merged AS (SELECT CAST(cluster AS INTEGER) AS cluster, snp_id, n_cell, h0/(h0+h1+h2) AS c0, h1/(h0+h1+h2) AS c1, h2/(h0+h1+h2) AS c2 FROM mh)"""
_SAME = _plus([f"g{4 * g} * c{g} * {_P[g]}" for g in range(3)])
_APART = _plus([f"g{4 * a} * c{b} * {_P[a]} * {_P[b]}" for a in range(3) for b in range(3)])


def _em() -> str:
    wide = ", ".join(f"max(CASE WHEN cluster = {j} THEN c{g} END) AS c{j}_{g}" for j in range(CLUSTERS) for g in range(3))
    raw = ", ".join(f"coalesce(c{j}_{g}, 1e0) * {_P[g]} AS r{j}_{g}" for j in range(CLUSTERS) for g in range(3))
    q = ", ".join(f"0.9e0 * r{j}_{g} / (r{j}_0 + r{j}_1 + r{j}_2) + 0.1e0 * {_P[g]} AS q{j}_{g}" for j in range(CLUSTERS) for g in range(3))
    rows = []
    for a in range(CLUSTERS):
        for b in range(a + 1):
            terms = [f"g{4 * g} * q{a}_{g}" for g in range(3)] if a == b else [f"g{3 * x + y} * q{a}_{x} * q{b}_{y}" for x in range(3) for y in range(3)]
            rows.append(f"SELECT cell_id, {a} AS j, {b} AS k, {int(a != b)} AS n, sum(ln({_plus(terms)})) AS llk FROM gl JOIN qs USING (snp_id) GROUP BY cell_id")
    return f"""{_MERGED}, wide AS (SELECT snp_id, {wide} FROM merged GROUP BY 1), raws AS (SELECT snp_id, af, {raw} FROM snps LEFT JOIN wide USING (snp_id)),
      qs AS (SELECT snp_id, {q} FROM raws), llks AS ({' UNION ALL '.join(rows)})"""


def _demux() -> str:
    sums, mixed = [], []
    for n, alpha in enumerate(ALPHAS):
        for a, b in _STATES:
            p = 0.5 * a + (b - a) * 0.5 * alpha
            sums.append(f"sum(ln(r * {1 - p}e0 + x * {p}e0)) AS s{n}_{a}{b}")
    names = [x.split(" AS ")[1] for x in sums]
    top = f"greatest({', '.join(names)})"
    mixed = ", ".join(f"(exp({x} - {top}) + 1e-10) / (1 + 1e-10) AS {x.replace('s', 'm')}" for x in names)
    gp = ", ".join(f"max(CASE WHEN donor = {d} THEN (CASE WHEN gt IS NULL THEN {_P[g]} WHEN gt = {g} THEN 0.99e0 ELSE 0.005e0 END) END) AS p{d}_{g}" for d in range(DONORS) for g in range(3))
    rows = []
    for n in range(2):
        for j in range(DONORS):
            for k in range(DONORS):
                if (j == k) == (n == 0):
                    rows.append(f"SELECT cell_id, {j} AS j, {k} AS k, {n} AS n, sum(ln({_plus([f'p{j}_{a} * p{k}_{b} * m{n}_{a}{b}' for a, b in _STATES])})) AS llk FROM mix JOIN gps USING (snp_id) GROUP BY cell_id")
    return f"""{UNIQUE}, {CALLS}, es AS (SELECT *, {_E} AS e FROM uniq WHERE allele <= 1),
      bs AS (SELECT cell_id, snp_id, CASE WHEN allele = 0 THEN 1 - e ELSE e / 3 END AS r, CASE WHEN allele = 1 THEN 1 - e ELSE e / 3 END AS x FROM es),
      ss AS (SELECT cell_id, snp_id, {', '.join(sums)} FROM bs GROUP BY 1, 2), mix AS MATERIALIZED (SELECT cell_id, snp_id, {mixed} FROM ss),
      gps AS MATERIALIZED (SELECT snp_id, {gp} FROM calls GROUP BY 1), llks AS MATERIALIZED ({' UNION ALL '.join(rows)})"""


_BEST = """, tops AS (SELECT *, row_number() OVER (PARTITION BY cell_id, n = 0 ORDER BY llk DESC, j, k, n) AS r FROM llks WHERE n = 0 OR j > k),
  best AS (SELECT cell_id, max(CASE WHEN n = 0 AND r = 1 THEN j END) AS sng_best, max(CASE WHEN n = 0 AND r = 1 THEN llk END) AS sng_best_llk,
    max(CASE WHEN n = 0 AND r = 2 THEN j END) AS sng_next, max(CASE WHEN n = 0 AND r = 2 THEN llk END) AS sng_next_llk,
    max(CASE WHEN n > 0 AND r = 1 THEN j END) AS dbl_best, max(CASE WHEN n > 0 AND r = 1 THEN k END) AS dbl_best2, max(CASE WHEN n > 0 AND r = 1 THEN llk END) AS dbl_best_llk,
    max(CASE WHEN n > 0 AND r = 2 THEN j END) AS dbl_next, max(CASE WHEN n > 0 AND r = 2 THEN k END) AS dbl_next2, max(CASE WHEN n > 0 AND r = 2 THEN llk END) AS dbl_next_llk
    FROM tops WHERE r <= 2 GROUP BY 1)"""
_CALLS = """, typed AS (SELECT *, CASE WHEN dbl_best_llk > sng_best_llk + 2 THEN 'DBL' WHEN sng_best_llk > sng_next_llk + 2 THEN 'SNG' ELSE 'AMB' END AS type FROM best),
  rival AS (SELECT *, CASE WHEN type = 'DBL' THEN dbl_next_llk > sng_best_llk + 2 ELSE dbl_best_llk > sng_next_llk + 2 END AS pair FROM typed)
  SELECT cell_id, type, CASE WHEN type = 'DBL' THEN dbl_best || ',' || dbl_best2 ELSE sng_best || ',' || sng_best END AS best_guess,
    round(CASE WHEN type = 'DBL' THEN dbl_best_llk ELSE sng_best_llk END, 6) AS best_llk,
    CASE WHEN type = 'DBL' THEN (CASE WHEN pair THEN dbl_next || ',' || dbl_next2 ELSE sng_best || ',' || sng_best END)
         ELSE (CASE WHEN pair THEN dbl_best || ',' || dbl_best2 ELSE sng_next || ',' || sng_next END) END AS next_guess,
    round(CASE WHEN type = 'DBL' THEN (CASE WHEN pair THEN dbl_next_llk ELSE sng_best_llk END) ELSE (CASE WHEN pair THEN dbl_best_llk ELSE sng_next_llk END) END, 6) AS next_llk FROM rival"""


def _pl_em() -> str:
    rounds = ["lik AS (SELECT snp_id, " + ", ".join(f"CASE WHEN gt IS NULL THEN 1e0 WHEN gt = {g} THEN 0.98e0 ELSE 0.01e0 END AS l{g}" for g in range(3)) + " FROM calls)", "em0 AS (SELECT DISTINCT snp_id, 0.5e0 AS af FROM lik)"]
    w = [f"l{g} * {_P[g]}" for g in range(3)]
    for k in range(10):
        rounds.append(f"em{k + 1} AS MATERIALIZED (SELECT snp_id, sum(({w[1]} + 2 * ({w[2]})) / ({_plus(w)})) / (2 * count(*)) AS af FROM lik JOIN em{k} USING (snp_id) GROUP BY 1)")
    return f"WITH {CALLS}, {', '.join(rounds)} SELECT snp_id, round(af, 6) AS af FROM em10"


_SINGLE, _PAIR = demux.log_priors(DONORS, 2, 0.5)
ORACLE_SQL = {
    "read_filter_flags": "SELECT l_linestatus, count(*) AS n, CAST(sum(flag) AS BIGINT) AS flags FROM (SELECT l_linestatus, CAST(l_quantity AS INTEGER) AS mapq, CAST(l_orderkey % 4096 AS INTEGER) AS flag FROM lineitem) WHERE mapq >= 20 AND (flag & 3844) = 0 AND (flag & 1796) = 0 GROUP BY 1",
    "base_quality_filter_cap": "SELECT CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS allele, least(CAST(l_quantity AS INTEGER), 40) AS bq, count(*) AS n, CAST(sum(l_partkey % 100) AS BIGINT) AS places FROM lineitem WHERE CAST(l_quantity AS INTEGER) >= 13 AND l_partkey % 100 >= 4 AND l_partkey % 100 + 5 <= 100 GROUP BY 1, 2",
    "whitelist_semi_join": "SELECT l_suppkey AS barcode, count(*) AS n, sum(l_quantity) AS bases FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1",
    "missing_tag_policy": "SELECT CASE WHEN user_id % 3 = 0 THEN '.' ELSE event_type END AS barcode, count(*) AS n FROM events GROUP BY 1",
    "read_class_counts": f"WITH {OBS}, one AS (SELECT l_orderkey, count(*) FILTER (bq >= 13 AND allele < 2) AS a, count(*) FILTER (bq >= 13 AND allele = 2) AS b, count(*) FILTER (bq < 13 AND allele < 2) AS c, count(*) FILTER (bq < 13 AND allele = 2) AS d FROM obs GROUP BY 1) SELECT CASE WHEN a > 1 THEN 'MULTI' WHEN a = 1 THEN 'PASS' WHEN b > 0 THEN 'REDUNDANT' WHEN c > 0 THEN 'LOWQUAL' WHEN d > 0 THEN 'N' ELSE 'NONE' END AS class, count(*) AS n FROM one GROUP BY 1",
    "umi_dedup": f"WITH {UNIQUE} SELECT * FROM uniq",
    "cell_counters": f"WITH {UNIQUE} SELECT cell_id, CAST(sum(n_dup) AS BIGINT) AS n_read, count(*) AS n_umi_w_snp, count(DISTINCT umi) AS n_umi, count(DISTINCT snp_id) AS n_snp FROM uniq GROUP BY 1 HAVING count(DISTINCT umi) >= 2 AND count(DISTINCT snp_id) >= 5",
    "first_seen_ids": f"WITH {OBS}, seen AS (SELECT cell_id, min((l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS f FROM obs GROUP BY 1) SELECT cell_id, row_number() OVER (ORDER BY f, cell_id) - 1 AS id FROM seen",
    "pileup_strings": f"WITH {UNIQUE} SELECT cell_id, snp_id, string_agg(CAST(allele AS VARCHAR), '' ORDER BY umi) AS alleles, string_agg(chr(bq + 33), '' ORDER BY umi) AS baseqs FROM uniq GROUP BY 1, 2",
    "pileup_round_trip": f"WITH {UNIQUE} SELECT cell_id, count(*) AS n, CAST(sum(least(bq, 40)) AS BIGINT) AS bq, CAST(sum(allele) AS BIGINT) AS alleles FROM uniq WHERE bq >= 13 GROUP BY 1",
    "allele_freq": f"WITH {CALLS}, c AS (SELECT snp_id, count(*) AS n_sample, 2 * count(gt) AS an, CAST(coalesce(sum(gt), 0) AS BIGINT) AS ac FROM calls GROUP BY 1) SELECT snp_id, n_sample, an, ac, round(CASE WHEN an > 0 THEN ac / an END, 6) AS af, round((ac + 0.5e0) / (an + 1), 6) AS af_pseudo, round(an / (2 * n_sample), 6) AS callrate FROM c",
    "variant_filter_mac_callrate": f"WITH {CALLS}, c AS (SELECT snp_id, count(*) AS n_sample, 2 * count(gt) AS an, CAST(coalesce(sum(gt), 0) AS BIGINT) AS ac FROM calls GROUP BY 1) SELECT snp_id, ac, an, least(ac, an - ac) AS mac FROM c WHERE least(ac, an - ac) >= 2 AND an / (2 * n_sample) >= 0.9e0",
    "gt_to_posterior": f"WITH {CALLS} SELECT snp_id, donor, " + ", ".join(f"round(CASE WHEN gt IS NULL THEN {_P[g]} WHEN gt = {g} THEN 0.99e0 ELSE 0.005e0 END, 6) AS gp{g}" for g in range(3)) + " FROM calls",
    "geno_error_mix": f"WITH {CALLS}, gp AS (SELECT snp_id, donor, least(greatest(0.1e0 + 0.9e0 * (1 - r2) * 0.2e0, 0e0), 0.999e0) AS err, " + ", ".join(f"CASE WHEN gt IS NULL THEN {_P[g]} WHEN gt = {g} THEN 0.99e0 ELSE 0.005e0 END AS gp{g}" for g in range(3)) + " FROM calls) SELECT snp_id, donor, " + ", ".join(f"round((1 - err) * gp{g} + err * avg(gp{g}) OVER (PARTITION BY snp_id), 6) AS x{g}" for g in range(3)) + " FROM gp",
    "gp_normalize": "WITH w AS (SELECT p_partkey AS snp_id, p_size % 7 / 7e0 AS w0, p_size * 3 % 7 / 7e0 AS w1, p_size * 5 % 7 / 7e0 AS w2 FROM part) SELECT snp_id, " + ", ".join(f"round((w{g} + 0.001e0) / (w0 + w1 + w2 + 0.003e0), 6) AS gp{g}" for g in range(3)) + " FROM w",
    "pl_em_af": _pl_em(),
    "gl9_pileup": f"WITH {_gl()} SELECT cell_id, snp_id, n_obs, " + ", ".join(f"round(g{k}, 6) AS g{k}" for k in range(9)) + " FROM gl",
    "singlet_score": f"WITH {_SCORES} {_SCORE_ROWS}",
    "singlet_rank": f"WITH {_SCORES}, rows AS ({_SCORE_ROWS}) SELECT cell_id, score, CAST(row_number() OVER (ORDER BY score DESC, cell_id DESC) AS INTEGER) AS rank FROM rows",
    "cluster_merge_gl": f"WITH {_MERGED} SELECT cluster, snp_id, n_cell, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2 FROM merged",
    "cell_cluster_distance": f"WITH {_MERGED} SELECT cell_id, cluster, count(*) AS n_snp, round(sum(ln({_APART})), 6) AS llk0, round(sum(ln({_SAME})), 6) AS llk2 FROM gl JOIN merged USING (snp_id) JOIN snps USING (snp_id) GROUP BY 1, 2",
    "cluster_vcf_fields": f"WITH {_MERGED}, p AS (SELECT cluster, snp_id, n_cell, c0 * {_P[0]} AS p0, c1 * {_P[1]} AS p1, c2 * {_P[2]} AS p2 FROM merged JOIN snps USING (snp_id)) SELECT cluster, snp_id, n_cell, CASE WHEN p0 / (p0+p1+p2) = greatest(p0 / (p0+p1+p2), p1 / (p0+p1+p2), p2 / (p0+p1+p2)) THEN '0/0' WHEN p1 / (p0+p1+p2) = greatest(p0 / (p0+p1+p2), p1 / (p0+p1+p2), p2 / (p0+p1+p2)) THEN '0/1' ELSE '1/1' END AS gt FROM p",
    "em_one_step": f"WITH {_em()} SELECT cell_id, j, k, n, round(llk, 6) AS llk FROM llks",
    "em_calls": f"WITH {_em()} {_BEST} {_CALLS}",
    "vote_clusters": f"WITH {OBS}, v AS (SELECT cell_id, CAST(snp_id % 4 AS INTEGER) AS cluster, CAST(sum(CASE WHEN allele = 0 THEN 1 ELSE -1 END) AS BIGINT) AS votes FROM obs GROUP BY 1, 2) SELECT cell_id, cluster, votes FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY votes DESC, cluster) AS r FROM v) WHERE r = 1",
    "demux_pair_llk": f"WITH {_demux()} SELECT cell_id, j, k, n, round(llk, 6) AS llk FROM llks",
    "demux_best_next": f"WITH {_demux()} {_BEST} SELECT cell_id, sng_best, round(sng_best_llk, 6) AS sng_best_llk, sng_next, round(sng_next_llk, 6) AS sng_next_llk, dbl_best, dbl_best2, round(dbl_best_llk, 6) AS dbl_best_llk, dbl_next, dbl_next2, round(dbl_next_llk, 6) AS dbl_next_llk FROM best",
    "demux_posterior": f"WITH {_demux()}, x AS (SELECT cell_id, n, llk + CASE WHEN n = 0 THEN {_SINGLE!r}e0 ELSE {_PAIR!r}e0 END AS x FROM llks WHERE n = 0 OR j > k), t AS (SELECT cell_id, max(x) AS top, max(CASE WHEN n = 0 THEN x END) AS best FROM x GROUP BY 1), u AS (SELECT cell_id, sum(exp(x - top)) AS alls, sum(CASE WHEN n = 0 THEN exp(x - top) END) AS singles, max(top) AS top, max(best) AS best FROM x JOIN t USING (cell_id) GROUP BY 1) SELECT cell_id, round(singles / alls, 6) AS sng_posterior, round(exp(best - top) / singles, 6) AS sng_only_posterior, round(top + ln(alls), 6) AS log_total FROM u",
    "demux_call": f"WITH {_demux()} {_BEST} {_CALLS}",
}
