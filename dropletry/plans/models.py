"""Queries of whole models: donor panels, mixtures, communities; and the SQL of those that SQL can express."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.operators import alleles, communities, demultiplex, demux, likelihood, mixture, multiallelic, panel, pileup
from dropletry.operators.genotypes import call_posterior
from dropletry.plans import single_cell as sc
from dropletry.plans.adapters import DONORS, CALLS, ORDER, UNIQUE, donor_calls, observations, table, variants
from dropletry.sources import alignments
from dropletry.sources import variants as vcf

#: Donors of the panel, and droplets' components.
PANEL, COMPONENTS = 40, 3
ROUNDS, DOUBLETS, ALPHA = 3, 0.1, 0.05


def panel_posteriors(s: SparkSession, f: str) -> DataFrame:
    """snp_id and the 3 genotype probabilities of every donor of the panel, one after another."""
    gt = lambda d: F.when((F.col("snp_id") + d) % 11 != 0, (F.col("snp_id") * (d + 3)) % 97 % 3)
    rows = variants(s, f).repartition(s.sparkContext.defaultParallelism)
    return rows.select("snp_id", F.array(*(p for d in range(PANEL) for p in call_posterior(gt(d), F.col("af"), 0.01))).alias("p"))


def demux_panel(s: SparkSession, f: str) -> DataFrame:
    # Reads are dealt by droplet once, and nothing is shuffled up to the packed droplets.
    unique = pileup.dedup_umis(observations(s, f).repartition("cell_id"), ORDER)
    best = panel.panel_best(likelihood.mixtures(unique, sc.ALPHAS), panel_posteriors(s, f), PANEL, sc.ALPHAS)
    best = sc.saved(best)
    rows = demux.calls(best).join(best.select("cell_id", "sng_posterior", "log_total"), "cell_id")
    return sc.r6(rows, "best_llk", "next_llk", "sng_posterior", "log_total")


def gene_counts(s: SparkSession, f: str) -> DataFrame:
    return table(s, f, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), (F.col("l_partkey") % 40).alias("gene")).agg(F.count("*").alias("n"))


def mixture_em(s: SparkSession, f: str) -> DataFrame:
    """The components' shares of every droplet after some rounds of EM with pairs."""
    both = len(mixture.pairs_of(COMPONENTS))
    w = F.array(*(F.when(F.col("s_suppkey") % (COMPONENTS + both) == j, 0.5).otherwise(0.5 / (COMPONENTS + both - 1)) for j in range(COMPONENTS + both)))
    start = table(s, f, "supplier").select(F.col("s_suppkey").alias("cell_id"), w.alias("w"))
    _, rows = mixture.em(mixture.packed(gene_counts(s, f), COMPONENTS), COMPONENTS, start, doublet=DOUBLETS, alpha=ALPHA, rounds=ROUNDS, tolerance=float("-inf"))
    return rows.select("cell_id", *(F.round(F.col("w")[j], 6).alias(f"w{j}") for j in range(COMPONENTS + both)))


def mixture_gibbs(s: SparkSession, f: str) -> DataFrame:
    return mixture.gibbs(mixture.packed(gene_counts(s, f), COMPONENTS), COMPONENTS, sweeps=6, burn_in=2, blocks=2)


def louvain_full(s: SparkSession, f: str) -> DataFrame:
    """Communities of nations that trade with each other."""
    line, order = table(s, f, "lineitem"), table(s, f, "orders")
    rows = line.join(order, line.l_orderkey == order.o_orderkey).join(table(s, f, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, f, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = rows.groupBy(F.least("c_nationkey", "s_nationkey").alias("src"), F.greatest("c_nationkey", "s_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("w"))
    return communities.louvain(edges, rounds=2)[0]


def files_to_calls(s: SparkSession, f: str) -> DataFrame:
    """Calls from lines of reads and of genotypes: five bases a read, the third one on a variant."""
    tab = lambda *parts: F.concat_ws("\t", *(p if isinstance(p, Column) else F.lit(p) for p in parts)).alias("value")
    base = F.when(F.col("l_returnflag") == "R", "A").when(F.col("l_returnflag") == "A", "G").otherwise("T")
    pos = (F.col("l_partkey") * 10 + 98).cast("string")
    name = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    tags = [F.concat(F.lit("CB:Z:B"), F.col("l_suppkey").cast("string")), F.concat(F.lit("UB:Z:"), (F.col("l_orderkey") % 4).cast("string"))]
    sam = table(s, f, "lineitem").select(tab(name, "0", "1", pos, "60", "5M", "*", "0", "0", F.concat(F.lit("CC"), base, F.lit("CC")), F.repeat(F.chr(F.col("l_quantity").cast("int") + 33), F.lit(5)), *tags))
    gt = F.when(F.col("gt") == 0, "0/0").when(F.col("gt") == 1, "0/1").when(F.col("gt") == 2, "1/1").otherwise("./.")
    rows = donor_calls(s, f).groupBy("snp_id").agg(F.array_sort(F.collect_list(F.struct("donor", gt.alias("gt")))).alias("x"))
    lines = rows.select(tab("1", (F.col("snp_id") * 10 + 100).cast("string"), ".", "A", "G", ".", "PASS", ".", "GT", F.array_join(F.transform("x", lambda x: x["gt"]), "\t")))
    found = demultiplex.call(alignments.parse_sam(sam), vcf.parse_vcf(lines), [f"d{k}" for k in range(DONORS)], demultiplex.Options(min_snp=5))
    return sc.r6(found, *(c for c, kind in found.dtypes if kind == "double"))


def _three_alleles(s: SparkSession, f: str) -> DataFrame:
    """Six samples of every variant: (snp_id, sample, n_allele, ploidy); a quarter of the variants lie where men have
    one copy, another one where women have none."""
    rows = table(s, f, "part").select(F.col("p_partkey").alias("snp_id"), F.explode(F.array(*(F.lit(k).cast("long") for k in range(6)))).alias("sample"))
    chrom = F.element_at(F.array(*(F.lit(c) for c in ("1", "X", "2", "chrY"))), (F.col("snp_id") % 4 + 1).cast("int"))
    return rows.select("snp_id", "sample", F.lit(3).alias("n_allele"), alleles.ploidy(chrom, F.lit(alleles.X_BEGIN) + F.col("snp_id"), F.col("sample") % 2 == 1).alias("ploidy"))


def multiallelic_em(s: SparkSession, f: str) -> DataFrame:
    pl = lambda g: (F.col("snp_id") * (g + 2) + F.col("sample") * (g + 7)) % 7 * 10
    rows = _three_alleles(s, f).withColumn("l", F.array(*(F.pow(F.lit(10.0), pl(g) / -10) for g in range(6))))
    found = multiallelic.likelihood_posteriors(rows, 4)
    return found.select("snp_id", "sample", *(F.round(F.col("af")[a], 6).alias(f"af{a}") for a in range(3)), *(F.round(F.col("p")[g], 6).alias(f"p{g}") for g in range(6)))


def multiallelic_calls(s: SparkSession, f: str) -> DataFrame:
    a, b = (F.col("snp_id") + F.col("sample")) % 3, (F.col("snp_id") * 5 + F.col("sample") * 2) % 3
    gt = F.when((F.col("snp_id") + F.col("sample")) % 5 == 0, F.lit(None)).when(F.col("ploidy") == 1, F.array(a)).when(F.col("ploidy") == 2, F.array(a, b))
    found = multiallelic.call_posteriors(_three_alleles(s, f).withColumn("gt", gt))
    return found.select("snp_id", "sample", *(F.round(F.col("p")[g], 6).alias(f"p{g}") for g in range(6)))


QUERIES = {"multiallelic_em": multiallelic_em, "multiallelic_calls": multiallelic_calls, "files_to_calls": files_to_calls, "demux_panel": demux_panel, "mixture_em": mixture_em, "mixture_gibbs": mixture_gibbs, "louvain_full": louvain_full}


# ---- The same in SQL ----
def _panel() -> str:
    mix = sc._demux().split("gps AS MATERIALIZED")[0].rstrip(", \n")
    terms = lambda n: sc._plus([f"a.p{x} * b.p{y} * m{n}_{x}{y}" for x, y in sc._STATES])
    gp = ", ".join(f"CASE WHEN gt IS NULL THEN {sc._P[g]} WHEN gt = {g} THEN 0.99e0 ELSE 0.005e0 END AS p{g}" for g in range(3))
    single, pair = demux.log_priors(PANEL, 2, 0.5)
    return f"""WITH {mix}, {sc.SNPS}, pc AS (SELECT snp_id, d, af, CASE WHEN (snp_id + d) % 11 = 0 THEN NULL ELSE (snp_id * (d + 3)) % 97 % 3 END AS gt FROM snps CROSS JOIN range({PANEL}) t(d)),
      gps AS MATERIALIZED (SELECT snp_id, CAST(d AS INTEGER) AS d, {gp} FROM pc),
      llks AS MATERIALIZED (SELECT cell_id, a.d AS j, b.d AS k, 0 AS n, sum(ln({terms(0)})) AS llk FROM mix JOIN gps a USING (snp_id) JOIN gps b ON b.snp_id = mix.snp_id AND b.d = a.d GROUP BY 1, 2, 3
        UNION ALL SELECT cell_id, a.d, b.d, 1, sum(ln({terms(1)})) FROM mix JOIN gps a USING (snp_id) JOIN gps b ON b.snp_id = mix.snp_id AND b.d < a.d GROUP BY 1, 2, 3),
      x AS (SELECT cell_id, n, llk + CASE WHEN n = 0 THEN {single!r}e0 ELSE {pair!r}e0 END AS x FROM llks), t AS (SELECT cell_id, max(x) AS top FROM x GROUP BY 1),
      post AS (SELECT cell_id, round(sum(CASE WHEN n = 0 THEN exp(x - top) END) / sum(exp(x - top)), 6) AS sng_posterior, round(max(top) + ln(sum(exp(x - top))), 6) AS log_total FROM x JOIN t USING (cell_id) GROUP BY 1)
      {sc._BEST} {sc._CALLS.replace("SELECT cell_id, type, CASE", "SELECT cell_id, sng_posterior, log_total, type, CASE").replace("AS next_llk FROM rival", "AS next_llk FROM rival JOIN post USING (cell_id)")}"""


def _em() -> str:
    k, both = COMPONENTS, mixture.pairs_of(COMPONENTS)
    n = k + len(both)
    half = lambda j: sc._plus([f"w{j}", *(f"w{k + i} / 2" for i, p in enumerate(both) if j in p)])
    rounds = [f"w0s AS (SELECT s_suppkey AS cell_id, {', '.join(f'CASE WHEN s_suppkey % {n} = {j} THEN 0.5e0 ELSE {0.5 / (n - 1)!r}e0 END AS w{j}' for j in range(n))} FROM supplier SEMI JOIN c ON s_suppkey = cell_id)"]
    for r in range(ROUNDS):
        logs = [f"ln(p{j})" for j in range(k)] + [f"ln((p{a} + p{b}) / 2)" for a, b in both]
        prior = [f"ln({1 - DOUBLETS!r}e0 * pi{j})" for j in range(k)] + [f"ln({DOUBLETS!r}e0 * pi{a} * pi{b} / ({sc._plus([f'pi{x} * pi{y}' for x, y in both])}))" for a, b in both]
        rounds += [
            f"mass{r} AS MATERIALIZED (SELECT {', '.join(f'sum({half(j)}) AS m{j}' for j in range(k))} FROM w{r}s)",
            f"raw{r} AS MATERIALIZED (SELECT gene, {', '.join(f'sum(n * ({half(j)})) + {ALPHA!r}e0 * any_value(m{j}) AS q{j}' for j in range(k))} FROM c JOIN w{r}s USING (cell_id) CROSS JOIN mass{r} GROUP BY 1)",
            f"prof{r} AS MATERIALIZED (SELECT gene, {', '.join(f'q{j} / sum(q{j}) OVER () AS p{j}' for j in range(k))} FROM raw{r})",
            f"pri{r} AS (SELECT {', '.join(f'm{j} / ({sc._plus([f"m{i}" for i in range(k)])}) AS pi{j}' for j in range(k))} FROM mass{r})",
            f"con{r} AS MATERIALIZED (SELECT {', '.join(f'{ALPHA!r}e0 * sum({x}) + any_value({prior[i]}) AS c{i}' for i, x in enumerate(logs))} FROM prof{r} CROSS JOIN pri{r})",
            f"x{r} AS MATERIALIZED (SELECT cell_id, {', '.join(f'sum(n * {x}) + any_value(c{i}) AS x{i}' for i, x in enumerate(logs))} FROM c JOIN prof{r} USING (gene) CROSS JOIN con{r} GROUP BY 1)",
            f"e{r} AS (SELECT cell_id, {', '.join(f'exp(x{i} - greatest({", ".join(f"x{y}" for y in range(n))})) AS e{i}' for i in range(n))} FROM x{r})",
            f"w{r + 1}s AS MATERIALIZED (SELECT cell_id, {', '.join(f'e{i} / ({sc._plus([f"e{y}" for y in range(n)])}) AS w{i}' for i in range(n))} FROM e{r})",
        ]
    return f"WITH c AS MATERIALIZED (SELECT l_suppkey AS cell_id, l_partkey % 40 AS gene, count(*) AS n FROM lineitem GROUP BY 1, 2), {', '.join(rounds)} SELECT cell_id, {', '.join(f'round(w{i}, 6) AS w{i}' for i in range(n))} FROM w{ROUNDS}s"


def _files() -> str:
    unique = """obs AS (SELECT l_suppkey AS cell_id, l_partkey AS snp_id, l_orderkey % 4 AS umi, l_orderkey || '-' || l_linenumber AS qname,
        CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS allele, least(CAST(l_quantity AS INTEGER), 40) AS bq FROM lineitem WHERE CAST(l_quantity AS INTEGER) >= 13),
      uniq AS (SELECT snp_id, cell_id, umi, allele, bq FROM obs SEMI JOIN kept USING (snp_id) QUALIFY row_number() OVER (PARTITION BY snp_id, cell_id, umi ORDER BY qname, allele, bq) = 1)"""
    kept = """kept AS MATERIALIZED (SELECT snp_id, (ac + 0.5e0) / (an + 1) AS af FROM (SELECT snp_id, coalesce(sum(gt), 0) AS ac, 2 * count(gt) AS an FROM calls GROUP BY 1) WHERE least(ac, an - ac) >= 1)"""
    post = ", ".join(f"CASE WHEN gt IS NULL THEN {sc._P[g]} WHEN gt = {g} THEN 0.99e0 ELSE 0.005e0 END AS r{g}" for g in range(3))
    mixed = ", ".join(f"max(CASE WHEN donor = {d} THEN x{g} END) AS p{d}_{g}" for d in range(DONORS) for g in range(3))
    gps = f"""gps AS MATERIALIZED (SELECT snp_id, {mixed} FROM (SELECT snp_id, donor, {", ".join(f"0.9e0 * r{g} + 0.1e0 * avg(r{g}) OVER (PARTITION BY snp_id) AS x{g}" for g in range(3))}
      FROM (SELECT snp_id, donor, {post} FROM (SELECT calls.snp_id, donor, gt, kept.af FROM calls JOIN kept USING (snp_id)))) GROUP BY 1)"""
    text = sc._demux().replace(UNIQUE, f"{CALLS}, {kept}, {unique}", 1).replace(f"{unique}, {CALLS}", unique, 1)
    text = re.sub(r"gps AS MATERIALIZED \(.*?GROUP BY 1\)", lambda _: gps, text, count=1, flags=re.DOTALL)
    single, pair = demux.log_priors(DONORS, 2, 0.5)
    two = lambda a, b, share: f"'d' || {a} || ',d' || {b} || ',{share}'"
    dbl, sng = "type = 'DBL'", lambda a: two(a, a, "0.00")
    return f"""WITH {text} {sc._BEST},
      x AS (SELECT cell_id, n, llk + CASE WHEN n = 0 THEN {single!r}e0 ELSE {pair!r}e0 END AS x FROM llks WHERE n = 0 OR j > k), t AS (SELECT cell_id, max(x) AS top, max(CASE WHEN n = 0 THEN x END) AS most FROM x GROUP BY 1),
      post AS (SELECT cell_id, sum(CASE WHEN n = 0 THEN exp(x - top) END) / sum(exp(x - top)) AS sng_posterior, exp(max(most) - max(top)) / sum(CASE WHEN n = 0 THEN exp(x - top) END) AS sng_only_posterior, max(top) + ln(sum(exp(x - top))) AS log_total FROM x JOIN t USING (cell_id) GROUP BY 1),
      cnt AS (SELECT cell_id, 'B' || cell_id AS barcode, count(DISTINCT snp_id) AS num_snps, count(*) AS num_reads, row_number() OVER (ORDER BY 'B' || cell_id) - 1 AS int_id FROM uniq GROUP BY 1),
      typed AS (SELECT *, CASE WHEN dbl_best_llk > sng_best_llk + 2 THEN 'DBL' WHEN sng_best_llk > sng_next_llk + 2 THEN 'SNG' ELSE 'AMB' END AS type FROM best),
      riv AS (SELECT *, CASE WHEN {dbl} THEN dbl_next_llk > sng_best_llk + 2 ELSE dbl_best_llk > sng_next_llk + 2 END AS rival FROM typed),
      out AS (SELECT *, CASE WHEN {dbl} THEN dbl_best_llk ELSE sng_best_llk END AS best_llk, CASE WHEN {dbl} THEN (CASE WHEN rival THEN dbl_next_llk ELSE sng_best_llk END) ELSE (CASE WHEN rival THEN dbl_best_llk ELSE sng_next_llk END) END AS next_llk FROM riv)
      SELECT int_id, barcode, num_snps, num_reads, type AS droplet_type, CASE WHEN {dbl} THEN {two("dbl_best", "dbl_best2", "0.50")} ELSE {sng("sng_best")} END AS best_guess, round(best_llk, 6) AS best_llk,
        CASE WHEN {dbl} THEN (CASE WHEN rival THEN {two("dbl_next", "dbl_next2", "0.50")} ELSE {sng("sng_best")} END) ELSE (CASE WHEN rival THEN {two("dbl_best", "dbl_best2", "0.50")} ELSE {sng("sng_next")} END) END AS next_guess, round(next_llk, 6) AS next_llk,
        round(best_llk - next_llk, 6) AS diff_llk_best_next, round(exp(best_llk + CASE WHEN {dbl} THEN {pair!r}e0 ELSE {single!r}e0 END - log_total), 6) AS best_posterior, round(sng_posterior, 6) AS sng_posterior,
        'd' || sng_best AS sng_best_guess, round(sng_best_llk, 6) AS sng_best_llk, 'd' || sng_next AS sng_next_guess, round(sng_next_llk, 6) AS sng_next_llk, round(sng_only_posterior, 6) AS sng_only_posterior,
        {two("dbl_best", "dbl_best2", "0.50")} AS dbl_best_guess, round(dbl_best_llk, 6) AS dbl_best_llk, round(sng_best_llk - dbl_best_llk, 6) AS diff_llk_sng_dbl
      FROM out JOIN cnt USING (cell_id) JOIN post USING (cell_id) WHERE num_snps >= 5"""


_ORDER = [(a, b) for b in range(3) for a in range(b + 1)]
_THREE = """s AS (SELECT p_partkey AS snp_id, k AS sample, CASE p_partkey % 4 WHEN 1 THEN CASE WHEN k % 2 = 1 THEN 1 ELSE 2 END WHEN 3 THEN k % 2 ELSE 2 END AS ploidy FROM part CROSS JOIN range(6) t(k))"""


def _prior(f) -> list[str]:
    """The probability of every genotype for one and for two copies."""
    return [f"CASE ploidy WHEN 2 THEN {1 if a == b else 2} * ({f(a)}) * ({f(b)}) WHEN 1 THEN {f'({f(a)})' if a == b else '0e0'} END" for a, b in _ORDER]


def _many() -> str:
    text = [_THREE, "l AS MATERIALIZED (SELECT *, " + ", ".join(f"pow(10, -((snp_id * {g + 2} + sample * {g + 7}) % 7)) AS l{g}" for g in range(6)) + " FROM s)", "f0 AS (SELECT DISTINCT snp_id, 1 / 3e0 AS f0, 1 / 3e0 AS f1, 1 / 3e0 AS f2 FROM s)"]
    for r in range(4):
        w = ", ".join(f"l{g} * ({x}) AS w{g}" for g, x in enumerate(_prior(lambda a: f"f{a}")))
        text += [
            f"w{r} AS (SELECT snp_id, sample, ploidy, {w} FROM l JOIN f{r} USING (snp_id))",
            f"p{r} AS MATERIALIZED (SELECT snp_id, sample, ploidy, {', '.join(f'w{g} / ({sc._plus([f"w{x}" for x in range(6)])}) AS p{g}' for g in range(6))} FROM w{r})",
            f"f{r + 1} AS MATERIALIZED (SELECT snp_id, {', '.join('sum(ploidy / 2e0 * (' + sc._plus([f'{(a == x) + (b == x)} * p{g}' for g, (a, b) in enumerate(_ORDER) if x in (a, b)]) + f')) / sum(ploidy) FILTER (ploidy > 0) AS f{x}' for x in range(3))} FROM p{r} GROUP BY 1)",
        ]
    return f"WITH {', '.join(text)} SELECT snp_id, sample, {', '.join(f'round(f{x}, 6) AS af{x}' for x in range(3))}, {', '.join(f'round(p{g}, 6) AS p{g}' for g in range(6))} FROM p3 JOIN f4 USING (snp_id)"


def _many_calls() -> str:
    place = "CASE " + " ".join(f"WHEN least(a, b) = {x} AND greatest(a, b) = {y} THEN {g}" for g, (x, y) in enumerate(_ORDER)) + " END"
    prior = _prior(lambda a: f"(n{a} + 1 / 3e0) / (an + 1)")
    return f"""WITH {_THREE}, c AS (SELECT *, (snp_id + sample) % 5 <> 0 AND ploidy > 0 AS known, (snp_id + sample) % 3 AS a, CASE WHEN ploidy = 2 THEN (snp_id * 5 + sample * 2) % 3 ELSE (snp_id + sample) % 3 END AS b FROM s),
      h AS (SELECT snp_id, {', '.join(f"coalesce(sum(CASE WHEN a = {x} THEN 1 ELSE 0 END + CASE WHEN ploidy = 2 AND b = {x} THEN 1 ELSE 0 END) FILTER (known), 0) AS n{x}" for x in range(3))}, coalesce(sum(ploidy) FILTER (known), 0) AS an FROM c GROUP BY 1)
      SELECT snp_id, sample, {', '.join(f"round(CASE WHEN known THEN CASE WHEN {place} = {g} THEN 0.99e0 ELSE 0.01e0 / 5 END ELSE {x} END, 6) AS p{g}" for g, x in enumerate(prior))} FROM c JOIN h USING (snp_id)"""


ORACLE_SQL = {"multiallelic_em": _many(), "multiallelic_calls": _many_calls(), "files_to_calls": _files(), "demux_panel": _panel(), "mixture_em": _em()}
