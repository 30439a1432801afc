"""Genotype likelihoods of droplets as sums of logarithms over their observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropletry.functions.phred import added, error_probability, hardy_weinberg
from dropletry.operators.ranking import numbered

FLOOR = 1e-6
STATES = [(g1, g2) for g1 in range(3) for g2 in range(3)]


def genotype_pairs(unique: DataFrame, alpha: float = 0.5, other_as_alt: bool = False) -> DataFrame:
    """(cell_id, snp_id, n_obs, g0 ... g8): likelihoods of nine pairs of genotypes, summing to 1.

    A droplet holds genotype g1 with share 1 - alpha and g2 with share alpha; other alleles count as
    observations but say nothing or, if asked, what an alternative one says.
    """
    e = error_probability(F.col("bq"))
    terms = []
    for g1, g2 in STATES:
        f = (g1 * (1 - alpha) + g2 * alpha) / 2
        terms.append(F.ln((1 - e) * F.when(F.col("allele") == 0, F.lit(1 - f)).otherwise(F.lit(f)) + e / 4))
    told = F.col("allele") <= (2 if other_as_alt else 1)
    sums = unique.groupBy("cell_id", "snp_id").agg(F.count("*").alias("n_obs"), *(F.coalesce(F.sum(F.when(told, t)), F.lit(0.0)).alias(f"s{k}") for k, t in enumerate(terms)))
    top = F.greatest(*(F.col(f"s{k}") for k in range(9)))
    raw = sums.select("cell_id", "snp_id", "n_obs", *(F.exp(F.col(f"s{k}") - top).alias(f"e{k}") for k in range(9)))
    total = added([F.col(f"e{k}") for k in range(9)])
    floored = raw.select("cell_id", "snp_id", "n_obs", *(F.greatest(F.col(f"e{k}") / total, F.lit(FLOOR)).alias(f"h{k}") for k in range(9)))
    total = added([F.col(f"h{k}") for k in range(9)])
    return floored.select("cell_id", "snp_id", "n_obs", *((F.col(f"h{k}") / total).alias(f"g{k}") for k in range(9)))


def single_genotypes(unique: DataFrame) -> DataFrame:
    """(cell_id, snp_id, n_obs, g0, g1, g2): likelihoods of one genotype, floored, summing to 1; each of
    the other three bases has a third of the error."""
    e = error_probability(F.col("bq"))
    terms = [F.when(F.col("allele") == 0, 1 - e).otherwise(e / 3), 0.5 - e / 3, F.when(F.col("allele") == 1, 1 - e).otherwise(e / 3)]
    told = F.col("allele") <= 1
    sums = unique.groupBy("cell_id", "snp_id").agg(F.count("*").alias("n_obs"), *(F.coalesce(F.sum(F.when(told, F.ln(t))), F.lit(0.0)).alias(f"s{k}") for k, t in enumerate(terms)))
    raw = [F.exp(F.col(f"s{k}") - F.greatest("s0", "s1", "s2")) for k in range(3)]
    floored = sums.select("cell_id", "snp_id", "n_obs", *(F.greatest(x / added(raw), F.lit(FLOOR)).alias(f"h{k}") for k, x in enumerate(raw)))
    return floored.select("cell_id", "snp_id", "n_obs", *((F.col(f"h{k}") / F.expr("h0 + h1 + h2")).alias(f"g{k}") for k in range(3)))


def unspecified_pairs(mix: DataFrame, posteriors: DataFrame, donors: int, n: int = 1) -> DataFrame:
    """(cell_id, llk0: of two unknown donors, llk: array, of each donor with an unknown one) at one share;
    an unknown donor has the donors' mean genotype."""
    p = lambda j, g: F.col("p")[3 * j + g]
    mean = [added([p(j, g) for j in range(donors)]) / donors for g in range(3)]
    rows = mix.join(posteriors, "snp_id").select("cell_id", "p", *(m.alias(f"u{g}") for g, m in enumerate(mean)), *(f"m{n}_{a}{b}" for a, b in STATES))
    both = F.ln(added([F.col(f"u{a}") * F.col(f"u{b}") * F.col(f"m{n}_{a}{b}") for a, b in STATES]))
    one = lambda j: F.ln(added([p(j, a) * F.col(f"u{b}") * F.col(f"m{n}_{a}{b}") for a, b in STATES]))
    sums = rows.groupBy("cell_id").agg(F.sum(both).alias("llk0"), *(F.sum(one(j)).alias(f"x{j}") for j in range(donors)))
    return sums.select("cell_id", "llk0", F.array(*(f"x{j}" for j in range(donors))).alias("llk"))


def singlet_scores(gl: DataFrame, snps: DataFrame) -> DataFrame:
    """Per droplet the log likelihoods of one and of two unrelated genotypes, and their difference."""
    p = hardy_weinberg(F.col("af"))
    one = added([F.col(f"g{4 * g}") * p[g] for g in range(3)])
    two = added([F.col(f"g{k}") * p[g1] * p[g2] for k, (g1, g2) in enumerate(STATES)])
    sums = gl.join(snps, "snp_id").groupBy("cell_id").agg(F.count("*").alias("n_snp"), F.sum("n_obs").alias("n_obs"), F.sum(F.ln(one)).alias("sng_llk"), F.sum(F.ln(two)).alias("dbl_llk"))
    return sums.withColumn("score", F.col("sng_llk") - F.col("dbl_llk"))


def ranked(scores: DataFrame) -> DataFrame:
    """Droplets by score, best first; of equal ones the larger id comes first."""
    return numbered(scores, "rank", F.desc("score"), F.desc("cell_id")).withColumn("rank", (F.col("rank") + 1).cast("int"))


def distances(gl: DataFrame, clusters: DataFrame, snps: DataFrame) -> DataFrame:
    """Of each droplet and cluster (cluster, snp_id, c0, c1, c2) the log likelihoods of the same and of
    unrelated genotypes over the variants that both cover."""
    p = hardy_weinberg(F.col("af"))
    same = added([F.col(f"g{4 * g}") * F.col(f"c{g}") * p[g] for g in range(3)])
    apart = added([F.col(f"g{4 * a}") * F.col(f"c{b}") * p[a] * p[b] for a in range(3) for b in range(3)])
    rows = gl.join(clusters, "snp_id").join(snps, "snp_id")
    return rows.groupBy("cell_id", "cluster").agg(F.count("*").alias("n_snp"), F.sum(F.ln(apart)).alias("llk0"), F.sum(F.ln(same)).alias("llk2"))


def pair_distances(gl: DataFrame, snps: DataFrame) -> DataFrame:
    """Of each two droplets, the larger id first, what ``distances`` gives of a droplet and a cluster; a
    variant's pairs grow with the square of the droplets that cover it."""
    p = hardy_weinberg(F.col("af"))
    other = gl.select("snp_id", F.col("cell_id").alias("other_id"), *(F.col(f"g{4 * g}").alias(f"c{g}") for g in range(3)))
    same = added([F.col(f"g{4 * g}") * F.col(f"c{g}") * p[g] for g in range(3)])
    apart = added([F.col(f"g{4 * a}") * F.col(f"c{b}") * p[a] * p[b] for a in range(3) for b in range(3)])
    rows = gl.join(other, "snp_id").where("cell_id > other_id").join(snps, "snp_id")
    return rows.groupBy("cell_id", "other_id").agg(F.count("*").alias("n_snp"), F.sum(F.ln(apart)).alias("llk0"), F.sum(F.ln(same)).alias("llk2"))


def removed(gl: DataFrame, other: DataFrame) -> DataFrame:
    """``gl`` without the likelihoods of ``other`` (cell_id, snp_id, n_obs, g0 ... g8), one row at most for
    each of ``gl``'s: quotients scaled to 1, floored and scaled again."""
    taken = other.select("cell_id", "snp_id", F.col("n_obs").alias("m_obs"), *(F.col(f"g{k}").alias(f"o{k}") for k in range(9)))
    rows = gl.join(taken, ["cell_id", "snp_id"], "left")
    total = added([F.col(f"g{k}") / F.col(f"o{k}") for k in range(9)])
    floored = rows.withColumns({f"h{k}": F.greatest(F.col(f"g{k}") / F.col(f"o{k}") / total, F.lit(FLOOR)) for k in range(9)})
    total = added([F.col(f"h{k}") for k in range(9)])
    # A row that nothing is taken from stays as it is.
    left = [F.when(F.col("m_obs").isNull(), F.col(f"g{k}")).otherwise(F.col(f"h{k}") / total).alias(f"g{k}") for k in range(9)]
    return floored.select("cell_id", "snp_id", (F.col("n_obs") - F.coalesce("m_obs", F.lit(0))).alias("n_obs"), *left)


def mixtures(unique: DataFrame, alphas: list[float]) -> DataFrame:
    """(cell_id, snp_id, m: for each alpha nine likelihoods), relative to the largest over all alphas.

    The error model gives each of the other three bases a third of the error.
    """
    e = error_probability(F.col("bq"))
    r = F.when(F.col("allele") == 0, 1 - e).otherwise(e / 3)
    a = F.when(F.col("allele") == 1, 1 - e).otherwise(e / 3)
    names, sums = [], []
    for n, alpha in enumerate(alphas):
        for g1, g2 in STATES:
            p = 0.5 * g1 + (g2 - g1) * 0.5 * alpha
            names.append(f"s{n}_{g1}{g2}")
            sums.append(F.sum(F.ln(r * (1 - p) + a * p)).alias(names[-1]))
    rows = unique.where("allele <= 1").groupBy("cell_id", "snp_id").agg(*sums)
    top = F.greatest(*names)
    # The largest is 1 before the small constant is added and 1 plus that constant after it.
    return rows.select("cell_id", "snp_id", *(((F.exp(F.col(x) - top) + 1e-10) / (1 + 1e-10)).alias(x.replace("s", "m")) for x in names))


def donor_pairs(mix: DataFrame, posteriors: DataFrame, donors: int, alphas: list[float]) -> DataFrame:
    """(cell_id, j, k, n, llk): log likelihood of each donor j with donor k at the share alphas[n].

    posteriors: (snp_id, p: donors x 3 probabilities in one array).  All pairs of a variant are one
    row of sums, so the join does not multiply rows; n = 0 is the donor alone.
    """
    pairs = [(j, k, n) for n in range(len(alphas)) for j in range(donors) for k in range(donors) if (n > 0 and j != k) or (n == 0 and j == k)]

    def likelihood(j: int, k: int, n: int) -> Column:
        return F.ln(added([F.col("p")[3 * j + a] * F.col("p")[3 * k + b] * F.col(f"m{n}_{a}{b}") for a, b in STATES]))

    sums = mix.join(posteriors, "snp_id").groupBy("cell_id").agg(*(F.sum(likelihood(*x)).alias("l%d_%d_%d" % x) for x in pairs))
    entries = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(k).alias("k"), F.lit(n).alias("n"), F.col(f"l{j}_{k}_{n}").alias("llk")) for j, k, n in pairs))
    return sums.select("cell_id", F.explode(entries).alias("x")).select("cell_id", "x.*")
