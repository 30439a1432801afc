"""Genotypes: counts, frequencies, filters and posteriors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropletry.functions.phred import added, hardy_weinberg


def allele_counts(calls: DataFrame) -> DataFrame:
    """Per variant from diploid calls (snp_id, gt: copies of the alternative allele or null): samples,
    alleles called and alternative, frequency with and without pseudo-count, call rate."""
    out = calls.groupBy("snp_id").agg(F.count("*").alias("n_sample"), (2 * F.count("gt")).alias("an"), F.coalesce(F.sum("gt"), F.lit(0)).cast("long").alias("ac"))
    return out.withColumns({
        "af": F.when(F.col("an") > 0, F.col("ac") / F.col("an")), "af_pseudo": (F.col("ac") + 0.5) / (F.col("an") + 1), "callrate": F.col("an") / (2 * F.col("n_sample")),
    })


def dosage_counts(dosages: DataFrame) -> DataFrame:
    """Per variant from (snp_id, ds: dosage of the alternative allele or null): samples, alleles told,
    their dosage and frequency."""
    told = F.when(~F.isnan("ds"), F.col("ds"))
    out = dosages.groupBy("snp_id").agg(F.count("*").alias("n_sample"), (2 * F.count(told)).alias("an"), F.coalesce(F.sum(told), F.lit(0.0)).alias("ac"))
    return out.withColumn("af", F.when(F.col("an") > 0, F.col("ac") / F.col("an")))


def passing_variants(counts: DataFrame, min_mac: int = 1, min_callrate: float = 0.5) -> DataFrame:
    """Variants whose rarer allele and call rate are frequent enough."""
    return counts.withColumn("mac", F.least("ac", F.col("an") - F.col("ac"))).where((F.col("mac") >= min_mac) & (F.col("callrate") >= min_callrate))


def call_posterior(gt: Column, af: Column, error: float) -> list[Column]:
    """Probabilities of 0, 1 and 2 copies: of a call, up to the error; of none, by frequency."""
    prior = hardy_weinberg(af)
    return [F.when(gt.isNull(), prior[g]).when(gt == g, F.lit(1 - error)).otherwise(F.lit(error / 2)) for g in range(3)]


def normalized(gp: list[Column], smooth: float = 0.0) -> list[Column]:
    """Probabilities scaled to 1 after adding ``smooth`` to each."""
    total = added(gp) + 3 * smooth
    return [(g + smooth) / total for g in gp]


def mixed_with_mean(gp: list[Column], mean: list[Column], r2: Column, offset: float = 0.1, coefficient: float = 0.0) -> list[Column]:
    """The posteriors of badly imputed variants drawn towards the samples' mean."""
    err = F.least(F.greatest(F.lit(offset) + (1 - offset) * (1 - r2) * coefficient, F.lit(0.0)), F.lit(0.999))
    return [(1 - err) * g + err * m for g, m in zip(gp, mean)]


def frequency_by_em(likelihoods: DataFrame, rounds: int = 10) -> DataFrame:
    """Allele frequency of each variant from (snp_id, l0, l1, l2) over samples, by EM from 0.5.

    Equal likelihoods are counted first, so a variant is one row of few patterns, and all rounds run
    within that row.
    """
    patterns = likelihoods.groupBy("snp_id", "l0", "l1", "l2").agg(F.count("*").alias("n"))
    rows = patterns.groupBy("snp_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("l0", "l1", "l2", "n"))).alias("x"))

    def step(af: Column, _: Column) -> Column:
        def share(x: Column) -> Column:
            w = [x[f"l{g}"] * p for g, p in enumerate(hardy_weinberg(af))]
            return x["n"] * (w[1] + 2 * w[2]) / added(w)

        return F.aggregate("x", F.lit(0.0), lambda total, x: total + share(x)) / (2 * F.col("n"))

    return rows.select("snp_id", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(0.5), step).alias("af"))


def likelihoods_of_pl(pl: Column) -> list[Column]:
    """The likelihoods of 0, 1 and 2 copies from a PL field "a,b,c"; all 1 where it is missing."""
    part = F.split(pl, ",")
    return [F.coalesce(F.pow(F.lit(10.0), F.get(part, F.lit(g)).try_cast("double") / -10), F.lit(1.0)) for g in range(3)]


def posterior_of_likelihoods(lik: list[Column], af: Column) -> list[Column]:
    """Genotype probabilities from likelihoods and the frequency's prior."""
    return normalized([x * p for x, p in zip(lik, hardy_weinberg(af))])


def masked(gt: Column, depth: Column, quality: Column, min_depth: int = 0, min_quality: int = 0) -> Column:
    """A genotype, null where its depth or quality is too low or, if asked for, unknown."""
    low = (F.coalesce(depth, F.lit(-1)) < min_depth) if min_depth else F.lit(False)
    bad = (F.coalesce(quality, F.lit(-1)) < min_quality) if min_quality else F.lit(False)
    return F.when(~low & ~bad, gt)


def with_filters(variants: DataFrame, wanted: list[str]) -> DataFrame:
    """Variants (filters: array) that have one of the wanted filters; all, if none is wanted."""
    return variants.where(F.arrays_overlap("filters", F.array(*(F.lit(w) for w in wanted)))) if wanted else variants


def within_limits(
    counts: DataFrame, min_qual: float = 0.0, alleles: tuple[int, int] = (2, 2), snps_only: bool = False, min_callrate: float = 0.0, ac: tuple[int, int] = (0, 1 << 30),
    mac: tuple[int, int] = (0, 1 << 30), af: tuple[float, float] = (0.0, 1.0), maf: tuple[float, float] = (0.0, 1.0),
) -> DataFrame:
    """Variants (qual, n_allele, ref, alt, n_sample, an, ac) within all limits, which are inclusive.

    A missing quality fails a limit above 0.  Frequencies have a tiny pseudo-count, so that a variant
    without calls has one of a half.
    """
    freq = (F.col("ac") + 5e-11) / (F.col("an") + 1e-10)
    rare, rest = F.least("ac", F.col("an") - F.col("ac")), F.least(freq, 1 - freq)
    kept = (F.coalesce("qual", F.lit(0.0)) >= min_qual) & F.col("n_allele").between(*alleles) & (F.col("an") / (2 * F.col("n_sample")) >= min_callrate)
    kept = kept & F.col("ac").between(*ac) & rare.between(*mac) & freq.between(*af) & rest.between(*maf)
    if snps_only:
        kept = kept & (F.length("ref") == 1) & (F.length("alt") == 1)
    return counts.where(kept)


def biallelic_snps(variants: DataFrame, strict: bool) -> DataFrame:
    """Variants (ref, alts) with alt, one base each: by default the first base of the first alternative
    stands for any variant; ``strict`` keeps those with one alternative of one base alone."""
    rows = variants.where((F.size("alts") == 1) & (F.length("ref") == 1) & (F.length(F.col("alts")[0]) == 1)) if strict else variants
    return rows.withColumns({"ref": F.left("ref", F.lit(1)), "alt": F.left(F.col("alts")[0], F.lit(1))}).drop("alts")


def attached(snps: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Every variant of a pileup (chrom, pos, ref, alt) with its genotypes, null where place and alleles
    are not in the panel; genotypes: chrom, pos, ref, alt once each, and what is to be attached."""
    return snps.join(genotypes, ["chrom", "pos", "ref", "alt"], "left")
