"""From alignments and genotypes to calls of droplets, in one piece.

Reads are filtered and put on the variants; the first base of each variant, droplet and UMI counts; droplets that
have enough stay; genotypes become probabilities of every donor, drawn towards the donors' mean by the error of
genotypes; then all donors and pairs of donors are weighed (``panel``) and called.  Each step is a DataFrame, and
nothing but the panel's blocks of arrays is held in a task.

Defined results: variants with several alternatives or longer alleles are left out, of variants that are given
twice the first by its line's text; reads without a barcode are left out, those without a UMI share one named
"."; a haploid call counts as two equal alleles; a missing call has the probabilities of its frequency; droplets
that share no variant with the panel have no row; fewer than two donors are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropletry.functions.filters import alleles_of
from dropletry.functions.phred import hardy_weinberg
from dropletry.operators import demux, genotypes, panel, pileup, reads
from dropletry.operators.likelihood import mixtures
from dropletry.operators.ranking import numbered, saved
from dropletry.sources.alignments import bases_on_variants


@dataclass(frozen=True)
class Options:
    """As the programs' options of these names; genotype_error: of a call; offset, coefficient, r2: how far a
    variant's probabilities are drawn to the donors' mean, by its INFO field of that name."""

    field: str = "GT"
    genotype_error: float = 0.01
    offset: float = 0.1
    coefficient: float = 0.0
    r2: str = "R2"
    min_mac: int = 1
    min_callrate: float = 0.5
    alphas: tuple[float, ...] = (0.0, 0.5)
    doublet: float = 0.5
    tag_barcode: str = "CB"
    tag_umi: str = "UB"
    min_mapq: int = 20
    min_bq: int = 13
    cap_bq: int = 40
    min_tail: int = 0
    min_total: int = 0
    min_umi: int = 0
    min_snp: int = 0
    tiles: panel.Settings = panel.Settings()


def genotype_panel(records: DataFrame, options: Options | None = None) -> DataFrame:
    """(snp_id, chrom, pos, ref, alt, af, p: the 3 probabilities of every sample, one after another) of records
    (``variants.parse_vcf``) whose variants have one alternative of one base and pass the limits; field: GT, GP
    or PL."""
    o = options or Options()
    rows = genotypes.biallelic_snps(records, strict=True)
    rows = rows.groupBy("chrom", "pos", "ref", "alt").agg(F.min(F.struct(F.to_json("info").alias("info"), F.to_json("samples").alias("samples"))).alias("x"))
    rows = rows.select("chrom", "pos", "ref", "alt", F.from_json("x.info", "map<string,string>").alias("info"), F.from_json("x.samples", "array<map<string,string>>").alias("samples"))

    def copies(s: Column) -> Column:
        called = alleles_of(s["GT"])
        n = F.size(F.filter(called, lambda a: a > 0)).cast("long")
        return F.when((F.size(called) > 0) & F.forall(called, lambda a: a.isNotNull()), F.when(F.size(called) == 1, 2 * n).otherwise(n))

    rows = rows.withColumn("gt", F.transform("samples", copies))
    told = F.filter("gt", lambda g: g.isNotNull())
    rows = rows.withColumns({"n_sample": F.size("gt"), "an": 2 * F.size(told), "ac": F.aggregate(told, F.lit(0).cast("long"), lambda a, g: a + g)})
    rows = genotypes.passing_variants(rows.withColumns({"af": (F.col("ac") + 0.5) / (F.col("an") + 1), "callrate": F.col("an") / (2 * F.col("n_sample"))}), o.min_mac, o.min_callrate)
    prior = hardy_weinberg(F.col("af"))
    numbers = lambda text: F.transform(F.split(text, ","), lambda x: x.try_cast("double"))
    whole = lambda x: (F.size(x) == 3) & F.forall(x, lambda v: v.isNotNull())
    scaled = lambda x: F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda a, b: a + b))
    if o.field == "GT":
        p = F.transform("gt", lambda g: F.array(*genotypes.call_posterior(g, F.col("af"), o.genotype_error)))
    elif o.field == "GP":
        p = F.transform("samples", lambda s: F.when(whole(numbers(s["GP"])), scaled(F.transform(numbers(s["GP"]), lambda v: v + 1e-10))).otherwise(F.array(*prior)))
    elif o.field == "PL":
        p = F.transform("samples", lambda s: scaled(F.zip_with(F.array(*genotypes.likelihoods_of_pl(s["PL"])), F.array(*prior), lambda x, y: x * y)))
    else:
        raise ValueError(f"{o.field} is none of GT, GP and PL")
    r2 = F.col("info")[o.r2].try_cast("double") if o.coefficient else F.lit(1.0)
    if o.coefficient:
        r2 = F.coalesce(r2, F.raise_error(F.lit(f"a variant has no {o.r2}")).cast("double"))
    mean = lambda g: F.aggregate("p", F.lit(0.0), lambda a, x: a + x[g]) / F.col("n_sample")
    rows = rows.withColumn("p", p).withColumns({f"m{g}": mean(g) for g in range(3)})
    mixed = F.transform("p", lambda x: F.array(*genotypes.mixed_with_mean([x[g] for g in range(3)], [F.col(f"m{g}") for g in range(3)], r2, o.offset, o.coefficient)))
    rows = rows.select("chrom", "pos", "ref", "alt", "af", F.flatten(mixed).alias("p"))
    return numbered(rows, "snp_id", F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"))


def observations(alignments: DataFrame, snps: DataFrame, options: Options | None = None, whitelist: DataFrame | None = None) -> DataFrame:
    """(snp_id, barcode, umi, allele, bq, n_dup): the first base of each variant, droplet and UMI."""
    o = options or Options()
    rows = reads.tagged(reads.passing(alignments, o.min_mapq), o.tag_barcode, "barcode", skip_empty=True)
    rows = rows if whitelist is None else reads.whitelisted(rows, whitelist)
    rows = reads.tagged(rows, o.tag_umi, "umi")
    bases = reads.usable_bases(bases_on_variants(rows, snps.select("snp_id", "chrom", "pos", "ref", "alt")), o.min_bq, o.cap_bq, o.min_tail).where("base <> 'N'")
    bases = bases.withColumnRenamed("barcode", "cell_id").withColumn("allele", reads.allele_code(F.col("base"), F.col("ref"), F.col("alt")))
    return pileup.dedup_umis(bases, ["pos0", "qname"]).withColumnRenamed("cell_id", "barcode")


def call(alignments: DataFrame, records: DataFrame, samples: list[str], options: Options | None = None, whitelist: DataFrame | None = None) -> DataFrame:
    """The 20 columns of every droplet's call, from reads (``alignments.read_sam``) and records
    (``variants.read_vcf``) of the samples named.

    int_id: the place of its barcode among all; guesses name two samples and a share; posteriors are
    probabilities.
    """
    o = options or Options()
    alphas = list(o.alphas)
    snps = saved(genotype_panel(records, o))
    unique = saved(observations(alignments, snps, o, whitelist))
    cells = numbered(unique.select("barcode").distinct(), "cell_id", F.col("barcode"))
    unique = saved(unique.join(cells, "barcode"))
    counted = pileup.passing_cells(pileup.cell_counters(unique), o.min_total, o.min_umi, o.min_snp).join(cells, "cell_id")
    kept = unique.join(counted.select("cell_id"), "cell_id", "left_semi")
    best = saved(panel.panel_best(mixtures(kept, alphas), snps.select("snp_id", "p"), len(samples), alphas, o.tiles, o.doublet))

    single, *pairs = panel.log_priors(len(samples), alphas, o.doublet)
    name = lambda c: F.get(F.array(*(F.lit(s) for s in samples)), F.col(c))
    share = lambda c: F.format_string("%.2f", F.get(F.array(*(F.lit(float(a)) for a in o.alphas)), F.col(c)))
    two = lambda a: F.when(F.col(a).isNotNull(), F.concat_ws(",", name(a), name(f"{a}2"), share(f"{a}_n")))
    one = lambda a: F.when(F.col(a).isNotNull(), F.concat_ws(",", name(a), name(a), F.lit(f"{o.alphas[0]:.2f}")))
    c = F.col
    kind = demux.droplet_type(c("sng_best_llk"), c("sng_next_llk"), c("dbl_best_llk"))
    rows = best.join(counted.select("cell_id", "barcode", "n_snp", "n_umi_w_snp"), "cell_id").withColumn("type", kind)
    double = c("type") == "DBL"
    rival = F.when(double, F.coalesce(c("dbl_next_llk") > c("sng_best_llk") + demux.MARGIN, F.lit(False))).otherwise(c("dbl_best_llk") > c("sng_next_llk") + demux.MARGIN)
    rows = rows.withColumn("rival", rival)
    best_llk = F.when(double, c("dbl_best_llk")).otherwise(c("sng_best_llk"))
    next_llk = F.when(double, F.when(c("rival"), c("dbl_next_llk")).otherwise(c("sng_best_llk"))).otherwise(F.when(c("rival"), c("dbl_best_llk")).otherwise(c("sng_next_llk")))
    prior = F.when(double, F.get(F.array(F.lit(0.0), *(F.lit(p) for p in pairs)), c("dbl_best_n"))).otherwise(F.lit(single))
    return rows.select(
        c("cell_id").alias("int_id"), "barcode", c("n_snp").alias("num_snps"), c("n_umi_w_snp").alias("num_reads"), c("type").alias("droplet_type"),
        F.when(double, two("dbl_best")).otherwise(one("sng_best")).alias("best_guess"), best_llk.alias("best_llk"),
        F.when(double, F.when(c("rival"), two("dbl_next")).otherwise(one("sng_best"))).otherwise(F.when(c("rival"), two("dbl_best")).otherwise(one("sng_next"))).alias("next_guess"), next_llk.alias("next_llk"),
        (best_llk - next_llk).alias("diff_llk_best_next"), F.exp(best_llk + prior - c("log_total")).alias("best_posterior"), "sng_posterior",
        name("sng_best").alias("sng_best_guess"), "sng_best_llk", name("sng_next").alias("sng_next_guess"), "sng_next_llk", "sng_only_posterior",
        two("dbl_best").alias("dbl_best_guess"), "dbl_best_llk", (c("sng_best_llk") - c("dbl_best_llk")).alias("diff_llk_sng_dbl"),
    )
