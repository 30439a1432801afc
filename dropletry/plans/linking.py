"""Queries that link pileups, genotypes, annotation and clusters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dropletry.operators import clusters, demux, expression, genotypes, intervals, likelihood, pileup, reads
from dropletry.plans import counting, single_cell as sc
from dropletry.plans.adapters import DONORS, OBS, ORDER, donor_calls, donor_posteriors, observations, table, variants

r6 = sc.r6


# ---- Likelihoods ----
def doublet_gl(s: SparkSession, f: str) -> DataFrame:
    return r6(likelihood.genotype_pairs(sc.unique(s, f), 0.3, other_as_alt=True), *(f"g{k}" for k in range(9)))


def gl3_pileup(s: SparkSession, f: str) -> DataFrame:
    return r6(likelihood.single_genotypes(sc.unique(s, f)), "g0", "g1", "g2")


def demux_unspecified(s: SparkSession, f: str) -> DataFrame:
    rows = likelihood.unspecified_pairs(likelihood.mixtures(sc.unique(s, f), sc.ALPHAS), donor_posteriors(s, f), DONORS)
    return r6(rows.select("cell_id", "llk0", *(F.col("llk")[j].alias(f"llk_{j}") for j in range(DONORS))), "llk0", *(f"llk_{j}" for j in range(DONORS)))


def demux_table(s: SparkSession, f: str) -> DataFrame:
    """The result's columns of each droplet: counters, call, guesses and likelihoods, posteriors."""
    unique, pairs = sc.unique(s, f), clusters.saved(sc.pairs(s, f))
    best = demux.best_and_next(pairs)
    rows = pileup.cell_counters(unique).select("cell_id", "n_snp", "n_read").join(demux.calls(best), "cell_id").join(demux.posteriors(pairs, DONORS), "cell_id").join(best, "cell_id")
    rows = rows.withColumns({"llk_difference": F.col("best_llk") - F.col("next_llk"), "sng_minus_dbl": F.col("sng_best_llk") - F.col("dbl_best_llk"), "dbl_guess": F.concat_ws(",", "dbl_best", "dbl_best2")})
    rows = rows.select("cell_id", "n_snp", "n_read", "type", "best_guess", "best_llk", "next_guess", "next_llk", "llk_difference", "sng_posterior", "sng_only_posterior", "sng_best", "sng_best_llk", "sng_next", "sng_next_llk", "dbl_guess", "dbl_best_llk", "sng_minus_dbl")
    return r6(rows, "best_llk", "next_llk", "llk_difference", "sng_best_llk", "sng_next_llk", "dbl_best_llk", "sng_minus_dbl", "sng_posterior", "sng_only_posterior")


def pair_distance(s: SparkSession, f: str) -> DataFrame:
    gl = clusters.saved(sc.likelihoods(s, f))
    return r6(likelihood.pair_distances(gl, variants(s, f)), "llk0", "llk2")


def vote_by_distance(s: SparkSession, f: str) -> DataFrame:
    return clusters.voted_clusters(pair_distance(s, f), sc.seeded(s, f))


def pileup_removed(s: SparkSession, f: str) -> DataFrame:
    gl = sc.likelihoods(s, f)
    some = likelihood.genotype_pairs(sc.unique(s, f).where("umi = 0"))
    return r6(likelihood.removed(gl, some), *(f"g{k}" for k in range(9)))


def merge_in_order(s: SparkSession, f: str) -> DataFrame:
    order = table(s, f, "supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_suppkey") % 3).cast("int").alias("cluster"), F.col("s_suppkey").alias("rank"))
    rows = clusters.merged_in_order(sc.likelihoods(s, f), order)
    return r6(rows.select("cluster", "snp_id", "n_cell", *(F.col("g")[k].alias(f"g{k}") for k in range(9))), *(f"g{k}" for k in range(9)))


# ---- Genotypes ----
def pl_text(s: SparkSession, f: str) -> DataFrame:
    pl = F.concat_ws(",", (F.col("snp_id") * 7 + F.col("donor") * 11) % 40, (F.col("snp_id") * 3 + F.col("donor") * 5) % 30, (F.col("snp_id") + F.col("donor") * 13) % 50)
    return donor_calls(s, f).select("snp_id", "donor", F.when(F.col("gt").isNotNull(), pl).alias("pl"))


def pl_posterior(s: SparkSession, f: str) -> DataFrame:
    lik = [c.alias(f"l{g}") for g, c in enumerate(genotypes.likelihoods_of_pl(F.col("pl")))]
    rows = pl_text(s, f).select("snp_id", "donor", *lik)
    out = genotypes.posterior_of_likelihoods([F.col(f"l{g}") for g in range(3)], F.col("af"))
    # A row for each variant is no small table, whatever Spark guesses.
    joined = rows.join(genotypes.frequency_by_em(rows).hint("merge"), "snp_id").select("snp_id", "donor", "af", *(c.alias(f"p{g}") for g, c in enumerate(out)))
    return r6(joined, "af", "p0", "p1", "p2")


def dosage_af(s: SparkSession, f: str) -> DataFrame:
    ds = F.when(F.col("gt").isNotNull(), F.col("gt") * 0.75 + F.col("donor") / 8.0)
    return r6(genotypes.dosage_counts(donor_calls(s, f).select("snp_id", ds.alias("ds"))), "ac", "af")


def recorded(s: SparkSession, f: str) -> DataFrame:
    """Variants with filters, quality, alleles and counts of calls."""
    base = lambda c: F.substring(F.lit("ACGTA"), (c % 4 + 1).cast("int"), (c % 3 / 2 + 1).cast("int"))
    rows = table(s, f, "part").select(
        F.col("p_partkey").alias("snp_id"), F.when(F.col("p_size") % 9 != 0, F.col("p_size").cast("double")).alias("qual"), base(F.col("p_partkey")).alias("ref"), base(F.col("p_size")).alias("alt"),
        (F.col("p_size") % 3 + 2).cast("int").alias("n_allele"), F.split(F.element_at(F.array(F.lit("PASS"), F.lit("q10;s50"), F.lit("s50")), F.col("p_partkey").cast("int") % 3 + 1), ";").alias("filters"),
    )
    return rows.join(genotypes.allele_counts(donor_calls(s, f)).select("snp_id", "n_sample", "an", "ac"), "snp_id")


def variant_limits(s: SparkSession, f: str) -> DataFrame:
    rows = genotypes.with_filters(recorded(s, f), ["PASS", "q10"])
    return genotypes.within_limits(rows, min_qual=5, alleles=(2, 3), snps_only=True, min_callrate=0.8, ac=(1, 8), mac=(1, 4), af=(0.1, 0.9), maf=(0.05, 0.5)).select("snp_id", "ac", "an")


def strict_biallelic(s: SparkSession, f: str) -> DataFrame:
    rows = recorded(s, f).select("snp_id", "ref", F.when(F.col("n_allele") == 2, F.array("alt")).otherwise(F.array("alt", F.lit("TT"))).alias("alts"))
    both = genotypes.biallelic_snps(rows, False).withColumn("strict", F.lit(False)).unionByName(genotypes.biallelic_snps(rows, True).withColumn("strict", F.lit(True)))
    return both.groupBy("strict", "ref", "alt").agg(F.count("*").alias("n"))


def genotype_masking(s: SparkSession, f: str) -> DataFrame:
    dp, gq = F.when(F.col("snp_id") % 8 != 0, (F.col("snp_id") + F.col("donor")) % 20), (F.col("snp_id") * 3 + F.col("donor")) % 50
    return donor_calls(s, f).select("snp_id", "donor", genotypes.masked(F.col("gt"), dp, gq, 5, 10).alias("gt"))


def placed(s: SparkSession, f: str) -> DataFrame:
    return table(s, f, "part").select(F.col("p_partkey").alias("snp_id"), F.when(F.col("p_partkey") % 2 == 0, "1").otherwise("2").alias("chrom"), (F.col("p_partkey") * 10).alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"))


def genotype_left_join(s: SparkSession, f: str) -> DataFrame:
    p = table(s, f, "part").where("p_size % 3 <> 0").select(F.when(F.col("p_partkey") % 2 == 0, "1").otherwise("2").alias("chrom"), (F.col("p_partkey") * 10).alias("pos"), F.lit("A").alias("ref"), F.when(F.col("p_size") % 3 == 1, "G").otherwise("T").alias("alt"), F.col("p_size").alias("gt"))
    return genotypes.attached(placed(s, f), p)


def extract_list(s: SparkSession, f: str) -> DataFrame:
    from dropletry.sources.variants import extracted

    rows = placed(s, f).withColumn("alts", F.array("alt")).drop("alt")
    keys = placed(s, f).where("snp_id % 3 = 0").withColumn("alt", F.when(F.col("snp_id") % 2 == 0, "G").otherwise("C")).drop("snp_id")
    return extracted(rows, keys).select("snp_id")


# ---- Droplets ----
def pileup_valid_droplets(s: SparkSession, f: str) -> DataFrame:
    rows = sc.unique(s, f)
    valid = pileup.passing_cells(pileup.cell_counters(rows), min_read=10, min_umi=4, min_snp=20).select("cell_id")
    return rows.join(valid, "cell_id", "left_semi").groupBy("cell_id").agg(F.count("*").alias("n_obs"))


def droplet_filter_call(s: SparkSession, f: str) -> DataFrame:
    cells = pileup.passing_cells(pileup.cell_counters(sc.unique(s, f)), min_read=10, min_umi=4, min_snp=1)
    return demux.calls(demux.best_and_next(sc.pairs(s, f))).join(cells.select("cell_id"), "cell_id", "left_semi").groupBy("type").agg(F.count("*").alias("n"))


def read_classes(s: SparkSession, f: str) -> DataFrame:
    """Reads by what they add to the pileup: the first of a UMI at a variant is new, later ones redundant."""
    order = Window.partitionBy("snp_id", "cell_id", "umi").orderBy(*ORDER, "allele", "bq")
    low, other = F.col("bq") < 13, F.col("allele") == 2
    seen = observations(s, f).withColumn("first", F.row_number().over(order) == 1)
    one = seen.groupBy("l_orderkey").agg(F.count_if(~low & ~other & F.col("first")).alias("a"), F.count_if(~low & ~other & ~F.col("first")).alias("b"), F.count_if(low).alias("c"), F.count_if(~low & other).alias("d"))
    return one.groupBy(reads.read_class(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("class")).agg(F.count("*").alias("n"))


def initial_clusters(s: SparkSession, f: str) -> DataFrame:
    cells = table(s, f, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_name").alias("barcode"))
    listed = table(s, f, "supplier").where("s_nationkey % 3 <> 0").select(F.col("s_name").alias("barcode"), (F.col("s_nationkey") % 5 - 1).alias("cluster"))
    return clusters.initial_clusters(cells, listed).groupBy("cluster").agg(F.count("*").alias("n"))


def first_fraction(s: SparkSession, f: str) -> DataFrame:
    return clusters.first_share(likelihood.ranked(sc.singlet_score(s, f)).select("cell_id", "rank"), 0.3)


def random_order(s: SparkSession, f: str) -> DataFrame:
    return clusters.shuffled(table(s, f, "supplier").select("s_suppkey"), "s_suppkey", 11)


def mux_pileup(s: SparkSession, f: str) -> DataFrame:
    """The pileup over variants that the donors call often enough, with the donors' mean frequency."""
    kept = genotypes.passing_variants(genotypes.allele_counts(donor_calls(s, f)), 2, 0.8).select("snp_id")
    gp = genotypes.call_posterior(F.col("gt"), F.col("af"), 0.01)
    mean = donor_calls(s, f).groupBy("snp_id").agg(F.avg((gp[1] + 2 * gp[2]) / 2).alias("mean_af"))
    rows = sc.unique(s, f).join(kept, "snp_id", "left_semi").groupBy("snp_id").agg(F.count("*").alias("n_obs"), F.count_if(F.col("allele") == 1).alias("n_alt"))
    return r6(rows.join(mean, "snp_id"), "mean_af")


def chunk_rebuild(s: SparkSession, f: str) -> DataFrame:
    """The pileup rebuilt chunk by chunk: barcodes are dealt to chunks by hash, so none is in two."""
    rows = observations(s, f).withColumn("chunk", expression.chunk_of(F.col("cell_id").cast("string"), 16))
    unique = pileup.dedup_umis(rows, ["chunk", *ORDER]).withColumn("chunk", expression.chunk_of(F.col("cell_id").cast("string"), 16))
    return unique.groupBy("chunk").agg(F.count_distinct("cell_id").alias("n_cell"), F.count("*").alias("n_umi"), F.sum("n_dup").alias("n_read"))


# ---- Contigs and annotation ----
def contig_reconcile(s: SparkSession, f: str) -> DataFrame:
    ours = table(s, f, "nation").select(F.col("n_name").alias("chrom"), F.col("n_nationkey").cast("long").alias("at"))
    theirs = table(s, f, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("chrom"), (F.col("n_nationkey") * 10 + F.when(F.col("n_nationkey") == 9, 25).otherwise(0)).cast("long").alias("at"))
    return intervals.shared_contigs(ours, theirs)


def file_chunks(s: SparkSession, f: str) -> DataFrame:
    contigs = table(s, f, "nation").select(F.col("n_name").alias("chrom"), (F.col("n_nationkey").cast("long") * 700 + 500).alias("length"))
    return intervals.chunked_paths(contigs, "/data/{CHR}/{BEG}_{END}.vcf.gz", 1000)


def overlap_bases(s: SparkSession, f: str) -> DataFrame:
    points = counting.segments(s, f)
    hits = intervals.range_join(points, counting.genes(s, f), 64, ["chrom", "strand"])
    return hits.groupBy("element").agg(F.sum(intervals.overlap_bases(F.col("a_beg"), F.col("a_end"), F.col("b_beg"), F.col("b_end"))).cast("long").alias("bases"))


def region_intersection(s: SparkSession, f: str) -> DataFrame:
    return intervals.within_region(counting.spans(s, f), "2-HIGH", 100_000, 500_000).groupBy("beg", "end").agg(F.count("*").alias("n"))


def exons(s: SparkSession, f: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exons, transcripts and genes: a part is an exon, its brand and size a transcript, its brand a gene."""
    chrom = F.when(F.col("p_partkey") % 3 == 0, "R").when(F.col("p_partkey") % 3 == 1, "A").otherwise("N")
    e = counting.genes(s, f).join(table(s, f, "part").select(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("element"), F.concat_ws("-", "p_brand", F.col("p_size").cast("string"), chrom).alias("transcript_id"), F.concat_ws("-", "p_brand", chrom).alias("gene_id")), "element")
    e = e.select(F.col("element").alias("exon_id"), "transcript_id", "gene_id", "chrom", "strand", "b_beg", "b_end")
    t = e.groupBy("transcript_id", "gene_id").agg(F.min("chrom").alias("chrom"), F.min("strand").alias("strand"))
    g = t.groupBy("gene_id").agg(F.min("chrom").alias("chrom"), F.min("strand").alias("strand"))
    return e, t, g


def element_levels(s: SparkSession, f: str) -> DataFrame:
    e, t, g = exons(s, f)
    rows = expression.with_parents(e.drop("gene_id"), t, g)
    return expression.level_counts(intervals.range_join(counting.segments(s, f), rows, 64, ["chrom", "strand"]))


def transcript_sanity(s: SparkSession, f: str) -> DataFrame:
    e, t, g = exons(s, f)
    return expression.with_parents(e.drop("gene_id"), t, g).groupBy("gene_id").agg(F.count("*").alias("n_exon"))


def max_feature_lengths(s: SparkSession, f: str) -> DataFrame:
    rows = table(s, f, "part").select(F.col("p_type").alias("feature"), F.col("p_partkey").alias("beg"), (F.col("p_partkey") + F.col("p_size") * 3).alias("end"))
    return expression.longest(rows)


def genepred(s: SparkSession, f: str) -> DataFrame:
    from dropletry.sources.tables import gene_predictions

    rows = table(s, f, "part").select(
        F.concat_ws("-", "p_brand", "p_size").alias("transcript_id"), F.col("p_brand").alias("gene_id"), F.lit("1").alias("chrom"), F.lit("+").alias("strand"), F.when(F.col("p_partkey") % 3 == 0, "CDS").otherwise("exon").alias("feature"),
        (F.col("p_partkey") * 10).alias("beg"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("end"),
    )
    return gene_predictions(rows)


def gtf_summary(s: SparkSession, f: str) -> DataFrame:
    e, t, g = exons(s, f)
    rows = e.groupBy("transcript_id").agg(F.count("*").alias("n_exon"), F.sum(F.col("b_end") - F.col("b_beg") + 1).cast("long").alias("bases")).join(t, "transcript_id")
    return rows.groupBy("gene_id").agg(F.count("*").alias("n_transcript"), F.sum("n_exon").cast("long").alias("n_exon"), F.max("bases").alias("longest"))


def cds_exon_pairs(s: SparkSession, f: str) -> DataFrame:
    """Coding stretches with the exon of their transcript that holds them."""
    rows = table(s, f, "part")
    cds = rows.select(F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("cds"), (F.col("p_partkey") * 10 + 2).alias("a_beg"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("a_end"))
    exon = rows.select(F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("exon"), (F.col("p_partkey") * 10).alias("b_beg"), (F.col("p_partkey") * 10 + 30).alias("b_end"))
    return intervals.range_join(cds.where("a_beg <= a_end"), exon, 64, contained=True).select("cds", "exon")


# ---- Counts ----
def gene_counts(s: SparkSession, f: str) -> DataFrame:
    return table(s, f, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), F.concat(F.lit("g"), F.col("l_partkey") % 60).alias("gene")).agg(F.count("*").alias("n"))


def gene_collapse(s: SparkSession, f: str) -> DataFrame:
    return expression.collapsed(gene_counts(s, f), 8, 3)


def matrix_sums(s: SparkSession, f: str) -> DataFrame:
    return expression.frequent_genes(gene_counts(s, f), 100)


def tx_annotated_share(s: SparkSession, f: str) -> DataFrame:
    tx = F.concat(F.when(F.col("l_partkey") % 3 == 0, "ENST").otherwise("X"), F.col("l_partkey") % 50)
    rows = table(s, f, "lineitem").select((F.col("l_suppkey") % 10).alias("cell_id"), tx.alias("tx"), (F.col("l_orderkey") % 100).alias("umi"))
    return r6(expression.annotated_share(rows), "share")


def gibbs_sweep(s: SparkSession, f: str) -> DataFrame:
    rows = table(s, f, "supplier").select(F.col("s_suppkey").alias("cell_id"), *((F.col("s_acctbal") * j % 3 / F.lit(2.0)).alias(f"x{j}") for j in range(3)))
    return expression.gibbs_sweep(rows, 3, 5)


def louvain_levels(s: SparkSession, f: str) -> DataFrame:
    line, order = table(s, f, "lineitem"), table(s, f, "orders")
    rows = line.join(order, line.l_orderkey == order.o_orderkey).join(table(s, f, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, f, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = rows.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("w"))
    return clusters.next_level(edges, table(s, f, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") % 6).alias("community")))


def cluster_vcf_all(s: SparkSession, f: str) -> DataFrame:
    return clusters.genotype_fields(clusters.merged(sc.likelihoods(s, f), sc.seeded(s, f)), variants(s, f))


QUERIES = {
    "doublet_gl": doublet_gl, "gl3_pileup": gl3_pileup, "demux_unspecified": demux_unspecified, "demux_table": demux_table, "pair_distance": pair_distance, "vote_by_distance": vote_by_distance,
    "pileup_removed": pileup_removed, "merge_in_order": merge_in_order, "pl_posterior": pl_posterior, "dosage_af": dosage_af, "variant_limits": variant_limits, "strict_biallelic": strict_biallelic,
    "genotype_masking": genotype_masking, "genotype_left_join": genotype_left_join, "extract_list": extract_list, "pileup_valid_droplets": pileup_valid_droplets, "droplet_filter_call": droplet_filter_call,
    "read_classes": read_classes, "initial_clusters": initial_clusters, "first_fraction": first_fraction, "random_order": random_order, "mux_pileup": mux_pileup, "chunk_rebuild": chunk_rebuild,
    "contig_reconcile": contig_reconcile, "file_chunks": file_chunks, "overlap_bases": overlap_bases, "region_intersection": region_intersection, "element_levels": element_levels,
    "transcript_sanity": transcript_sanity, "max_feature_lengths": max_feature_lengths, "genepred": genepred, "gtf_summary": gtf_summary, "cds_exon_pairs": cds_exon_pairs, "gene_collapse": gene_collapse,
    "matrix_sums": matrix_sums, "tx_annotated_share": tx_annotated_share, "gibbs_sweep": gibbs_sweep, "louvain_levels": louvain_levels, "cluster_vcf_all": cluster_vcf_all,
}

# ---- The same in SQL ----
_P = sc._P
_STATES = sc._STATES
_plus = sc._plus
_UNIQ = sc.UNIQUE
_G = ", ".join(f"round(g{k}, 6) AS g{k}" for k in range(9))


def _dbl() -> str:
    s = ", ".join(f"sum(ln((1-e) * (CASE WHEN allele = 0 THEN {1 - (a * 0.7 + b * 0.3) / 2!r}e0 ELSE {(a * 0.7 + b * 0.3) / 2!r}e0 END) + e/4)) AS s{k}" for k, (a, b) in enumerate(_STATES))
    top = "greatest(" + ", ".join(f"s{k}" for k in range(9)) + ")"
    e = ", ".join(f"exp(s{k} - {top}) AS e{k}" for k in range(9))
    h = ", ".join(f"greatest(e{k} / ({_plus([f'e{i}' for i in range(9)])}), 1e-6) AS h{k}" for k in range(9))
    g = ", ".join(f"round(h{k} / ({_plus([f'h{i}' for i in range(9)])}), 6) AS g{k}" for k in range(9))
    return f"WITH {_UNIQ}, gs AS (SELECT cell_id, snp_id, count(*) AS n_obs, {s} FROM (SELECT *, {sc._E} AS e FROM uniq) GROUP BY 1, 2), ge AS (SELECT cell_id, snp_id, n_obs, {e} FROM gs), gh AS (SELECT cell_id, snp_id, n_obs, {h} FROM ge) SELECT cell_id, snp_id, n_obs, {g} FROM gh"


_GL3 = f"""WITH {_UNIQ}, x AS (SELECT *, {sc._E} AS e FROM uniq), t AS (SELECT cell_id, snp_id, count(*) AS n_obs, coalesce(sum(ln(CASE WHEN allele = 0 THEN 1 - e ELSE e / 3 END)) FILTER (allele <= 1), 0) AS s0,
  coalesce(sum(ln(0.5e0 - e / 3)) FILTER (allele <= 1), 0) AS s1, coalesce(sum(ln(CASE WHEN allele = 1 THEN 1 - e ELSE e / 3 END)) FILTER (allele <= 1), 0) AS s2 FROM x GROUP BY 1, 2),
  e AS (SELECT cell_id, snp_id, n_obs, exp(s0 - greatest(s0, s1, s2)) AS e0, exp(s1 - greatest(s0, s1, s2)) AS e1, exp(s2 - greatest(s0, s1, s2)) AS e2 FROM t),
  h AS (SELECT cell_id, snp_id, n_obs, greatest(e0 / (e0 + e1 + e2), 1e-6) AS h0, greatest(e1 / (e0 + e1 + e2), 1e-6) AS h1, greatest(e2 / (e0 + e1 + e2), 1e-6) AS h2 FROM e)
  SELECT cell_id, snp_id, n_obs, round(h0 / (h0 + h1 + h2), 6) AS g0, round(h1 / (h0 + h1 + h2), 6) AS g1, round(h2 / (h0 + h1 + h2), 6) AS g2 FROM h"""
_MEAN = ", ".join("(" + _plus([f"p{j}_{g}" for j in range(DONORS)]) + f") / {DONORS} AS u{g}" for g in range(3))
_UNSPEC = f"WITH {sc._demux()}, m AS (SELECT *, {_MEAN} FROM mix JOIN gps USING (snp_id)) SELECT cell_id, round(sum(ln({_plus([f'u{a} * u{b} * m1_{a}{b}' for a, b in _STATES])})), 6) AS llk0, " + ", ".join(f"round(sum(ln({_plus([f'p{j}_{a} * u{b} * m1_{a}{b}' for a, b in _STATES])})), 6) AS llk_{j}" for j in range(DONORS)) + " FROM m GROUP BY 1"
_POST = f", x AS (SELECT cell_id, n, llk + CASE WHEN n = 0 THEN {sc._SINGLE!r}e0 ELSE {sc._PAIR!r}e0 END AS x FROM llks WHERE n = 0 OR j > k), t AS (SELECT cell_id, max(x) AS top, max(CASE WHEN n = 0 THEN x END) AS best FROM x GROUP BY 1), post AS (SELECT cell_id, round(sum(CASE WHEN n = 0 THEN exp(x - top) END) / sum(exp(x - top)), 6) AS sng_posterior, round(exp(max(t.best) - max(top)) / sum(CASE WHEN n = 0 THEN exp(x - top) END), 6) AS sng_only_posterior FROM x JOIN t USING (cell_id) GROUP BY 1)"
_TABLE = f"""WITH {sc._demux()} {sc._BEST} {_POST}, cnt AS (SELECT cell_id, count(DISTINCT snp_id) AS n_snp, CAST(sum(n_dup) AS BIGINT) AS n_read FROM uniq GROUP BY 1), named AS ({sc._CALLS.split(',', 1)[1].strip().replace('typed AS', 'WITH typed AS', 1)})
  SELECT cell_id, n_snp, n_read, type, best_guess, best_llk, next_guess, next_llk, round(CASE WHEN type = 'DBL' THEN dbl_best_llk ELSE sng_best_llk END - CASE WHEN type = 'DBL' THEN (CASE WHEN dbl_next_llk > sng_best_llk + 2 THEN dbl_next_llk ELSE sng_best_llk END) ELSE (CASE WHEN dbl_best_llk > sng_next_llk + 2 THEN dbl_best_llk ELSE sng_next_llk END) END, 6) AS llk_difference,
    sng_posterior, sng_only_posterior, sng_best, round(sng_best_llk, 6) AS sng_best_llk, sng_next, round(sng_next_llk, 6) AS sng_next_llk, dbl_best || ',' || dbl_best2 AS dbl_guess, round(dbl_best_llk, 6) AS dbl_best_llk, round(sng_best_llk - dbl_best_llk, 6) AS sng_minus_dbl
  FROM cnt JOIN named USING (cell_id) JOIN post USING (cell_id) JOIN best USING (cell_id)"""
_SAME = _plus([f"a.g{4 * g} * b.g{4 * g} * {_P[g]}" for g in range(3)])
_APART = _plus([f"a.g{4 * x} * b.g{4 * y} * {_P[x]} * {_P[y]}" for x in range(3) for y in range(3)])
_DIST = f"{sc._gl()}, {sc.SNPS}, few AS MATERIALIZED (SELECT * FROM gl), dist AS (SELECT a.cell_id, b.cell_id AS other_id, count(*) AS n_snp, round(sum(ln({_APART})), 6) AS llk0, round(sum(ln({_SAME})), 6) AS llk2 FROM few a JOIN few b ON a.snp_id = b.snp_id AND a.cell_id > b.cell_id JOIN snps ON snps.snp_id = a.snp_id GROUP BY 1, 2)"


def _removed() -> str:
    some = sc._gl("uniq AS (SELECT * FROM uniq0 WHERE umi = 0)").split(", gs AS", 1)[1]
    for x in ("gs", "ge", "gh", "gl"):
        some = some.replace(f" {x} AS ", f" o{x} AS ").replace(f"FROM {x})", f"FROM o{x})")
    some = ("gs AS" + some).replace("gs AS", "ogs AS", 1).replace("FROM uniq)", "FROM uniq WHERE umi = 0)")
    h = ", ".join(f"greatest((gl.g{k} / ogl.g{k}) / ({_plus([f'gl.g{i} / ogl.g{i}' for i in range(9)])}), 1e-6) AS h{k}" for k in range(9))
    g = ", ".join(f"round(CASE WHEN m_obs IS NULL THEN g{k} ELSE h{k} / ({_plus([f'h{i}' for i in range(9)])}) END, 6) AS g{k}" for k in range(9))
    return f"WITH {sc._gl()}, {some}, z AS (SELECT gl.*, ogl.n_obs AS m_obs, {h} FROM gl LEFT JOIN ogl USING (cell_id, snp_id)) SELECT cell_id, snp_id, n_obs - coalesce(m_obs, 0) AS n_obs, {g} FROM z"


def _ordered() -> str:
    step = ", ".join(f"h{k} / ({_plus([f'h{i}' for i in range(9)])}) AS w{k}" for k in range(9))
    raw = ", ".join(f"greatest(w{k} * g{k} / ({_plus([f'w{i} * g{i}' for i in range(9)])}), 1e-6) AS h{k}" for k in range(9))
    first = ", ".join(f"greatest(g{k} / ({_plus([f'g{i}' for i in range(9)])}), 1e-6) AS h{k}" for k in range(9))
    out = ", ".join(f"round(w{k}, 6) AS g{k}" for k in range(9))
    names = ", ".join(f"w{k}" for k in range(9))
    return f"""WITH RECURSIVE {sc._gl()}, o AS MATERIALIZED (SELECT s_suppkey % 3 AS cluster, snp_id, row_number() OVER (PARTITION BY s_suppkey % 3, snp_id ORDER BY s_suppkey) AS r, count(*) OVER (PARTITION BY s_suppkey % 3, snp_id) AS n, {', '.join(f'g{k}' for k in range(9))} FROM gl JOIN supplier ON cell_id = s_suppkey),
      w(cluster, snp_id, r, {names}) AS (SELECT cluster, snp_id, r, {step} FROM (SELECT *, {first} FROM o WHERE r = 1) UNION ALL SELECT cluster, snp_id, r, {step} FROM (SELECT o.cluster, o.snp_id, o.r, {raw} FROM w JOIN o ON w.cluster = o.cluster AND w.snp_id = o.snp_id AND o.r = w.r + 1))
      SELECT CAST(w.cluster AS INTEGER) AS cluster, w.snp_id, o.n AS n_cell, {out} FROM w JOIN o ON o.cluster = w.cluster AND o.snp_id = w.snp_id AND o.r = w.r WHERE w.r = o.n"""


def _pl() -> str:
    pl = ["(snp_id * 7 + donor * 11) % 40", "(snp_id * 3 + donor * 5) % 30", "(snp_id + donor * 13) % 50"]
    rounds = ["lik AS MATERIALIZED (SELECT snp_id, donor, " + ", ".join(f"CASE WHEN gt IS NULL THEN 1e0 ELSE pow(10, -({x}) / 10e0) END AS l{g}" for g, x in enumerate(pl)) + " FROM calls)", "em0 AS (SELECT DISTINCT snp_id, 0.5e0 AS af FROM lik)"]
    w = [f"l{g} * {_P[g]}" for g in range(3)]
    for k in range(10):
        rounds.append(f"em{k + 1} AS MATERIALIZED (SELECT snp_id, sum(({w[1]} + 2 * ({w[2]})) / ({_plus(w)})) / (2 * count(*)) AS af FROM lik JOIN em{k} USING (snp_id) GROUP BY 1)")
    return f"WITH {sc.CALLS}, {', '.join(rounds)} SELECT snp_id, donor, round(af, 6) AS af, " + ", ".join(f"round({w[g]} / ({_plus(w)}), 6) AS p{g}" for g in range(3)) + " FROM lik JOIN em10 USING (snp_id)"


_REC = f"""{sc.CALLS}, c AS (SELECT snp_id, count(*) AS n_sample, 2 * count(gt) AS an, CAST(coalesce(sum(gt), 0) AS BIGINT) AS ac FROM calls GROUP BY 1),
  rec AS (SELECT p_partkey AS snp_id, CASE WHEN p_size % 9 <> 0 THEN p_size END AS qual, substr('ACGTA', p_partkey % 4 + 1, CASE WHEN p_partkey % 3 = 2 THEN 2 ELSE 1 END) AS ref, substr('ACGTA', p_size % 4 + 1, CASE WHEN p_size % 3 = 2 THEN 2 ELSE 1 END) AS alt, p_size % 3 + 2 AS n_allele, p_partkey % 3 AS flt, n_sample, an, ac FROM part JOIN c ON p_partkey = snp_id)"""
_EX = counting._CHROM.format("p_partkey")
_EXONS = f"""{counting._SEGMENTS.split('hit AS', 1)[0]} e AS (SELECT p_brand || '-' || p_partkey AS exon_id, p_brand || '-' || p_size || '-' || {_EX} AS transcript_id, p_brand || '-' || {_EX} AS gene_id, {_EX} AS chrom, CASE WHEN p_size % 2 = 0 THEN 'O' ELSE 'F' END AS strand, p_partkey * 10 AS b_beg, p_partkey * 10 + p_size AS b_end FROM part),
  t AS (SELECT transcript_id, gene_id, min(chrom) AS chrom, min(strand) AS strand FROM e GROUP BY 1, 2), g AS (SELECT gene_id, min(chrom) AS chrom, min(strand) AS strand FROM t GROUP BY 1),
  ok AS (SELECT transcript_id, gene_id FROM t JOIN g USING (gene_id, chrom, strand)), x AS (SELECT e.exon_id, e.transcript_id, ok.gene_id, e.chrom, e.strand, b_beg, b_end FROM e JOIN ok USING (transcript_id))"""
_COUNTS = "c AS (SELECT l_suppkey AS cell_id, 'g' || (l_partkey % 60) AS gene, count(*) AS n FROM lineitem GROUP BY 1, 2)"
_HASH = counting._HASH
_U = f"({_HASH.format('CAST(s_suppkey AS VARCHAR)', 5)} + 0.5e0) / 4294967296"
_PLACED = "v AS (SELECT p_partkey AS snp_id, CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '2' END AS chrom, p_partkey * 10 AS pos, p_size FROM part)"
ORACLE_SQL = {
    "doublet_gl": _dbl(), "gl3_pileup": _GL3, "demux_unspecified": _UNSPEC, "demux_table": _TABLE, "pair_distance": f"WITH {_DIST} SELECT * FROM dist",
    "vote_by_distance": f"WITH {_DIST}, b AS (SELECT cell_id, other_id, CASE WHEN llk2 > llk0 THEN 1 ELSE -1 END AS vote FROM dist UNION ALL SELECT other_id, cell_id, CASE WHEN llk2 > llk0 THEN 1 ELSE -1 END FROM dist), v AS (SELECT cell_id, CAST(other_id % 3 AS INTEGER) AS cluster, CAST(sum(vote) AS BIGINT) AS votes FROM b GROUP BY 1, 2) SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY votes DESC, cluster) = 1",
    "pileup_removed": _removed(), "merge_in_order": _ordered(), "pl_posterior": _pl(),
    "dosage_af": f"WITH {sc.CALLS}, d AS (SELECT snp_id, CASE WHEN gt IS NOT NULL THEN gt * 0.75e0 + donor / 8e0 END AS ds FROM calls) SELECT snp_id, count(*) AS n_sample, 2 * count(ds) AS an, round(coalesce(sum(ds), 0), 6) AS ac, round(CASE WHEN count(ds) > 0 THEN sum(ds) / (2 * count(ds)) END, 6) AS af FROM d GROUP BY 1",
    "variant_limits": f"WITH {_REC}, q AS (SELECT *, (ac + 5e-11) / (an + 1e-10) AS af FROM rec) SELECT snp_id, ac, an FROM q WHERE flt < 2 AND qual >= 5 AND n_allele <= 3 AND len(ref) = 1 AND len(alt) = 1 AND an / (2 * n_sample) >= 0.8e0 AND ac BETWEEN 1 AND 8 AND least(ac, an - ac) BETWEEN 1 AND 4 AND af BETWEEN 0.1e0 AND 0.9e0 AND least(af, 1 - af) BETWEEN 0.05e0 AND 0.5e0",
    "strict_biallelic": f"WITH {_REC} SELECT false AS strict, ref[1] AS ref, alt[1] AS alt, count(*) AS n FROM rec GROUP BY 2, 3 UNION ALL SELECT true, ref, alt, count(*) FROM rec WHERE n_allele = 2 AND len(ref) = 1 AND len(alt) = 1 GROUP BY 2, 3",
    "genotype_masking": f"WITH {sc.CALLS} SELECT snp_id, donor, CASE WHEN snp_id % 8 <> 0 AND (snp_id + donor) % 20 >= 5 AND (snp_id * 3 + donor) % 50 >= 10 THEN gt END AS gt FROM calls",
    "genotype_left_join": f"WITH {_PLACED} SELECT snp_id, chrom, pos, 'A' AS ref, 'G' AS alt, CASE WHEN p_size % 3 = 1 THEN p_size END AS gt FROM v",
    "extract_list": f"WITH {_PLACED} SELECT snp_id FROM v WHERE snp_id % 3 = 0 AND snp_id % 2 = 0",
    "pileup_valid_droplets": f"WITH {_UNIQ} SELECT cell_id, count(*) AS n_obs FROM uniq GROUP BY 1 HAVING sum(n_dup) >= 10 AND count(DISTINCT umi) >= 4 AND count(DISTINCT snp_id) >= 20",
    "droplet_filter_call": f"WITH {sc._demux()} {sc._BEST}, ok AS (SELECT cell_id FROM uniq GROUP BY 1 HAVING sum(n_dup) >= 10 AND count(DISTINCT umi) >= 4) SELECT CASE WHEN dbl_best_llk > sng_best_llk + 2 THEN 'DBL' WHEN sng_best_llk > sng_next_llk + 2 THEN 'SNG' ELSE 'AMB' END AS type, count(*) AS n FROM best JOIN ok USING (cell_id) GROUP BY 1",
    "read_classes": f"WITH {OBS}, o AS (SELECT *, row_number() OVER (PARTITION BY snp_id, cell_id, umi ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, allele, bq) = 1 AS f FROM obs), one AS (SELECT l_orderkey, count(*) FILTER (bq >= 13 AND allele < 2 AND f) AS a, count(*) FILTER (bq >= 13 AND allele < 2 AND NOT f) AS b, count(*) FILTER (bq < 13) AS c, count(*) FILTER (bq >= 13 AND allele = 2) AS d FROM o GROUP BY 1) SELECT CASE WHEN a > 1 THEN 'MULTI' WHEN a = 1 THEN 'PASS' WHEN b > 0 THEN 'REDUNDANT' WHEN c > 0 THEN 'LOWQUAL' WHEN d > 0 THEN 'N' ELSE 'NONE' END AS class, count(*) AS n FROM one GROUP BY 1",
    "initial_clusters": "SELECT CASE WHEN s_nationkey % 3 <> 0 AND s_nationkey % 5 > 0 THEN s_nationkey % 5 - 1 END AS cluster, count(*) AS n FROM supplier GROUP BY 1",
    "first_fraction": f"WITH {sc._SCORES}, rows AS ({sc._SCORE_ROWS}), k AS (SELECT cell_id, CAST(row_number() OVER (ORDER BY score DESC, cell_id DESC) AS INTEGER) AS rank FROM rows) SELECT cell_id, rank FROM k WHERE rank - 1 <= (SELECT count(*) FROM k) * 0.3e0",
    "random_order": f"SELECT s_suppkey, row_number() OVER (ORDER BY {_HASH.format('CAST(s_suppkey AS VARCHAR)', 11)}, s_suppkey) - 1 AS at FROM supplier",
    "mux_pileup": f"WITH {_UNIQ}, {sc.CALLS}, c AS (SELECT snp_id, count(*) AS n_sample, 2 * count(gt) AS an, coalesce(sum(gt), 0) AS ac FROM calls GROUP BY 1 HAVING least(coalesce(sum(gt), 0), 2 * count(gt) - coalesce(sum(gt), 0)) >= 2 AND count(gt) / count(*) >= 0.8e0), m AS (SELECT snp_id, avg((CASE WHEN gt IS NULL THEN {_P[1]} WHEN gt = 1 THEN 0.99e0 ELSE 0.005e0 END + 2 * CASE WHEN gt IS NULL THEN {_P[2]} WHEN gt = 2 THEN 0.99e0 ELSE 0.005e0 END) / 2) AS mean_af FROM calls GROUP BY 1) SELECT snp_id, count(*) AS n_obs, count(*) FILTER (allele = 1) AS n_alt, round(max(mean_af), 6) AS mean_af FROM uniq JOIN c USING (snp_id) JOIN m USING (snp_id) GROUP BY 1",
    "chunk_rebuild": f"WITH {_UNIQ} SELECT {_HASH.format('CAST(cell_id AS VARCHAR)', 0x811C9DC5)} % 16 AS chunk, count(DISTINCT cell_id) AS n_cell, count(*) AS n_umi, CAST(sum(n_dup) AS BIGINT) AS n_read FROM uniq GROUP BY 1",
    "contig_reconcile": "WITH b AS (SELECT n_name AS chrom, CAST(n_nationkey AS BIGINT) AS read_at, CAST(n_nationkey * 10 + CASE WHEN n_nationkey = 9 THEN 25 ELSE 0 END AS BIGINT) AS variant_at FROM nation WHERE n_nationkey % 4 <> 0) SELECT chrom, read_at, variant_at, coalesce(max(variant_at) OVER (ORDER BY read_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < variant_at, true) AS in_order FROM b",
    "file_chunks": "WITH c AS (SELECT n_name AS chrom, CAST(n_nationkey * 700 + 500 AS BIGINT) AS length FROM nation), u AS (SELECT chrom, length, unnest(range(1, length + 1, 1000)) AS beg FROM c) SELECT chrom, beg, least(beg + 999, length) AS \"end\", '/data/' || chrom || '/' || beg || '_' || least(beg + 999, length) || '.vcf.gz' AS path FROM u",
    "overlap_bases": f"WITH {counting._SEGMENTS} SELECT element, CAST(sum(least(a_end, b_end) - greatest(a_beg, b_beg) + 1) AS BIGINT) AS bases FROM hit GROUP BY 1",
    "region_intersection": f"WITH {counting._SPANS.replace('SELECT DISTINCT', 'SELECT')} SELECT greatest(beg, 100000) AS beg, least(\"end\", 500000) AS \"end\", count(*) AS n FROM iv WHERE chrom = '2-HIGH' AND beg <= 500000 AND \"end\" >= 100000 GROUP BY 1, 2",
    "element_levels": f"WITH {_EXONS}, hx AS MATERIALIZED (SELECT cell_id, umi, exon_id, transcript_id, gene_id FROM seg JOIN x USING (chrom, strand) WHERE a_beg <= b_end AND b_beg <= a_end), l AS (SELECT 'exon' AS level, exon_id AS element, cell_id, umi FROM hx UNION SELECT 'transcript', transcript_id, cell_id, umi FROM hx UNION SELECT 'gene', gene_id, cell_id, umi FROM hx) SELECT level, element, cell_id, count(*) AS n_umi FROM l GROUP BY 1, 2, 3",
    "transcript_sanity": f"WITH {_EXONS} SELECT gene_id, count(*) AS n_exon FROM x GROUP BY 1",
    "max_feature_lengths": "SELECT p_type AS feature, CAST(max(p_size * 3 + 1) AS BIGINT) AS longest FROM part GROUP BY 1",
    "genepred": "WITH x AS (SELECT p_brand || '-' || p_size AS transcript_id, p_brand AS gene_id, CASE WHEN p_partkey % 3 = 0 THEN 'CDS' ELSE 'exon' END AS feature, p_partkey * 10 AS beg, p_partkey * 10 + p_size AS e FROM part) SELECT transcript_id, min(gene_id) AS gene_id, '1' AS chrom, '+' AS strand, min(beg) - 1 AS tx_beg, max(e) AS tx_end, coalesce(min(beg) FILTER (feature = 'CDS') - 1, max(e)) AS cds_beg, coalesce(max(e) FILTER (feature = 'CDS'), max(e)) AS cds_end, count(*) FILTER (feature = 'exon') AS n_exon, coalesce(string_agg((beg - 1)::VARCHAR || ',', '' ORDER BY beg, e) FILTER (feature = 'exon'), '') AS exon_begs, coalesce(string_agg(e::VARCHAR || ',', '' ORDER BY beg, e) FILTER (feature = 'exon'), '') AS exon_ends FROM x GROUP BY 1",
    "gtf_summary": f"WITH {_EXONS}, q AS (SELECT transcript_id, count(*) AS n_exon, sum(b_end - b_beg + 1) AS bases FROM e GROUP BY 1) SELECT gene_id, count(*) AS n_transcript, CAST(sum(n_exon) AS BIGINT) AS n_exon, CAST(max(bases) AS BIGINT) AS longest FROM q JOIN t USING (transcript_id) GROUP BY 1",
    "cds_exon_pairs": "SELECT a.p_partkey AS cds, b.p_partkey AS exon FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size >= 2 AND b.p_partkey * 10 <= a.p_partkey * 10 + 2 AND a.p_partkey * 10 + a.p_size <= b.p_partkey * 10 + 30",
    "gene_collapse": f"WITH {_COUNTS} SELECT {_HASH.format('gene', 3)} % 8 AS \"group\", cell_id, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2",
    "matrix_sums": f"WITH {_COUNTS}, k AS (SELECT *, CAST(sum(n) OVER (PARTITION BY gene) AS BIGINT) AS gene_total FROM c), w AS (SELECT * FROM k WHERE gene_total >= 100) SELECT *, CAST(sum(n) OVER (PARTITION BY cell_id) AS BIGINT) AS cell_total FROM w",
    "tx_annotated_share": "WITH u AS (SELECT DISTINCT l_suppkey % 10 AS cell_id, CASE WHEN l_partkey % 3 = 0 THEN 'ENST' ELSE 'X' END || (l_partkey % 50) AS tx, l_orderkey % 100 AS umi FROM lineitem) SELECT cell_id, count(*) AS n_umi, count(*) FILTER (starts_with(tx, 'ENST')) AS n_annotated, round(count(*) FILTER (starts_with(tx, 'ENST')) / count(*), 6) AS share FROM u GROUP BY 1",
    "gibbs_sweep": f"WITH x AS (SELECT s_suppkey AS cell_id, {_U} AS u, " + ", ".join(f"(s_acctbal * {j}) % 3 / 2e0 AS x{j}" for j in range(3)) + " FROM supplier), e AS (SELECT cell_id, u, " + ", ".join(f"exp(x{j} - greatest(x0, x1, x2)) AS e{j}" for j in range(3)) + " FROM x) SELECT cell_id, CAST(CASE WHEN u * (e0 + e1 + e2) >= e0 THEN 1 ELSE 0 END + CASE WHEN u * (e0 + e1 + e2) >= e0 + e1 THEN 1 ELSE 0 END AS INTEGER) AS drawn FROM e",
    "louvain_levels": "WITH e AS (SELECT c_nationkey % 6 AS a, s_nationkey % 6 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) SELECT least(a, b) AS src, greatest(a, b) AS dst, CAST(count(*) AS DOUBLE) AS w FROM e GROUP BY 1, 2",
    "cluster_vcf_all": f"WITH {sc._MERGED}, p AS (SELECT *, c0 * {_P[0]} AS q0, c1 * {_P[1]} AS q1, c2 * {_P[2]} AS q2 FROM merged JOIN snps USING (snp_id)), n AS (SELECT *, q0 / (q0+q1+q2) AS p0, q1 / (q0+q1+q2) AS p1, q2 / (q0+q1+q2) AS p2 FROM p) SELECT cluster, snp_id, n_cell, CASE WHEN p0 = greatest(p0, p1, p2) THEN '0/0' WHEN p1 = greatest(p0, p1, p2) THEN '0/1' ELSE '1/1' END AS gt, least(255, CAST(trunc(-10 * log10(1 - greatest(p0, p1, p2) + 1e-100)) AS INTEGER)) AS gq, " + ", ".join(f"CAST(trunc(-10 * log10(c{g} / greatest(c0, c1, c2))) AS INTEGER) AS pl{g}" for g in range(3)) + " FROM n",
}
