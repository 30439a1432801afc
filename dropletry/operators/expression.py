"""Counting: genes, transcripts, barcodes, mixtures of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dropletry.functions.phred import string_hash
from dropletry.operators.intervals import range_join


def element_counts(segments: DataFrame, elements: DataFrame, width: int) -> DataFrame:
    """(element, cell_id, n_umi): UMIs whose aligned segments (cell_id, umi, chrom, strand, a_beg, a_end)
    overlap an element (element, chrom, strand, b_beg, b_end) of the same strand."""
    hits = range_join(segments, elements, width, ["chrom", "strand"]).select("element", "cell_id", "umi").distinct()
    return hits.groupBy("element", "cell_id").agg(F.count("*").alias("n_umi"))


def with_parents(exons: DataFrame, transcripts: DataFrame, genes: DataFrame) -> DataFrame:
    """Exons (exon_id, transcript_id) with their transcript's gene; one whose transcript or gene is not
    listed, or lies on another contig or strand than the gene, is left out (chrom, strand of each)."""
    sane = transcripts.select("transcript_id", "gene_id", "chrom", "strand").join(genes.select("gene_id", "chrom", "strand"), ["gene_id", "chrom", "strand"], "left_semi")
    return exons.join(sane.select("transcript_id", "gene_id"), "transcript_id")


def level_counts(hits: DataFrame) -> DataFrame:
    """(level, element, cell_id, n_umi) of exons, transcripts and genes: each UMI (cell_id, umi) counts once
    for each element that it hits (exon_id, transcript_id, gene_id)."""
    levels = F.array(*(F.struct(F.lit(x).alias("level"), F.col(f"{x}_id").cast("string").alias("element")) for x in ("exon", "transcript", "gene")))
    rows = hits.select("cell_id", "umi", F.explode(levels).alias("x")).select("cell_id", "umi", "x.*").distinct()
    return rows.groupBy("level", "element", "cell_id").agg(F.count("*").alias("n_umi"))


def longest(elements: DataFrame) -> DataFrame:
    """The longest element (feature, beg, end) of each feature."""
    return elements.groupBy("feature").agg(F.max(F.col("end") - F.col("beg") + 1).alias("longest"))


def collapsed(counts: DataFrame, groups: int, seed: int = 0) -> DataFrame:
    """(group, cell_id, n): genes put into so many groups by hash, their counts (gene, cell_id, n) summed."""
    return counts.groupBy((string_hash(F.col("gene"), seed) % groups).alias("group"), "cell_id").agg(F.sum("n").cast("long").alias("n"))


def frequent_genes(counts: DataFrame, least: int) -> DataFrame:
    """Counts (gene, cell_id, n) of the genes that have so many in all cells together, with both sums."""
    rows = counts.groupBy("gene").agg(F.sum("n").cast("long").alias("gene_total")).where(F.col("gene_total") >= least)
    kept = counts.join(rows, "gene")
    return kept.join(kept.groupBy("cell_id").agg(F.sum("n").cast("long").alias("cell_total")), "cell_id")


def gibbs_sweep(logits: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(cell_id, drawn): a component for each cell with the probabilities that x0, x1, ... give as logs.

    The draw is a hash of the cell and the sweep's seed, so that a task that runs again draws the same.
    """
    top = F.greatest(*(F.col(f"x{j}") for j in range(k)))
    e = [F.exp(F.col(f"x{j}") - top) for j in range(k)]
    u = (string_hash(F.col("cell_id").cast("string"), seed) + 0.5) / 4294967296
    total, upto, drawn = sum(e[1:], e[0]), e[0], F.lit(0)
    for j in range(1, k):
        drawn = drawn + (u * total >= upto).cast("int")
        upto = upto + e[j]
    return logits.select("cell_id", drawn.cast("int").alias("drawn"))


def one_gene_per_locus(segments: DataFrame, genes: DataFrame, width: int, locus: int) -> DataFrame:
    """(cell_id, umi, chrom, bin, element): of the genes that a UMI hits in a locus bin, the first by name.

    The bin of a segment is (beg + end) div (locus / 2).
    """
    hits = range_join(segments, genes, width, ["chrom", "strand"]).withColumn("bin", F.expr(f"(a_beg + a_end) div {max(1, locus // 2)}"))
    return hits.groupBy("cell_id", "umi", "chrom", "bin").agg(F.min("element").alias("element"))


def chunk_of(barcode: Column, chunks: int = 100, seed: int = 0x811C9DC5) -> Column:
    """The chunk that a barcode is dealt to."""
    return string_hash(barcode, seed) % chunks


def prefix_histogram(barcodes: DataFrame, k: int) -> DataFrame:
    """(n_seen, n_prefix, n_at_least): how many prefixes of length k were seen so often, and so often or more."""
    counts = barcodes.groupBy(F.substring("barcode", 1, k).alias("prefix")).agg(F.count("*").alias("n_seen"))
    return counts.groupBy("n_seen").agg(F.count("*").alias("n_prefix")).withColumn("n_at_least", F.sum("n_prefix").over(Window.orderBy(F.desc("n_seen"))).cast("long"))


def least_mismatches(hits: DataFrame, most: int) -> DataFrame:
    """Hits (read_id, tx, nm) with the fewest mismatches of their read, if those are not too many; and
    n_hit, how many such a read has."""
    read = Window.partitionBy("read_id")
    kept = hits.withColumn("least", F.min("nm").over(read)).where((F.col("nm") == F.col("least")) & (F.col("least") <= most))
    return kept.withColumn("n_hit", F.count("*").over(read)).drop("least")


def annotated_share(hits: DataFrame, prefix: str = "ENST") -> DataFrame:
    """(cell_id, n_umi, n_annotated, share) of UMIs (cell_id, tx, umi) on transcripts whose name has the prefix."""
    umis = hits.select("cell_id", "tx", "umi").distinct()
    out = umis.groupBy("cell_id").agg(F.count("*").alias("n_umi"), F.count_if(F.col("tx").startswith(prefix)).alias("n_annotated"))
    return out.withColumn("share", F.col("n_annotated") / F.col("n_umi"))


def transcript_counts(hits: DataFrame) -> DataFrame:
    """Per droplet and transcript: UMIs, reads, and UMIs shared among their hits (1 / fewest hits)."""
    umis = hits.groupBy("cell_id", "tx", "umi").agg(F.count("*").alias("n_read"), F.min("n_hit").alias("n_hit"))
    return umis.groupBy("cell_id", "tx").agg(F.count("*").alias("n_umi"), F.sum("n_read").cast("long").alias("n_read"), F.sum(1 / F.col("n_hit")).alias("n_share"))


def mixture_step(counts: DataFrame, weights: DataFrame, k: int, pseudo: float = 0.5) -> DataFrame:
    """One EM round of a multinomial mixture: (cell_id, w: k responsibilities) from the ones before.

    counts: (cell_id, gene, n).  M step: shares of each component and of its genes; E step: normalised
    responsibilities.  A component is a column, so both steps are one join and one aggregate each.
    """
    rows = counts.join(weights, "cell_id")
    profile = rows.groupBy("gene").agg(*((F.sum(F.col("n") * F.col("w")[j]) + pseudo).alias(f"p{j}") for j in range(k)))
    totals = profile.agg(*(F.sum(f"p{j}").alias(f"t{j}") for j in range(k)))
    share = weights.agg(*(F.avg(F.col("w")[j]).alias(f"pi{j}") for j in range(k)))
    one = F.broadcast(totals.join(share))  # a single row
    logs = profile.join(one).select("gene", *(F.ln(F.col(f"p{j}") / F.col(f"t{j}")).alias(f"q{j}") for j in range(k)))
    sums = counts.join(logs, "gene").groupBy("cell_id").agg(*(F.sum(F.col("n") * F.col(f"q{j}")).alias(f"s{j}") for j in range(k)))
    scored = sums.join(one).select("cell_id", *((F.col(f"s{j}") + F.ln(f"pi{j}")).alias(f"x{j}") for j in range(k)))
    top = F.greatest(*(F.col(f"x{j}") for j in range(k))) if k > 1 else F.col("x0")
    e = F.array(*(F.exp(F.col(f"x{j}") - top) for j in range(k)))
    return scored.select("cell_id", F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)).alias("w"))


def mixture_tables(counts: DataFrame, weights: DataFrame, k: int, pseudo: float = 0.5) -> DataFrame:
    """(table, gene, component, value): the share of each component, and of each gene in a component, that
    responsibilities (cell_id, w) give."""
    profile = counts.join(weights, "cell_id").groupBy("gene").agg(*((F.sum(F.col("n") * F.col("w")[j]) + pseudo).alias(f"p{j}") for j in range(k)))
    totals = F.broadcast(profile.agg(*(F.sum(f"p{j}").alias(f"t{j}") for j in range(k))))  # one row
    long = lambda value: F.explode(F.array(*(F.struct(F.lit(j).alias("component"), value(j).alias("value")) for j in range(k)))).alias("x")
    genes = profile.join(totals).select(F.lit("profile").alias("table"), "gene", long(lambda j: F.col(f"p{j}") / F.col(f"t{j}"))).select("table", "gene", "x.*")
    means = weights.agg(*(F.avg(F.col("w")[j]).alias(f"m{j}") for j in range(k))).select(F.lit("share").alias("table"), F.lit(None).cast(dict(profile.dtypes)["gene"]).alias("gene"), long(lambda j: F.col(f"m{j}"))).select("table", "gene", "x.*")
    return means.unionByName(genes)


def multiplexed(reads: DataFrame, partners: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Reads (barcode, umi) whose barcode becomes "a.b" of a pair (barcode, partner) by their UMI's hash."""
    joined = reads.join(partners, "barcode")
    ours = string_hash(F.col("umi"), 0) % 65535 < int(65535 * (1 - alpha))
    first, second = F.col("barcode"), F.col("partner")
    return joined.withColumn("merged", F.when(ours, F.concat_ws(".", first, second)).otherwise(F.concat_ws(".", second, first)))


def variant_class(ref: Column, alt: Column) -> Column:
    """SNP, MNP, INS, DEL, COMPLEX, SV or REF of a pair of alleles."""
    trimmed = F.when(alt.startswith("<") | alt.contains("[") | alt.contains("]"), "SV").when((alt == ".") | (alt == ref), "REF")
    same = F.length(ref) == F.length(alt)
    return (
        trimmed.when(same & (F.length(ref) == 1), "SNP").when(same, "MNP")
        .when((F.length(ref) < F.length(alt)) & alt.startswith(ref), "INS").when((F.length(ref) > F.length(alt)) & ref.startswith(alt), "DEL").otherwise("COMPLEX")
    )


def is_transition(ref: Column, alt: Column) -> Column:
    """Whether a single-base change stays among purines or among pyrimidines."""
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")
