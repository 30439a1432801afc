"""Queries that read text formats from lines, or make them, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.operators import alleles, clusters, expression
from dropletry.plans import counting, single_cell as sc
from dropletry.plans.adapters import table, variants
from dropletry.sources import alignments, sequences, tables
from dropletry.sources import variants as vcf


def text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)).alias("value")


def number(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def sam_parse(s: SparkSession, f: str) -> DataFrame:
    cigar = F.concat(number(F.col("o_custkey") % 9 + 1), F.lit("M"))
    line = text("r", number("o_orderkey"), "\t", number(F.col("o_orderkey") % 4096), "\tchr1\t", number("o_custkey"), "\t", number(F.col("o_custkey") % 60), "\t", cigar, "\t*\t0\t0\tACGT\tIIII", F.when(F.col("o_orderkey") % 3 != 0, text("\tCB:Z:", F.col("o_orderpriority"), "\tNM:i:", number(F.col("o_custkey") % 5))).otherwise(""))
    rows = alignments.parse_sam(table(s, f, "orders").select(line).unionByName(s.createDataFrame([("@HD\tVN:1.6",)], "value string")))
    kept = alignments.in_regions(rows, [("chr1", 10, 60), ("chr1", 50, 90), ("chr2", 1, 9)])
    return kept.select("qname", "flag", "pos0", "mapq", "cigar", F.col("tags")["CB"].alias("cb"), F.col("tags")["NM"].alias("nm"))


def interval_scan(s: SparkSession, f: str) -> DataFrame:
    from dropletry.plans.alleles import aligned

    wanted = table(s, f, "supplier").select(F.lit("1").alias("chrom"), (F.col("s_suppkey") * 37 % 200 + 1).alias("beg"), (F.col("s_suppkey") * 37 % 200 + 6).alias("end"))
    return alignments.overlapping(aligned(s, f).select("o_orderkey", "chrom", "pos0", "cigar"), wanted, 64).select("o_orderkey")


def vcf_parse(s: SparkSession, f: str) -> DataFrame:
    gt = lambda k: F.when((F.col("p_partkey") + k) % 5 == 0, "./1").otherwise(F.concat_ws("|", number((F.col("p_partkey") + k) % 3), number(F.col("p_size") % 2)))
    line = text("1\t", number("p_partkey"), "\t.\tA\tC,G\t", number("p_size"), "\tPASS\tDP=", number(F.col("p_size") * 2), ";DB\tGT:DP\t", gt(0), ":3\t", gt(1))
    rows = vcf.parse_vcf(table(s, f, "part").select(line))
    return vcf.genotypes(rows.where(rows["info"]["DP"].cast("int") > 20), ["x", "y"], ["y", "x"]).select("pos", "alt", "sample", "gt", F.size("alleles").alias("n_allele"))


def gtf_lines(s: SparkSession, f: str) -> DataFrame:
    feature = F.element_at(F.array(*(F.lit(x) for x in ("gene", "exon", "five_prime_utr", "exon"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    kind = F.when(F.col("p_size") % 3 == 0, "junk").otherwise("lincRNA")
    line = text("1\tx\t", feature, "\t", number("p_partkey"), "\t", number(F.col("p_partkey") + F.col("p_size")), "\t.\t+\t.\tgene_id \"", F.col("p_brand"), "\"; transcript_id \"", F.col("p_brand"), "t", number(F.col("p_size") % 4), "\"; gene_type \"", kind, "\"; tag \"a\"; tag \"b\";")
    return table(s, f, "part").select(line, F.col("p_partkey").alias("at"))


def gtf_parse(s: SparkSession, f: str) -> DataFrame:
    rows = tables.parse_gtf(gtf_lines(s, f), ("lincRNA", "protein_coding"), add_chr=True)
    return rows.select("chrom", "feature", "beg", "end", F.col("attributes")["gene_id"].alias("gene_id"), F.col("attributes")["tag"].alias("tag"))


def gtf_parents(s: SparkSession, f: str) -> DataFrame:
    """Genes and transcripts, those without a row made from their first child in the file."""
    rows = tables.parse_gtf(gtf_lines(s, f))
    rows = rows.where("feature <> 'gene' or at % 3 = 0")
    g = tables.genes(rows, True).select(F.lit("gene").alias("level"), F.col("gene_id").alias("id"), "beg", "end")
    return g.unionByName(tables.transcripts(rows, True).select(F.lit("transcript").alias("level"), F.col("transcript_id").alias("id"), "beg", "end"))


def bed_merge(s: SparkSession, f: str) -> DataFrame:
    return tables.parse_bed(counting.spans(s, f).select(text(F.col("chrom"), "\t", number(F.col("beg") - 1), "\t", number("end"))))


def matrix_names(s: SparkSession, f: str) -> DataFrame:
    triples = table(s, f, "lineitem").groupBy((F.col("l_partkey") % 30 + 1).alias("i"), (F.col("l_suppkey") % 7 + 1).alias("j")).agg(F.count("*").alias("n"))
    rows = table(s, f, "part").where("p_partkey <= 25").select(F.col("p_partkey").alias("id"), F.concat(F.lit("gene"), "p_partkey").alias("name"))
    columns = table(s, f, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return tables.named_matrix(triples, rows, columns)


def dense_matrix(s: SparkSession, f: str) -> DataFrame:
    line = text(F.concat(F.lit("g"), "p_partkey"), "\t", number(F.col("p_size") % 3), "\t", number(F.col("p_partkey") % 2), "\t", number("p_size"))
    lines = table(s, f, "part").select(line).unionByName(s.createDataFrame([("gene\ta\tb\tc",)], "value string"))
    return tables.parse_dense(lines, ["a", "b", "c"])


def tsv_until_empty(s: SparkSession, f: str) -> DataFrame:
    line = F.when(F.col("p_partkey") == 150, "").otherwise(text(F.col("p_brand"), " ", number("p_size"), "  ", F.when(F.col("p_size") % 4 == 0, "x").otherwise(number(F.col("p_size") / 4))))
    return tables.parse_tsv(table(s, f, "part").select(line.alias("value"), F.col("p_partkey").alias("at")), {"brand": "string", "size": "int", "quarter": "double"})


def fastq_records(s: SparkSession, f: str) -> DataFrame:
    rows = table(s, f, "part").select("p_partkey", "p_size", F.posexplode(F.array(*(F.lit(k) for k in range(4)))).alias("k", "_"))
    seq = F.repeat(F.lit("A"), F.col("p_size"))
    value = F.when(F.col("k") == 0, F.concat(F.lit("@r"), "p_partkey", F.lit(" more"))).when(F.col("k") == 1, seq).when(F.col("k") == 2, "+").otherwise(F.when(F.col("p_partkey") % 10 == 0, "@").otherwise(F.translate(seq, "A", "@")))
    lines = rows.select(F.lit("f").alias("file"), (F.col("p_partkey") * 4 + F.col("k")).alias("at"), value.alias("value"))
    return sequences.fastq(lines).select("record", "name", F.length("seq").alias("size"))


def fasta_bases(s: SparkSession, f: str) -> DataFrame:
    """Bases at points of sequences of 29 lines each, whose widths differ and may be 0."""
    letters = F.substring(F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTacgtACGTacgt"), F.lit(1), (F.col("p_size") % 32).cast("int"))
    value = F.when(F.col("p_partkey") % 30 == 1, F.concat(F.lit(">c"), F.floor(F.col("p_partkey") / 30), F.lit(" text"))).otherwise(letters)
    body = table(s, f, "part").select(F.col("p_partkey").alias("at"), value.alias("value"))
    points = table(s, f, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey") % 50).alias("chrom"), (F.col("c_custkey") * 7 % 300 + 1).alias("pos"))
    return sequences.bases_at(sequences.blocks(sequences.fasta(body), 64), points, 64).where("base <> ''").select("c_custkey", "base")


def variant_normalize_reference(s: SparkSession, f: str) -> DataFrame:
    """Deletions and repeated insertions, in normal form against sequences with many repeats."""
    letters = F.substring(F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"), F.lit(1), (F.col("p_size") % 32).cast("int"))
    chrom = F.concat(F.lit("c"), F.floor((F.col("p_partkey") - 1) / 40))
    parts = table(s, f, "part").select("p_partkey", "p_size", chrom.alias("chrom"))
    value = F.when(F.col("p_partkey") % 40 == 1, F.concat(F.lit(">"), "chrom")).when(F.col("p_size") % 3 == 0, F.repeat(F.lit("ac"), F.lit(10))).otherwise(letters)
    width = 16
    blocks = clusters.saved(sequences.blocks(sequences.fasta(parts.select(F.col("p_partkey").alias("at"), value.alias("value"))), width))
    placed = parts.withColumn("pos", F.col("p_partkey") % 40 * 12 + 3)
    spans = placed.select(F.col("p_partkey").alias("key"), "chrom", F.col("pos").alias("beg"), (F.col("pos") + 1 + F.col("p_size") % 4).alias("end"))
    rows = placed.join(sequences.bases_between(blocks, spans, width).withColumnRenamed("key", "p_partkey"), "p_partkey").where(F.length("bases") > 1)
    first, deleted = F.left("bases", F.lit(1)), F.col("p_partkey") % 2 == 0
    rows = rows.select("p_partkey", "chrom", "pos", F.when(deleted, F.col("bases")).otherwise(first).alias("ref"), F.when(deleted, first).otherwise(F.col("bases")).alias("alt"))
    return alleles.normalized_by_reference(rows, blocks, width)


def sex_map(s: SparkSession, f: str) -> DataFrame:
    lines = table(s, f, "customer").select(text(F.col("c_name"), "\t", F.element_at(F.array(*(F.lit(x) for x in ("1", "F", "m", "?"))), (F.col("c_custkey") % 4 + 1).cast("int"))))
    rows = tables.parse_sexes(lines)
    return rows.groupBy("male", alleles.ploidy(F.lit("Y"), F.lit(5), F.col("male")).alias("copies")).agg(F.count("*").alias("n"))


def umi_table(s: SparkSession, f: str) -> DataFrame:
    rows = counting.segments(s, f).select("cell_id", (F.col("umi") % 500).alias("umi"), "chrom", F.when(F.col("strand") == "O", "+").otherwise("-").alias("strand"), F.col("a_beg").alias("beg"), F.col("a_end").alias("end"))
    return tables.umi_table(rows)


def cluster_vcf_text(s: SparkSession, f: str) -> DataFrame:
    """A cluster's text at each variant: genotype, quality, depth, allele depths, likelihoods, posteriors."""
    gl, snps = sc.likelihoods(s, f), variants(s, f)
    depth = sc.unique(s, f).join(sc.seeded(s, f), "cell_id").groupBy("cluster", "snp_id").agg(F.count("*").alias("dp"), F.count_if(F.col("allele") == 0).alias("n_ref"), F.count_if(F.col("allele") == 1).alias("n_alt"))
    rows = clusters.genotype_fields(clusters.merged(gl, sc.seeded(s, f)), snps).join(depth, ["cluster", "snp_id"])
    _, value = vcf.sample_text({"GT": F.col("gt"), "GQ": F.col("gq"), "DP": F.col("dp"), "AD": F.concat_ws(",", "n_ref", "n_alt"), "PL": F.concat_ws(",", "pl0", "pl1", "pl2")})
    return rows.select("cluster", "snp_id", value.alias("text"))


def mixture_tables(s: SparkSession, f: str) -> DataFrame:
    """The shares of two components, and of the genes in each, as one long table."""
    counts = table(s, f, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), (F.col("l_partkey") % 40).alias("gene")).agg(F.count("*").alias("n"))
    w = table(s, f, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.array(*(F.when(F.col("s_suppkey") % 2 == j, 0.8).otherwise(0.2) for j in range(2))).alias("w"))
    return expression.mixture_tables(counts, w, 2).withColumn("value", F.round("value", 6))


def tx_count_tables(s: SparkSession, f: str) -> DataFrame:
    """UMIs and reads by cell and by transcript."""
    rows = expression.transcript_counts(counting.hits(s, f))
    one = lambda level, key: rows.groupBy(F.lit(level).alias("level"), F.col(key).alias("id")).agg(F.sum("n_umi").cast("long").alias("n_umi"), F.sum("n_read").cast("long").alias("n_read"))
    return one("cell", "cell_id").unionByName(one("tx", "tx"))


def matrix_nnz(s: SparkSession, f: str) -> DataFrame:
    from dropletry.plans.linking import element_levels

    return element_levels(s, f).groupBy("level").agg(F.count("*").alias("nnz"), F.count_distinct("element").alias("rows"), F.count_distinct("cell_id").alias("columns"))


QUERIES = {
    "sam_parse": sam_parse, "interval_scan": interval_scan, "vcf_parse": vcf_parse, "gtf_parse": gtf_parse, "gtf_parents": gtf_parents, "bed_merge": bed_merge, "matrix_names": matrix_names,
    "dense_matrix": dense_matrix, "tsv_until_empty": tsv_until_empty, "fastq_records": fastq_records, "fasta_bases": fasta_bases, "variant_normalize_reference": variant_normalize_reference, "sex_map": sex_map, "umi_table": umi_table,
    "cluster_vcf_text": cluster_vcf_text, "mixture_tables": mixture_tables, "tx_count_tables": tx_count_tables, "matrix_nnz": matrix_nnz,
}

# ---- The same in SQL ----
_GTF = "g AS (SELECT p_partkey AS k_at, ['gene', 'exon', 'UTR', 'exon'][p_partkey % 4 + 1] AS feature, p_partkey AS beg, p_partkey + p_size AS e, p_brand AS gene_id, p_brand || 't' || (p_size % 4) AS tx, p_size % 3 = 0 AS junk FROM part)"


def _nnz() -> str:
    from dropletry.plans.linking import ORACLE_SQL as linked

    return f"SELECT level, count(*) AS nnz, count(DISTINCT element) AS rows, count(DISTINCT cell_id) AS columns FROM ({linked['element_levels']}) GROUP BY 1"


def _vcf_text() -> str:
    from dropletry.plans.linking import ORACLE_SQL as linked

    return f"WITH f AS ({linked['cluster_vcf_all']}), {sc.UNIQUE}, d AS (SELECT CAST(cell_id % 3 AS INTEGER) AS cluster, snp_id, count(*) AS dp, count(*) FILTER (allele = 0) AS r, count(*) FILTER (allele = 1) AS a FROM uniq GROUP BY 1, 2) SELECT cluster, snp_id, concat_ws(':', gt, gq, dp, r || ',' || a, pl0 || ',' || pl1 || ',' || pl2) AS text FROM f JOIN d USING (cluster, snp_id)"


ORACLE_SQL = {
    "sam_parse": "SELECT 'r' || o_orderkey AS qname, CAST(o_orderkey % 4096 AS INTEGER) AS flag, o_custkey - 1 AS pos0, CAST(o_custkey % 60 AS INTEGER) AS mapq, (o_custkey % 9 + 1) || 'M' AS cigar, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS cb, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey % 5 AS VARCHAR) END AS nm FROM orders WHERE o_custkey BETWEEN 10 AND 90",
    "interval_scan": "SELECT DISTINCT o_orderkey FROM orders JOIN supplier ON o_custkey + 1 <= s_suppkey * 37 % 200 + 6 AND s_suppkey * 37 % 200 + 1 <= o_custkey + (o_orderkey % 20 + 1) + (o_custkey % 30 + 1) + 11",
    "vcf_parse": "WITH x AS (SELECT p_partkey, p_size, k FROM part CROSS JOIN range(2) t(k) WHERE p_size * 2 > 20) SELECT p_partkey AS pos, 'C' AS alt, CASE WHEN k = 0 THEN 'x' ELSE 'y' END AS sample, CASE WHEN (p_partkey + k) % 5 <> 0 THEN CAST(((p_partkey + k) % 3 > 0) AS BIGINT) + CAST((p_size % 2 > 0) AS BIGINT) END AS gt, 2 AS n_allele FROM x",
    "gtf_parse": f"WITH {_GTF} SELECT 'chr1' AS chrom, feature, beg, e AS \"end\", gene_id, 'a' AS tag FROM g WHERE NOT junk",
    "gtf_parents": f"WITH {_GTF}, k AS (SELECT * FROM g WHERE feature <> 'gene' OR k_at % 3 = 0), own AS (SELECT 'gene' AS level, gene_id AS id, beg, e FROM k WHERE feature = 'gene'), c AS (SELECT 'gene' AS level, gene_id AS id, min_by(beg, k_at) AS beg, min_by(e, k_at) AS e FROM k WHERE feature <> 'gene' AND gene_id NOT IN (SELECT id FROM own) GROUP BY 2), t AS (SELECT 'transcript' AS level, tx AS id, min_by(beg, k_at) AS beg, min_by(e, k_at) AS e FROM k GROUP BY 2) SELECT level, id, beg, e AS \"end\" FROM (SELECT * FROM own UNION ALL SELECT * FROM c UNION ALL SELECT * FROM t)",
    "bed_merge": counting.ORACLE_SQL["merge_intervals"],
    "matrix_names": "SELECT 'gene' || (l_partkey % 30 + 1) AS gene, n_name AS cell, count(*) AS n FROM lineitem JOIN nation ON n_nationkey = l_suppkey % 7 + 1 WHERE l_partkey % 30 + 1 <= 25 GROUP BY 1, 2",
    "dense_matrix": "SELECT * FROM (SELECT 'g' || p_partkey AS gene, unnest(['a', 'b', 'c']) AS cell, unnest([p_size % 3, p_partkey % 2, p_size]::BIGINT[]) AS n FROM part) WHERE n <> 0",
    "tsv_until_empty": "SELECT p_partkey AS at, p_brand AS brand, p_size AS size, CASE WHEN p_size % 4 <> 0 THEN p_size / 4e0 END AS quarter FROM part WHERE p_partkey < 150",
    "fastq_records": "SELECT p_partkey AS record, 'r' || p_partkey AS name, p_size AS size FROM part WHERE p_partkey % 10 <> 0 OR p_size = 1",
    "fasta_bases": "WITH g AS (SELECT 'c' || ((p_partkey - 1) // 30) AS chrom, upper(string_agg(substr(translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTacgtACGTacgt'), 1, p_size % 32), '' ORDER BY p_partkey)) AS g FROM part WHERE p_partkey % 30 <> 1 AND p_partkey > 0 GROUP BY 1) SELECT c_custkey, substr(g, c_custkey * 7 % 300 + 1, 1) AS base FROM customer JOIN g ON chrom = 'c' || (c_custkey % 50) WHERE len(g) > c_custkey * 7 % 300",
    "variant_normalize_reference": """WITH RECURSIVE l AS (SELECT p_partkey, p_size, 'c' || CAST(floor((p_partkey - 1) / 40) AS BIGINT) AS chrom, CASE WHEN p_size % 3 = 0 THEN repeat('AC', 10) ELSE substr(translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, p_size % 32) END AS seq FROM part),
      g AS MATERIALIZED (SELECT chrom, string_agg(seq, '' ORDER BY p_partkey) AS g FROM l WHERE p_partkey % 40 <> 1 AND p_partkey > 0 GROUP BY 1),
      b AS (SELECT p_partkey, chrom, p_partkey % 40 * 12 + 3 AS pos, substr(g, p_partkey % 40 * 12 + 3, 2 + p_size % 4) AS bases FROM l JOIN g USING (chrom)),
      t AS (SELECT p_partkey, chrom, pos, CASE WHEN p_partkey % 2 = 0 THEN bases ELSE bases[1] END AS r, CASE WHEN p_partkey % 2 = 0 THEN bases[1] ELSE bases END AS a, 0 AS step FROM b WHERE len(bases) > 1 UNION ALL
        SELECT p_partkey, chrom, CASE WHEN least(len(r), len(a)) > 1 THEN pos ELSE pos - 1 END, CASE WHEN least(len(r), len(a)) > 1 THEN r[:-2] ELSE substr(g, pos - 1, 1) || r END, CASE WHEN least(len(r), len(a)) > 1 THEN a[:-2] ELSE substr(g, pos - 1, 1) || a END, step + 1
        FROM t JOIN g USING (chrom) WHERE right(r, 1) = right(a, 1) AND (least(len(r), len(a)) > 1 OR pos > 1)),
      e AS (SELECT p_partkey, chrom, pos, r, a, 0 AS step FROM t QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY step DESC) = 1),
      h AS (SELECT * FROM e UNION ALL SELECT p_partkey, chrom, pos + 1, r[2:], a[2:], step + 1 FROM h WHERE len(r) > 1 AND len(a) > 1 AND r[1] = a[1])
      SELECT p_partkey, chrom, pos, r AS ref, a AS alt FROM h QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY step DESC) = 1""",
    "sex_map": "SELECT c_custkey % 4 <> 1 AS male, CASE WHEN c_custkey % 4 = 1 THEN 0 ELSE 1 END AS copies, count(*) AS n FROM customer WHERE c_custkey % 4 <> 3 GROUP BY 1, 2",
    "umi_table": "WITH r AS (SELECT DISTINCT l_suppkey AS cell_id, l_orderkey % 500 AS umi, l_returnflag AS chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_partkey * 10 AS beg, l_linenumber * 3 + 1 AS n FROM lineitem) SELECT cell_id, umi, CAST(coalesce(sum(n) FILTER (strand = '+'), 0) AS BIGINT) AS forward, CAST(coalesce(sum(n) FILTER (strand = '-'), 0) AS BIGINT) AS reverse, string_agg(chrom || ':' || beg || ':' || n || ':' || strand, chr(9) ORDER BY chrom, beg, n, strand) AS segments FROM r GROUP BY 1, 2",
    "cluster_vcf_text": _vcf_text(),
    "mixture_tables": "WITH c AS (SELECT l_suppkey AS cell_id, l_partkey % 40 AS gene, count(*) AS n FROM lineitem GROUP BY 1, 2), w AS (SELECT s_suppkey AS cell_id, CASE WHEN s_suppkey % 2 = 0 THEN 0.8e0 ELSE 0.2e0 END AS w0, CASE WHEN s_suppkey % 2 = 1 THEN 0.8e0 ELSE 0.2e0 END AS w1 FROM supplier), p AS (SELECT gene, sum(n * w0) + 0.5e0 AS p0, sum(n * w1) + 0.5e0 AS p1 FROM c JOIN w USING (cell_id) GROUP BY 1), t AS (SELECT sum(p0) AS t0, sum(p1) AS t1 FROM p) SELECT 'share' AS \"table\", CAST(NULL AS BIGINT) AS gene, j AS component, round(CASE WHEN j = 0 THEN avg(w0) ELSE avg(w1) END, 6) AS value FROM w CROSS JOIN (SELECT CAST(unnest([0, 1]) AS INTEGER) AS j) GROUP BY j UNION ALL SELECT 'profile', gene, 0, round(p0 / t0, 6) FROM p CROSS JOIN t UNION ALL SELECT 'profile', gene, 1, round(p1 / t1, 6) FROM p CROSS JOIN t",
    "tx_count_tables": f"WITH x AS ({counting.ORACLE_SQL['tx_fractional_counts']}) SELECT 'cell' AS level, cell_id AS id, CAST(sum(n_umi) AS BIGINT) AS n_umi, CAST(sum(n_read) AS BIGINT) AS n_read FROM x GROUP BY 2 UNION ALL SELECT 'tx', tx, CAST(sum(n_umi) AS BIGINT), CAST(sum(n_read) AS BIGINT) FROM x GROUP BY 2",
    "matrix_nnz": _nnz(),
}
