"""Tab-separated side files: annotation (GTF), BED, pileups, count matrices, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Gene types usually counted; fixed values.
COMMON_GENE_TYPES = ("protein_coding", "lincRNA", "antisense", "IG_LV_gene", "IG_V_gene", "IG_LV_pseudogene", "IG_D_gene", "IG_J_gene", "IG_J_pseudogene", "IG_C_gene", "IG_C_pseudogene", "TR_V_gene", "TR_V_pseudogene", "TR_D_gene", "TR_J_gene", "TR_J_pseudogene", "TR_C_gene")


def read_gtf(spark: SparkSession, path: str, gene_types: tuple[str, ...] | None = None, add_chr: bool = False, remove_chr: bool = False) -> DataFrame:
    """chrom, feature, beg, end (1-based, closed), strand, attributes (map), at (place in the file); both
    kinds of UTR are UTR."""
    return parse_gtf(spark.read.text(path).withColumn("at", F.monotonically_increasing_id()), gene_types, add_chr, remove_chr)


def parse_gtf(lines: DataFrame, gene_types: tuple[str, ...] | None = None, add_chr: bool = False, remove_chr: bool = False) -> DataFrame:
    """The rows of lines (value, at), as ``read_gtf`` gives them."""
    lines = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    f = F.split("value", "\t")
    pairs = F.regexp_extract_all(F.get(f, F.lit(8)), F.lit(r'(\w+ "[^"]*")'), 1)
    pair = lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1).alias("key"), F.regexp_extract(x, r'"([^"]*)"', 1).alias("value"))
    # Of a key given twice the first counts.
    attributes = F.aggregate(F.transform(pairs, pair), F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["key"]), m).otherwise(F.map_concat(m, F.map_from_entries(F.array(p)))))
    chrom = F.when(F.lit(remove_chr), F.regexp_replace(F.get(f, F.lit(0)), "^chr", "")).when(F.lit(add_chr), F.concat(F.lit("chr"), F.get(f, F.lit(0)))).otherwise(F.get(f, F.lit(0)))
    rows = lines.select(
        chrom.alias("chrom"), F.when(F.get(f, F.lit(2)).isin("five_prime_utr", "three_prime_utr"), "UTR").otherwise(F.get(f, F.lit(2))).alias("feature"), F.get(f, F.lit(3)).try_cast("long").alias("beg"), F.get(f, F.lit(4)).try_cast("long").alias("end"), F.get(f, F.lit(6)).alias("strand"), attributes.alias("attributes"), "at",
    )
    kind = F.coalesce(F.col("attributes")["gene_type"], F.col("attributes")["gene_biotype"])
    return rows.where(kind.isin(*gene_types)) if gene_types else rows


def genes(gtf: DataFrame, create_missing: bool = False) -> DataFrame:
    """(gene_id, gene_name, chrom, strand, beg, end); asked to, genes without a row of their own come
    from their first child in the file."""
    a = F.col("attributes")
    named = gtf.select(a["gene_id"].alias("gene_id"), F.coalesce(a["gene_name"], a["gene_id"]).alias("gene_name"), "chrom", "strand", "beg", "end", "feature", "at").where("gene_id is not null")
    own = named.where("feature = 'gene'").drop("feature", "at")
    if not create_missing:
        return own
    child = named.where("feature <> 'gene'").groupBy("gene_id").agg(F.min_by(F.struct("gene_name", "chrom", "strand", "beg", "end"), F.col("at")).alias("c")).select("gene_id", "c.*")
    return own.unionByName(child.join(own, "gene_id", "left_anti"))


def transcripts(gtf: DataFrame, create_missing: bool = False) -> DataFrame:
    """(transcript_id, gene_id, chrom, strand, beg, end), missing ones made as ``genes`` makes them."""
    a = F.col("attributes")
    named = gtf.select(a["transcript_id"].alias("transcript_id"), a["gene_id"].alias("gene_id"), "chrom", "strand", "beg", "end", "feature", "at").where("transcript_id is not null")
    own = named.where("feature = 'transcript'").drop("feature", "at")
    if not create_missing:
        return own
    child = named.where("feature <> 'transcript'").groupBy("transcript_id").agg(F.min_by(F.struct("gene_id", "chrom", "strand", "beg", "end"), F.col("at")).alias("c")).select("transcript_id", "c.*")
    return own.unionByName(child.join(own, "transcript_id", "left_anti"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, beg, end as 1-based closed intervals, overlapping ones merged."""
    return parse_bed(spark.read.text(path))


def parse_bed(lines: DataFrame) -> DataFrame:
    """The merged intervals of lines (value)."""
    from dropletry.operators.intervals import merge_overlaps

    f = F.split("value", "\t")
    rows = lines.where(F.col("value") != "").select(F.get(f, F.lit(0)).alias("chrom"), (F.get(f, F.lit(1)).try_cast("long") + 1).alias("beg"), F.get(f, F.lit(2)).try_cast("long").alias("end"))
    return merge_overlaps(rows)


def read_list(spark: SparkSession, path: str, column: str = "barcode") -> DataFrame:
    """The distinct first fields of a file."""
    return spark.read.text(path).where(F.col("value") != "").select(F.split("value", r"\s+")[0].alias(column)).distinct()


def read_initial_clusters(spark: SparkSession, path: str) -> DataFrame:
    """barcode and cluster; negative clusters are unassigned and left out."""
    f = F.split("value", r"\s+")
    return spark.read.text(path).where(F.col("value") != "").select(F.get(f, F.lit(0)).alias("barcode"), F.try_to_number(F.get(f, F.lit(1)), F.lit("S999999999")).cast("int").alias("cluster")).where("cluster >= 0")


def write_pileup(path: str, cells: DataFrame, snps: DataFrame, rows: DataFrame) -> None:
    """The three tables of a pileup as compressed tab-separated files with headers."""
    for name, df in (("cel", cells), ("var", snps), ("plp", rows)):
        df.write.mode("overwrite").csv(f"{path}/{name}", sep="\t", header=True, compression="gzip", escape="\u0001", quote="")


def read_pileup(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, snps, rows) as written."""
    schemas = {
        "cel": "cell_id long, barcode string, n_read long, n_umi long, n_umi_w_snp long, n_snp long", "var": "snp_id long, chrom string, pos long, ref string, alt string, af double",
        "plp": "cell_id long, snp_id long, alleles string, baseqs string",
    }
    cells, snps, rows = (spark.read.schema(s).csv(f"{path}/{n}", sep="\t", header=True, quote="", escape="\u0001", nullValue=".") for n, s in schemas.items())
    return cells, snps, rows


def write_matrix(counts: DataFrame, path: str, element: str = "element", cell: str = "cell_id", n: str = "n_umi") -> None:
    """A sparse matrix directory: genes.tsv, barcodes.tsv (id, name; ids from 1) and matrix.mtx."""
    from dropletry.operators.pileup import first_seen

    rows = first_seen(counts, element, [element]).withColumn("id", F.col("id") + 1)
    columns = first_seen(counts, cell, [cell]).withColumn("id", F.col("id") + 1)
    triples = counts.join(rows.withColumnRenamed("id", "i"), element).join(columns.withColumnRenamed("id", "j"), cell)
    size = rows.agg(F.count("*").alias("r")).join(columns.agg(F.count("*").alias("c"))).join(triples.agg(F.count("*").alias("t")))  # one row each
    head = size.select(F.concat(F.lit("%%MatrixMarket matrix coordinate integer general\n%\n"), F.concat_ws(" ", "r", "c", "t")).alias("value")).coalesce(1)
    body = triples.orderBy("j", "i").select(F.concat_ws(" ", "i", "j", n).alias("value"))
    head.unionByName(body).write.mode("overwrite").text(f"{path}/matrix.mtx", compression="gzip")
    for name, df, key in (("genes", rows, element), ("barcodes", columns, cell)):
        df.orderBy("id").select("id", key).write.mode("overwrite").csv(f"{path}/{name}.tsv", sep="\t", compression="gzip")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, n) from a coordinate matrix: comments and the line of sizes are left out.

    The sizes are the only line whose third number is the number of lines that follow, so the file's
    first line without a comment must stand in its first part; it is found by its place.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("%")).withColumn("at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    first = lines.agg(F.min("at").alias("first"))
    f = F.split("value", " ")
    return lines.join(F.broadcast(first)).where(F.col("at") != F.col("first")).select(F.get(f, F.lit(0)).try_cast("long").alias("i"), F.get(f, F.lit(1)).try_cast("long").alias("j"), F.get(f, F.lit(2)).try_cast("long").alias("n"))


def gene_predictions(rows: DataFrame) -> DataFrame:
    """A row for each transcript (transcript_id, gene_id, chrom, strand, feature, beg, end): its extent, coding
    extent and exons as comma-ended lists, begins counted from 0; without coding rows both ends are its end."""
    exons = F.array_sort(F.collect_list(F.when(F.col("feature") == "exon", F.struct("beg", "end"))))
    listed = lambda side: F.array_join(F.transform("exons", lambda x: F.concat(side(x).cast("string"), F.lit(","))), "")
    coding = lambda c: F.when(F.col("feature") == "CDS", F.col(c))
    out = rows.groupBy("transcript_id").agg(
        *(F.min(c).alias(c) for c in ("gene_id", "chrom", "strand")), (F.min("beg") - 1).alias("tx_beg"), F.max("end").alias("tx_end"),
        F.coalesce(F.min(coding("beg")) - 1, F.max("end")).alias("cds_beg"), F.coalesce(F.max(coding("end")), F.max("end")).alias("cds_end"), exons.alias("exons"),
    )
    return out.select("*", F.size("exons").cast("long").alias("n_exon"), listed(lambda x: x["beg"] - 1).alias("exon_begs"), listed(lambda x: x["end"]).alias("exon_ends")).drop("exons")


def named_matrix(triples: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(gene, cell, n) of a coordinate matrix (i, j, n) by its lists of names (id: from 1, name)."""
    genes, cells = rows.select(F.col("id").alias("i"), F.col("name").alias("gene")), columns.select(F.col("id").alias("j"), F.col("name").alias("cell"))
    return triples.join(genes, "i").join(cells, "j").select("gene", "cell", "n")


def parse_dense(lines: DataFrame, names: list[str]) -> DataFrame:
    """(gene, cell, n) of a dense matrix: lines (value) of a gene and its counts in the order of ``names``;
    zeros are left out, and so is a line whose counts are no numbers, as a header is."""
    f = F.split("value", r"\s+")
    cells = F.transform(F.array(*(F.lit(n) for n in names)), lambda n, k: F.struct(n.alias("cell"), F.get(f, k + 1).try_cast("long").alias("n")))
    return lines.select(F.get(f, F.lit(0)).alias("gene"), F.explode(cells).alias("x")).select("gene", "x.*").where("n <> 0")


def parse_tsv(lines: DataFrame, schema: dict[str, str], separator: str = r"\s+") -> DataFrame:
    """The fields of lines (value, at) as typed columns, null where one is no such value; reading stops at
    the first empty line."""
    end = lines.where(F.col("value") == "").agg(F.min("at").alias("end"))  # one row
    kept = lines.join(F.broadcast(end)).where(F.col("end").isNull() | (F.col("at") < F.col("end")))
    f = F.split("value", separator)
    return kept.select("at", *(F.get(f, F.lit(k)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(schema.items())))


def read_tsv(spark: SparkSession, path: str, schema: dict[str, str], separator: str = r"\s+") -> DataFrame:
    return parse_tsv(spark.read.text(path).withColumn("at", F.monotonically_increasing_id()), schema, separator).drop("at")


def parse_sexes(lines: DataFrame) -> DataFrame:
    """(sample, male) of lines (value) with a sample and its sex: 1 or M, 2 or F; others are left out."""
    f = F.split("value", r"\s+")
    sex = F.upper(F.get(f, F.lit(1)))
    return lines.select(F.get(f, F.lit(0)).alias("sample"), F.when(sex.isin("1", "M"), True).when(sex.isin("2", "F"), False).alias("male")).where("male is not null")


def write_chunks(rows: DataFrame, path: str) -> None:
    """Rows (chunk, ...) as compressed tab-separated files, a folder for each chunk."""
    rows.repartition("chunk").write.mode("overwrite").partitionBy("chunk").csv(path, sep="\t", compression="gzip")


def umi_table(segments: DataFrame) -> DataFrame:
    """(cell_id, umi, forward, reverse, segments) of aligned segments (cell_id, umi, chrom, strand, beg, end):
    bases by strand, and the distinct segments as chrom:beg:length:strand in their order."""
    size = F.col("end") - F.col("beg") + 1
    rows = segments.select("cell_id", "umi", "chrom", "strand", "beg", "end").distinct()
    of = lambda s: F.coalesce(F.sum(F.when(F.col("strand") == s, size)), F.lit(0)).cast("long")
    text = F.transform(F.array_sort(F.collect_list(F.struct("chrom", "beg", "end", "strand"))), lambda x: F.concat_ws(":", x["chrom"], x["beg"], x["end"] - x["beg"] + 1, x["strand"]))
    return rows.groupBy("cell_id", "umi").agg(of("+").alias("forward"), of("-").alias("reverse"), F.array_join(text, "\t").alias("segments"))
