"""Text formats: read what was written, and the corners of alignments."""

import numpy as np
from pyspark.sql import functions as F

from dropletry.operators import alleles, pileup
from dropletry.sources import alignments, sequences, tables, variants

SAM = "@HD\tVN:1.6\nr1\t0\t1\t101\t60\t5S10M2I3D10M100N20M\t*\t0\t0\t{seq}\t{qual}\tCB:Z:AA-1\tUB:Z:T:G\nr2\t4\t1\t5\t0\t4M\t*\t0\t0\tACGT\tIIII\n"


def test_sam_round_trip_and_bases(spark, tmp_path):
    seq = "".join("ACGT"[k % 4] for k in range(47))
    (tmp_path / "a.sam").write_text(SAM.format(seq=seq, qual="".join(chr(33 + k) for k in range(47))))
    reads = alignments.read_sam(spark, str(tmp_path / "a.sam"))
    assert [r["tags"].get("UB") for r in reads.orderBy("qname").collect()] == ["T:G", None]
    snps = spark.createDataFrame([(1, "1", 101), (2, "1", 110), (3, "1", 112), (4, "1", 114), (5, "1", 130), (6, "1", 224), (7, "1", 300)], "snp_id long, chrom string, pos long")
    got = {r["snp_id"]: (r["rpos"], r["base"], r["bq"]) for r in alignments.bases_on_variants(reads.where("mapq > 0"), snps).collect()}
    assert got == {1: (5, seq[5], 5), 2: (14, seq[14], 14), 4: (17, seq[17], 17), 6: (27, seq[27], 27)}
    alignments.write_sam(reads, str(tmp_path / "out"))
    again = alignments.read_sam(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, reads.collect()))


def test_vcf(spark, tmp_path):
    text = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tb\ta\n1\t10\trs1\tA\tG,T\t31.5\tPASS\tAF=0.5;DB\tGT:DP\t0/1:3\t./.\n1\t20\t.\tC\tT\t.\t.\t.\tGT\t1|1\t0/0\n"
    (tmp_path / "a.vcf").write_text(text)
    v = variants.read_vcf(spark, str(tmp_path / "a.vcf"))
    first = v.orderBy("pos").first()
    assert (first["alts"], first["info"], first["filters"], first["samples"][0]) == (["G", "T"], {"AF": "0.5", "DB": ""}, ["PASS"], {"GT": "0/1", "DP": "3"})
    names = variants.sample_names(spark, str(tmp_path / "a.vcf"))
    got = {(r["pos"], r["sample"]): r["gt"] for r in variants.genotypes(v, names).collect()}
    assert got == {(10, "b"): 1, (10, "a"): None, (20, "b"): 2, (20, "a"): 0}
    calls = v.select("chrom", "pos", "ref", F.col("alts")[0].alias("alt"), F.lit("0/1:9").alias("s0"))
    variants.write_vcf(calls, str(tmp_path / "out"), 1)
    assert sorted(r["pos"] for r in variants.read_vcf(spark, str(tmp_path / "out")).collect()) == [10, 20]


def test_gtf_and_missing_genes(spark, tmp_path):
    text = '#c\n1\tx\tgene\t5\t90\t.\t+\t.\tgene_id "g1"; gene_name "N1"; gene_type "protein_coding";\n1\tx\texon\t7\t20\t.\t-\t.\tgene_id "g2"; gene_type "lincRNA"; tag "a"; tag "b";\n1\tx\tfive_prime_utr\t1\t2\t.\t+\t.\tgene_id "g3"; gene_type "junk";\n'
    (tmp_path / "a.gtf").write_text(text)
    gtf = tables.read_gtf(spark, str(tmp_path / "a.gtf"), tables.COMMON_GENE_TYPES, add_chr=True)
    assert sorted((r["gene_id"], r["chrom"], r["beg"]) for r in tables.genes(gtf, True).collect()) == [("g1", "chr1", 5), ("g2", "chr1", 7)]
    assert [r["gene_id"] for r in tables.genes(gtf).collect()] == ["g1"]


def test_pileup_and_matrix_files(spark, tmp_path):
    obs = spark.createDataFrame([(1, 1, 1, 0, 14), (1, 1, 2, 1, 40), (2, 1, 1, 2, 20)], "cell_id long, snp_id long, umi long, allele int, bq int")
    rows = pileup.pileup_strings(obs)
    cells = spark.createDataFrame([(1, "AA", 3, 2, 2, 1)], "cell_id long, barcode string, n_read long, n_umi long, n_umi_w_snp long, n_snp long")
    snps = spark.createDataFrame([(1, "1", 10, "A", "G", 0.25)], "snp_id long, chrom string, pos long, ref string, alt string, af double")
    tables.write_pileup(str(tmp_path / "p"), cells, snps, rows)
    c, s, r = tables.read_pileup(spark, str(tmp_path / "p"))
    assert c.collect() == cells.collect() and s.collect() == snps.collect()
    assert sorted(map(tuple, r.collect())) == sorted(map(tuple, rows.collect()))
    assert sorted((x["cell_id"], x["allele"], x["bq"]) for x in pileup.parse_pileup_strings(r).collect()) == [(1, 0, 14), (1, 1, 40), (2, 2, 20)]
    counts = spark.createDataFrame([("g1", 1, 3), ("g2", 1, 1), ("g2", 7, 2)], "element string, cell_id long, n_umi long")
    tables.write_matrix(counts, str(tmp_path / "m"))
    assert sorted(map(tuple, tables.read_matrix(spark, str(tmp_path / "m/matrix.mtx")).collect())) == [(1, 1, 3), (2, 1, 1), (2, 2, 2)]


def test_sequences_from_files(spark, tmp_path):
    (tmp_path / "a.fq").write_text("".join(f"@r{k} x\n{'ACGT'[: k % 4 + 1]}\n+\n{'@@@@'[: k % 4 + 1]}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    rows = sequences.fastq(sequences.numbered_lines(spark, str(tmp_path / "a.fq"))).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["record"], r["name"], r["seq"]) for r in rows) == [(k, f"r{k}", "ACGT"[: k % 4 + 1]) for k in range(5000)]
    (tmp_path / "a.fa").write_text(">c1 first\nacgt\nTTTT\ngg\n>c2\nNNCC\nA\n")
    stretches = sequences.blocks(sequences.fasta(sequences.numbered_lines(spark, str(tmp_path / "a.fa")).select("at", "value")), 4)
    points = spark.createDataFrame([("c1", 2), ("c1", 5), ("c1", 10), ("c2", 3), ("c2", 5)], "chrom string, pos long")
    assert sorted(map(tuple, sequences.bases_at(stretches, points, 4).select("chrom", "pos", "base").collect())) == [("c1", 2, "C"), ("c1", 5, "T"), ("c1", 10, "G"), ("c2", 3, "C"), ("c2", 5, "A")]


def test_tables_stop_and_chunks_are_written(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x 1 2.5\ny z 3\n\nq 1 1\n")
    got = tables.read_tsv(spark, str(tmp_path / "a.tsv"), {"name": "string", "n": "int", "v": "double"}).collect()
    assert sorted(map(tuple, got), key=str) == [("x", 1, 2.5), ("y", None, 3.0)]
    tables.write_chunks(spark.createDataFrame([(k % 3, f"b{k}") for k in range(9)], "chunk int, barcode string"), str(tmp_path / "chunks"))
    assert sorted(p.name for p in (tmp_path / "chunks").iterdir() if p.is_dir()) == ["chunk=0", "chunk=1", "chunk=2"]


def test_filtered_variants_and_other_header(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("1\t10\t.\tA\tG\t30\tPASS\tDP=9\tGT\t0/2\t1/.\n1\t20\t.\tC\tT\t9\tq10\tDP=3\tGT\t1\t0/0\n1\t20\t.\tC\tA\t9\tPASS\tDP=30\tGT\t1|1\t0/0\n")
    (tmp_path / "a.vcf.hdr").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\tt\n")
    path = str(tmp_path / "a.vcf")
    assert variants.sample_names(spark, path, header=path + ".hdr") == ["s", "t"]
    deep = F.col("info")["DP"].cast("int") > 5
    assert [r["pos"] for r in variants.read_variants(spark, path, include=deep, filters=["PASS"]).orderBy("pos").collect()] == [10, 20]
    assert [r["alts"] for r in variants.read_variants(spark, path, exclude=deep).collect()] == [["T"]]
    keys = spark.createDataFrame([("1", 20, "C", "T"), ("1", 10, "A", "C")], "chrom string, pos long, ref string, alt string")
    assert [r["alts"] for r in variants.read_variants(spark, path, keys=keys).collect()] == [["T"]]
    calls = {(r["pos"], r["alt"], r["sample"]): (r["alleles"], r["gt"]) for r in variants.genotypes(variants.read_vcf(spark, path), ["s", "t"]).collect()}
    assert calls[10, "G", "s"] == ([0, 2], 1) and calls[10, "G", "t"] == ([1, None], None) and calls[20, "T", "s"] == ([1], 1) and calls[20, "A", "s"] == ([1, 1], 2)


def test_uneven_lines_over_many_ranges(spark, tmp_path):
    rng = np.random.default_rng(0)
    wanted, lines = {}, ["junk before any header"]
    for k in range(6):
        lines.append(f">s{k} note")
        wanted[f"s{k}"] = ""
        for _ in range(int(rng.integers(0, 60))):
            part = "".join(rng.choice(list("acgtACGTN"), int(rng.integers(0, 50))))
            wanted[f"s{k}"] += part.upper()
            lines.append(part)
    (tmp_path / "u.fa").write_text("\n".join(lines) + "\n")
    numbered = sequences.numbered_lines(spark, str(tmp_path / "u.fa")).select("at", "value").repartition(5)
    stretches = sequences.fasta(numbered)
    blocks = sequences.blocks(stretches, 17).cache()
    got = {}
    for r in blocks.orderBy("chrom", "pos0").collect():
        assert r["pos0"] == len(got.get(r["chrom"], "")) and len(r["seq"]) <= 17
        got[r["chrom"]] = got.get(r["chrom"], "") + r["seq"]
    assert got == {k: v for k, v in wanted.items() if v}
    spans = [(i, f"s{i % 6}", 1 + 13 * i % 400, 1 + 13 * i % 400 + i % 70) for i in range(80)]
    found = {r["key"]: r["bases"] for r in sequences.bases_between(blocks, spark.createDataFrame(spans, "key long, chrom string, beg long, end long"), 17).collect()}
    assert all(found.get(k, "") == wanted[c][a - 1 : b] for k, c, a, b in spans)
    assert "BroadcastNestedLoopJoin" not in stretches._jdf.queryExecution().toString()


def test_a_long_repeat_moves_to_its_begin(spark):
    genome = "G" + "AC" * 5000 + "T" + "ACGT" * 10
    blocks = spark.createDataFrame([("1", a, genome[a : a + 1024]) for a in range(0, len(genome), 1024)], "chrom string, pos0 long, seq string")
    rows = spark.createDataFrame([(1, "1", 9990, "ACACA", "A"), (2, "1", 9991, "C", "CAC"), (3, "1", 10003, "A", "T"), (4, "1", 1, "G", "GA"), (5, "2", 50, "CA", "CACA"), (6, "1", 700, "A", "A"), (7, "1", 3, "CAC", "C")], "id int, chrom string, pos long, ref string, alt string")
    got = {r["id"]: (r["pos"], r["ref"], r["alt"]) for r in alleles.normalized_by_reference(rows, blocks, 1024).collect()}
    assert got == {1: (1, "GACAC", "G"), 2: (1, "G", "GAC"), 3: (10003, "A", "T"), 4: (1, "G", "GA"), 5: (50, "C", "CAC"), 6: (700, "A", "A"), 7: (1, "GAC", "G")}


def test_repeated_keys_and_extra_values_do_no_harm(spark, tmp_path):
    (tmp_path / "bad.vcf").write_text("1\t10\t.\tA\tG,T\t.\tPASS\tDP=9;DP=1;AF=0.5;H2;H2\tGT:DP:GT\t0/1:7:1/1:extra:more\t1/2\t.\n1\t11\n")
    rows = {r["pos"]: r for r in variants.read_vcf(spark, str(tmp_path / "bad.vcf")).collect()}
    assert rows[10]["info"] == {"DP": "9", "AF": "0.5", "H2": ""} and rows[10]["samples"] == [{"GT": "0/1", "DP": "7"}, {"GT": "1/2"}, {"GT": "."}]
    keys = lambda *k: spark.createDataFrame(list(k), "chrom string, pos long, ref string, alt string")
    found = variants.read_vcf(spark, str(tmp_path / "bad.vcf"))
    assert [variants.extracted(found, keys(("1", 10, "A", x))).count() for x in ("G,T", "G", "T,G")] == [1, 0, 0]
    (tmp_path / "bad.sam").write_text("r1\t0\t1\t5\t60\t3M\t*\t0\t0\tACG\tIII\tCB:Z:x\tUB:Z:u\tCB:Z:y\nr2\t0\n")
    got = {r["qname"]: r["tags"] for r in alignments.read_sam(spark, str(tmp_path / "bad.sam")).collect()}
    assert got["r1"] == {"CB": "x", "UB": "u"} and not got["r2"]
