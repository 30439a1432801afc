import numpy as np
import pytest

from dropletry.operators import demultiplex
from dropletry.sources import alignments, variants


def files(folder, donors=4, cells=8, snps=150, per_cell=160, seed=0):
    """A SAM and a VCF file of planted droplets: even ones hold a donor, odd ones two."""
    rng = np.random.default_rng(seed)
    gt = rng.binomial(2, rng.uniform(0.2, 0.8, snps)[:, None], (snps, donors))
    lines = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *(f"d{k}" for k in range(donors))])]
    text = {0: "0/0", 1: "0|1", 2: "1/1"}
    for v in range(snps):
        lines.append("\t".join(["1", str(100 + 10 * v), ".", "A", "G", ".", "PASS", "R2=0.9", "GT", *(text[int(g)] if rng.random() > 0.03 else "./." for g in gt[v])]))
    lines += ["1\t5000\t.\tA\tG,T\t.\t.\t.\tGT" + "\t1/2" * donors, "1\t5010\t.\tAC\tA\t.\t.\t.\tGT" + "\t0/1" * donors]
    (folder / "a.vcf").write_text("\n".join(lines) + "\n")
    truth, sam = {}, ["@HD\tVN:1.6"]
    for c in range(cells):
        own = rng.choice(donors, 1 + c % 2, replace=False).tolist()
        truth[f"BC{c:02d}"] = sorted(f"d{k}" for k in own)
        for u, v in enumerate(rng.integers(0, snps, per_cell).tolist()):
            base = "AG"[int(rng.random() < gt[v, own[int(rng.integers(len(own)))]] / 2)]
            for _ in range(int(rng.integers(1, 3))):  # copies of a molecule
                sam.append(f"r{c}_{u}\t0\t1\t{98 + 10 * v}\t60\t5M\t*\t0\t0\tCC{base}CC\tIIIII\tCB:Z:BC{c:02d}\tUB:Z:u{u}")
    sam += ["low\t0\t1\t98\t3\t5M\t*\t0\t0\tCCACC\tIIIII\tCB:Z:BC00\tUB:Z:x", "none\t0\t1\t98\t60\t5M\t*\t0\t0\tCCACC\tIIIII", "n\t0\t1\t98\t60\t5M\t*\t0\t0\tCCNCC\tIIIII\tCB:Z:FEW\tUB:Z:x", "few\t0\t1\t98\t60\t5M\t*\t0\t0\tCCACC\tIIIII\tCB:Z:FEW\tUB:Z:y"]
    (folder / "a.sam").write_text("\n".join(sam) + "\n")
    return truth


def test_files_to_calls(spark, tmp_path):
    truth = files(tmp_path)
    reads, records = alignments.read_sam(spark, str(tmp_path / "a.sam")), variants.read_vcf(spark, str(tmp_path / "a.vcf"))
    names = variants.sample_names(spark, str(tmp_path / "a.vcf"))
    found = demultiplex.call(reads, records, names, demultiplex.Options(min_snp=5))
    assert len(found.columns) == 20
    rows = {r["barcode"]: r for r in found.collect()}
    assert set(rows) == set(truth)
    for k, (barcode, own) in enumerate(sorted(truth.items())):
        r = rows[barcode]
        assert r["int_id"] == k and 130 < r["num_reads"] <= 160 and r["num_snps"] <= 150
        assert r["droplet_type"] == ("SNG", "DBL")[k % 2], r
        assert sorted(set(r["best_guess"].split(",")[:2])) == own and r["best_guess"].endswith((",0.00", ",0.50")[k % 2])
        assert r["diff_llk_best_next"] == pytest.approx(r["best_llk"] - r["next_llk"]) and 0.9 < r["best_posterior"] <= 1.0
        assert r["diff_llk_sng_dbl"] == pytest.approx(r["sng_best_llk"] - r["dbl_best_llk"])
    listed = spark.createDataFrame([("BC03",), ("BC99",)], "barcode string")
    only = demultiplex.call(reads, records, names, demultiplex.Options(alphas=(0.0, 0.3, 0.5), coefficient=0.2), listed).collect()
    assert [r["barcode"] for r in only] == ["BC03"] and only[0]["droplet_type"] == "DBL" and sorted(only[0]["best_guess"].split(",")[:2]) == truth["BC03"]


def test_panel_of_genotypes(spark):
    lines = ["1\t5\t.\tA\tG\t.\t.\t.\tGT:GP:PL\t0/1:0.1,0.7,0.2:30,0,40\t1:.:.\t./.:0,0,2:0,10,20", "1\t9\t.\tA\tG\t.\t.\t.\tGT\t0/0\t0/0\t0/0", "1\t7\t.\tA\tG\t.\t.\t.\tGT\t./.\t./.\t0/1"]
    records = variants.parse_vcf(spark.createDataFrame([(x,) for x in lines], "value string"))
    af = 3.5 / 5
    prior = [(1 - af) ** 2, 2 * af * (1 - af), af**2]
    plain = demultiplex.Options(offset=0.0)
    (r,) = demultiplex.genotype_panel(records, plain).collect()  # 9 has no rare allele, 7 too few calls
    assert (r["snp_id"], r["pos"], r["af"]) == (0, 5, pytest.approx(af))
    assert r["p"] == pytest.approx([0.005, 0.99, 0.005, 0.005, 0.005, 0.99, *prior])
    (r,) = demultiplex.genotype_panel(records, demultiplex.Options(field="GP", offset=0.0)).collect()
    assert r["p"] == pytest.approx([0.1, 0.7, 0.2, *prior, 0, 0, 1], abs=1e-6)
    (r,) = demultiplex.genotype_panel(records, demultiplex.Options(field="PL", offset=0.0)).collect()
    like = np.array([[1e-3, 1, 1e-4], [1, 1, 1], [1, 0.1, 0.01]]) * prior
    assert r["p"] == pytest.approx((like / like.sum(axis=1, keepdims=True)).ravel())
    (r,) = demultiplex.genotype_panel(records).collect()
    whole = np.array([[0.005, 0.99, 0.005], [0.005, 0.005, 0.99], prior])
    assert r["p"] == pytest.approx((0.9 * whole + 0.1 * whole.mean(axis=0)).ravel())
    with pytest.raises(Exception, match="has no R2"):
        demultiplex.genotype_panel(records, demultiplex.Options(coefficient=0.1)).collect()
