import numpy as np
import pytest

from dropletry.operators import genotypes, multiallelic


def brute(k, rows, rounds):
    """Frequencies and posteriors of one variant: rows of (ploidy, likelihoods)."""
    order = [(a, b) for b in range(k) for a in range(b + 1)]
    af = [1 / k] * k
    for _ in range(rounds):
        new, an, post = [0.0] * k, 0, []
        for ploidy, l in rows:
            if ploidy not in (1, 2):
                post.append(None)
                continue
            l = l or [1.0] * len(order)
            g = [(af[a] if a == b else 0.0) if ploidy == 1 else (1 if a == b else 2) * af[a] * af[b] for a, b in order]
            g = [x * y for x, y in zip(g, l)]
            g = [x / sum(g) for x in g]
            for x, (a, b) in zip(g, order):
                for allele in (a, b):
                    new[allele] += x * ploidy / 2
            an += ploidy
            post.append(g)
        af = [x / an for x in new] if an else af
    return af, post


def test_frequencies_and_posteriors(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for snp in range(30):
        k = int(rng.integers(2, 5))
        samples = [(int(rng.integers(0, 3)), rng.uniform(0.001, 1, k * (k + 1) // 2).tolist() if rng.random() > 0.2 else None) for _ in range(7)]
        samples[0] = (2, [1.0] * (k * (k + 1) // 2))
        want[snp] = brute(k, samples, 10)
        rows += [(snp, s, k, ploidy, l) for s, (ploidy, l) in enumerate(samples)]
    rows += [(99, 0, 3, 0, None)]
    df = spark.createDataFrame(rows, "snp_id long, sample int, n_allele int, ploidy int, l array<double>")
    af = {r["snp_id"]: r["af"] for r in multiallelic.frequencies_by_em(df).collect()}
    assert af[99] == pytest.approx([1 / 3] * 3)
    for r in multiallelic.likelihood_posteriors(df).where("snp_id < 99").collect():
        p = want[r["snp_id"]][1][r["sample"]]
        assert af[r["snp_id"]] == pytest.approx(want[r["snp_id"]][0]) and (r["p"] is None if p is None else r["p"] == pytest.approx(p))


def test_two_alleles_equal_the_plain_form(spark):
    rng = np.random.default_rng(1)
    rows = [(v, s, *rng.uniform(0.01, 1, 3).tolist()) for v in range(12) for s in range(5)]
    df = spark.createDataFrame(rows, "snp_id long, sample int, l0 double, l1 double, l2 double")
    plain = {r["snp_id"]: r["af"] for r in genotypes.frequency_by_em(df, 10).collect()}
    many = multiallelic.frequencies_by_em(df.selectExpr("snp_id", "2 AS n_allele", "2 AS ploidy", "array(l0, l1, l2) AS l"))
    assert {r["snp_id"]: r["af"][1] for r in many.collect()} == pytest.approx(plain)


def test_calls_of_three_alleles_and_one_copy(spark):
    rows = [(1, 0, 3, 2, [0, 2]), (1, 1, 3, 2, [1, 1]), (1, 2, 3, 1, [2]), (1, 3, 3, 2, None), (1, 4, 3, 1, [None]), (1, 5, 3, 0, None), (2, 0, 2, 2, [None, 1])]
    df = spark.createDataFrame(rows, "snp_id long, sample int, n_allele int, ploidy int, gt array<int>")
    p = {(r["snp_id"], r["sample"]): r["p"] for r in multiallelic.call_posteriors(df, 0.05).collect()}
    rest = 0.05 / 5
    assert p[1, 0] == pytest.approx([rest, rest, rest, 0.95, rest, rest]) and p[1, 1] == pytest.approx([rest, rest, 0.95, rest, rest, rest])
    assert p[1, 2] == pytest.approx([rest] * 5 + [0.95])
    f = [(n + 1 / 3) / 6 for n in (1, 2, 2)]
    assert p[1, 3] == pytest.approx([f[0] ** 2, 2 * f[0] * f[1], f[1] ** 2, 2 * f[0] * f[2], 2 * f[1] * f[2], f[2] ** 2])
    assert p[1, 4] == pytest.approx([f[0], 0, f[1], 0, 0, f[2]]) and p[1, 5] is None
    assert p[2, 0] == pytest.approx([0.25, 0.5, 0.25])


def test_no_table_of_variants_is_broadcast(spark):
    df = spark.range(18).selectExpr("id DIV 3 AS snp_id", "id % 3 AS sample", "3 AS n_allele", "CAST(id DIV 3 % 2 * 2 AS INT) AS ploidy", "array(0.5D, 0.1D, 0.2D, 0.3D, 0.4D, id + 1.0D) AS l")
    found = multiallelic.likelihood_posteriors(df)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["snp_id"]: r["p"] is None for r in found.collect()} == {v: v % 2 == 0 for v in range(6)}


def test_likelihoods_of_another_number_of_alleles_fail(spark):
    df = spark.createDataFrame([(1, 0, 3, 2, [0.5, 0.1, 0.2]), (1, 1, 3, 2, [0.5, 0.1, 0.2, 0.3, 0.4, 0.1, 0.7, 0.8, 0.9])], "snp_id long, sample int, n_allele int, ploidy int, l array<double>")
    with pytest.raises(Exception, match="all genotypes"):
        multiallelic.frequencies_by_em(df).collect()
