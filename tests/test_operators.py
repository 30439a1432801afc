"""Hand-made cases: closed forms, edges and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dropletry.functions.phred import error_probability
from dropletry.functions import filters
from dropletry.operators import alleles, clusters, demux, genotypes, intervals, likelihood, pileup, ranking, reads


def test_phred_edges(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (20,)], "bq int").select(error_probability(F.col("bq"))).collect()
    assert [round(r[0], 9) for r in rows] == [0.75, 0.75, round(10**-0.2, 9), 0.01]


def test_first_read_of_a_umi_counts(spark):
    rows = spark.createDataFrame([(1, 1, "u", 1, 30, 2), (1, 1, "u", 0, 20, 1), (1, 1, "v", 2, 40, 3)], "snp_id long, cell_id long, umi string, allele int, bq int, at long")
    got = {r["umi"]: (r["allele"], r["bq"], r["n_dup"]) for r in pileup.dedup_umis(rows, ["at"]).collect()}
    assert got == {"u": (0, 20, 2), "v": (2, 40, 1)}


def test_tail_distance(spark):
    rows = spark.createDataFrame([(30, r, 100) for r in (3, 4, 95, 96)], "bq int, rpos int, read_len int")
    assert sorted(r["rpos"] for r in reads.usable_bases(rows, min_tail=5).collect()) == [4, 95]


@pytest.mark.parametrize("touching, wanted", [(False, [(1, 5), (6, 9)]), (True, [(1, 9)])])
def test_adjacent_intervals(spark, touching, wanted):
    rows = spark.createDataFrame([("1", 1, 5), ("1", 6, 9), ("1", 2, 3)], "chrom string, beg long, end long")
    assert sorted((r["beg"], r["end"]) for r in intervals.merge_overlaps(rows, touching).collect()) == wanted


def test_range_join_against_all_pairs(spark):
    r = random.Random(1)
    a = [("1", i, b, b + r.randint(0, 40)) for i, b in enumerate(r.choices(range(500), k=80))]
    b = [("1", i, x, x + r.randint(0, 90)) for i, x in enumerate(r.choices(range(500), k=60))]
    left = spark.createDataFrame(a, "chrom string, i long, a_beg long, a_end long")
    right = spark.createDataFrame(b, "chrom string, j long, b_beg long, b_end long")
    got = sorted((x["i"], x["j"]) for x in intervals.range_join(left, right, 16).collect())
    assert got == sorted((p[1], q[1]) for p in a for q in b if p[2] <= q[3] and q[2] <= p[3])


def test_one_reference_read(spark):
    rows = spark.createDataFrame([(1, 1, "u", 0, 20), (2, 1, "u", 2, 20)], "cell_id long, snp_id long, umi string, allele int, bq int")
    got = {r["cell_id"]: [r[f"g{k}"] for k in range(9)] for r in likelihood.genotype_pairs(rows).collect()}
    raw = [0.99 * (1 - (a + b) / 4) + 0.01 / 4 for a in range(3) for b in range(3)]
    assert all(math.isclose(x, y / sum(raw), rel_tol=1e-9) for x, y in zip(got[1], raw))
    assert all(math.isclose(x, 1 / 9) for x in got[2])


def test_call_margins(spark):
    cols = "cell_id long, sng_best int, sng_best_llk double, sng_next int, sng_next_llk double, dbl_best int, dbl_best2 int, dbl_best_llk double, dbl_next int, dbl_next2 int, dbl_next_llk double"
    rows = [(1, 0, -10.0, 1, -11.0, 1, 0, -7.9, 2, 0, -20.0), (2, 0, -10.0, 1, -12.1, 1, 0, -8.0, 2, 0, -20.0), (3, 0, -10.0, 1, -12.0, 1, 0, -30.0, 2, 0, -40.0)]
    got = {r["cell_id"]: (r["type"], r["best_guess"], r["next_guess"]) for r in demux.calls(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: ("DBL", "1,0", "0,0"), 2: ("SNG", "0,0", "1,0"), 3: ("AMB", "0,0", "1,1")}


def test_priors_need_two_donors():
    with pytest.raises(ValueError):
        demux.log_priors(1, 2, 0.5)


def test_greedy_seeds_open_an_empty_cluster(spark):
    sure = {0: (0.98, 0.01, 0.01), 2: (0.01, 0.01, 0.98)}
    gl = [(c, s, 1, *[sure[g][k // 3] if k % 4 == 0 else 0.001 for k in range(9)]) for c, g in ((1, 0), (2, 2), (3, 0)) for s in range(6)]
    gl = spark.createDataFrame(gl, "cell_id long, snp_id long, n_obs long, " + ", ".join(f"g{k} double" for k in range(9)))
    snps = spark.createDataFrame([(s, 0.5) for s in range(6)], "snp_id long, af double")
    order = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "cell_id long, rank int")
    assert {r["cell_id"]: r["cluster"] for r in clusters.greedy_seeds(gl, snps, order, 2).collect()} == {1: 0, 2: 1, 3: 0}


def test_greedy_seeds_place_every_droplet_in_strict_order(spark):
    r = random.Random(5)
    gl, af, kinds = [], {s: r.uniform(0.1, 0.9) for s in range(30)}, [[r.randint(0, 2) for _ in range(30)] for _ in range(3)]
    for c in range(60):
        for s in r.sample(range(30), 8):
            # Half of the droplets tell little, so that their place depends on those before them.
            g = [r.uniform(0.3, 0.5) if c % 2 else 0.05 + 0.9 * (kinds[c % 3][s] == x) for x in range(3)]
            gl.append((c, s, 1, *[g[k // 4] / sum(g) if k % 4 == 0 else 0.01 for k in range(9)]))
    rank = {c: i + 1 for i, c in enumerate(r.sample(range(60), 60))}

    def strict(last):
        held, out = [{} for _ in range(3)], {}
        for c in sorted(rank, key=rank.get)[:last]:
            mine = {x[1]: (x[3], x[7], x[11]) for x in gl if x[0] == c}
            scores = []
            for h in held:
                score = 0.0
                for s in sorted(mine.keys() & h.keys()):
                    p = ((1 - af[s]) ** 2, 2 * af[s] * (1 - af[s]), af[s] ** 2)
                    score += math.log(sum(a * b * q for a, b, q in zip(mine[s], h[s], p))) - math.log(sum(a * q for a, q in zip(mine[s], p)) * sum(b * q for b, q in zip(h[s], p)))
                scores.append(score)
            out[c] = scores.index(max(scores))
            for s, own in mine.items():
                m = [a * b for a, b in zip(own, held[out[c]].get(s, (1, 1, 1)))]
                m = [max(x / sum(m), 1e-6) for x in m]
                held[out[c]][s] = [x / sum(m) for x in m]
        return out

    frame = spark.createDataFrame(gl, "cell_id long, snp_id long, n_obs long, " + ", ".join(f"g{k} double" for k in range(9)))
    snps = spark.createDataFrame(list(af.items()), "snp_id long, af double")
    order = spark.createDataFrame(list(rank.items()), "cell_id long, rank int")

    def got(**settings):
        return {x["cell_id"]: x["cluster"] for x in clusters.greedy_seeds(frame, snps, order, 3, **settings).collect()}

    assert len(set(strict(60).values())) == 3
    assert got(seeds=10) == got(seeds=10, rounds=2) == got() == strict(60)
    assert got(seeds=10, fraction=0.5) == strict(31)  # the reference takes the droplet at the fraction in


GL = "cell_id long, snp_id long, n_obs long, " + ", ".join(f"g{k} double" for k in range(9))


def test_pair_distances(spark):
    r = random.Random(3)
    gl = [(c, s, 1, *[r.random() for _ in range(9)]) for c in range(4) for s in range(5) if (c + s) % 4]
    af = {s: 0.1 + 0.15 * s for s in range(5)}
    got = {(x["cell_id"], x["other_id"]): (x["n_snp"], x["llk0"], x["llk2"]) for x in likelihood.pair_distances(spark.createDataFrame(gl, GL), spark.createDataFrame(list(af.items()), "snp_id long, af double")).collect()}
    wanted = {}
    for a in gl:
        for b in gl:
            if a[1] == b[1] and a[0] > b[0]:
                q = af[a[1]]
                p, u, v = ((1 - q) ** 2, 2 * q * (1 - q), q * q), a[3::4], b[3::4]
                n, x, y = wanted.get((a[0], b[0]), (0, 0, 0))
                wanted[a[0], b[0]] = (n + 1, x + math.log(sum(u[i] * v[j] * p[i] * p[j] for i in range(3) for j in range(3))), y + math.log(sum(u[i] * v[i] * p[i] for i in range(3))))
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k]) for k in got)


def test_removed_pileup(spark):
    a, b = [0.02 * (k + 1) for k in range(9)], [0.03 * (9 - k) for k in range(9)]
    both = [x * y / sum(p * q for p, q in zip(a, b)) for x, y in zip(a, b)]
    gl = spark.createDataFrame([(1, 1, 5, *both), (1, 2, 3, *a)], GL)
    got = {x["snp_id"]: tuple(x)[2:] for x in likelihood.removed(gl, spark.createDataFrame([(1, 1, 2, *b)], GL)).collect()}
    assert got[1] == pytest.approx((3, *(x / sum(a) for x in a))) and got[2] == pytest.approx((3, *a))


def test_dosage_counts(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 2.0), (1, None), (1, float("nan")), (2, None)], "snp_id long, ds double")
    assert sorted(map(tuple, genotypes.dosage_counts(rows).collect())) == [(1, 4, 4, 2.5, 0.625), (2, 1, 0, 0.0, None)]


RECORDS = [(1, 50.0, [1.0, None], ["hom", "x"], [10.0, 30.0], [5.0, 50.0]), (2, None, [], None, [40.0, 1.0], [1.0, 60.0]), (3, 20000000.0, [3.0], ["y"], [None, 2.0], [7.0, 8.0])]


def test_filters(spark):
    df = spark.createDataFrame(RECORDS, "id long, QUAL double, AC array<double>, NAME array<string>, DP array<double>, GQ array<double>")
    qual, ac, dp, gq = F.array("QUAL"), F.col("AC"), F.col("DP"), F.col("GQ")
    cases = [
        (filters.any_value(qual, ">", 30), {1, 3}), (filters.any_value(ac, "==", 1), {1}), (filters.any_value(ac, "!=", 1), {1, 2, 3}), (filters.any_value(qual, "!=", 50), {2, 3}),
        (filters.any_value(qual, "==", F.lit(None).cast("double")), {2}), (filters.any_value(dp, ">", 20) & filters.any_value(gq, ">", 40), {1, 2}),
        (filters.same_sample(filters.by_sample(dp, ">", 20), filters.by_sample(gq, ">", 40)), {1}), (filters.passing_samples(filters.by_sample(dp, ">", 5)) == 2, {1}),
        (filters.total(ac) * 2 == 6, {3}), (filters.stdev(dp) == 10, {1}), (filters.any_value(filters.at(dp, 1), "<", 2) & filters.any_value(qual, "<", 1), set()), (filters.median(gq) > 27, {1, 2}),
    ]
    for test, wanted in cases:
        assert {r["id"] for r in df.where(test).collect()} == wanted, test


def test_normal_form_against_single_steps(spark):
    """Trimming and extending base by base, as the definition has it."""
    r = random.Random(4)
    rows = []
    for k in range(300):
        before = "".join(r.choice("AC") for _ in range(r.randint(1, 9)))
        rows.append((k, 100, "".join(r.choice("AC") for _ in range(r.randint(1, 5))), "".join(r.choice("AC") for _ in range(r.randint(1, 5))), before))

    def steps(pos, ref, alt, before):
        if ref == alt:
            return pos, ref, alt
        while True:
            if ref and alt and ref[-1] == alt[-1] and (before or min(len(ref), len(alt)) > 1):
                ref, alt = ref[:-1], alt[:-1]
            elif not ref or not alt:
                before, base = before[:-1], before[-1]
                pos, ref, alt = pos - 1, base + ref, base + alt
            else:
                break
        while min(len(ref), len(alt)) > 1 and ref[0] == alt[0]:
            pos, ref, alt = pos + 1, ref[1:], alt[1:]
        return pos, ref, alt

    df = spark.createDataFrame(rows, "k long, pos long, ref string, alt string, before string")
    got = {x["k"]: tuple(x["v"]) for x in df.select("k", alleles.normalized(F.col("pos"), F.col("ref"), F.col("alt"), F.col("before")).alias("v")).collect()}
    assert got == {k: steps(*row) for k, *row in rows}


def test_numbering_goes_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    got = ranking.numbered(rows, "at", F.desc("v")).collect()
    assert all(r["at"] == 999 - r["v"] for r in got) and len(got) == 1000


def test_intervals_over_bin_borders(spark):
    r = random.Random(5)
    rows = [("1", b, b + r.choice([0, 3, 40, 300])) for b in r.sample(range(3000), 150)]
    merged, wanted = [], []
    for _, b, e in sorted(rows):
        if wanted and b <= wanted[-1][1]:
            wanted[-1][1] = max(wanted[-1][1], e)
        else:
            wanted.append([b, e])
    df = spark.createDataFrame(rows, "chrom string, beg long, end long")
    for width in (16, 100, 1 << 16):
        merged = sorted([x["beg"], x["end"]] for x in intervals.merge_overlaps(df, width=width).collect())
        assert merged == wanted


def test_stream_of_observations(spark, tmp_path):
    from dropletry.streaming import pileup as stream

    rows = [(1, 1, "u", f"2024-01-01 00:0{k}:00") for k in range(3)] + [(1, 1, "v", "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "snp_id long, cell_id long, umi string, t string").select("snp_id", "cell_id", "umi", F.col("t").cast("timestamp").alias("t")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("snp_id long, cell_id long, umi string, t timestamp").parquet(str(tmp_path / "in"))
    query = stream.dedup_umis(source, "t").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["umi"] for r in spark.table("seen").collect()) == ["u", "v"]
