import random

import pytest
from pyspark.sql import functions as F

from dropletry.operators import clusters, likelihood, packed

GL = "cell_id long, snp_id long, n_obs long, " + ", ".join(f"g{k} double" for k in range(9))


def unclear(cells, snps, each, seed=0):
    """Likelihoods of droplets that hold no few genotypes, and frequencies."""
    r = random.Random(seed)
    rows = []
    for c in range(cells):
        for s in r.sample(range(snps), each):
            g = [r.uniform(0.01, 1) for _ in range(9)]
            rows.append((c, s, 1, *[x / sum(g) for x in g]))
    return rows, [(s, r.uniform(0.1, 0.9)) for s in range(snps)]


def test_packed_scores_equal_those_of_rows(spark, monkeypatch):
    rows, af = unclear(20, 40, 9)
    gl, snps = spark.createDataFrame(rows, GL), spark.createDataFrame(af[3:], "snp_id long, af double")
    want = {r["cell_id"]: r["score"] for r in likelihood.singlet_scores(gl, snps).collect()}
    monkeypatch.setattr(packed, "ENTRIES", 50)
    cells = packed.droplets(gl.repartition(3), [f"g{k}" for k in range(9)])
    assert packed.slices_of(cells) == 4
    found = packed.singlet_scores(cells, snps.repartition(3))
    assert {r["cell_id"]: r["score"] for r in found.collect()} == pytest.approx(want)
    back = packed.unpacked(found.withColumn("rank", F.lit(1).cast("long"))).select("cell_id", "snp_id", "af", "g0", "g4", "g8").collect()
    known = dict(af[3:])
    assert sorted(tuple(r) for r in back) == sorted((c, s, known[s], g[0], g[4], g[8]) for c, s, _, *g in rows if s in known)


def test_droplets_without_clear_clusters_take_two_walks(spark, monkeypatch):
    rows, af = unclear(60, 30, 8)
    gl, snps = spark.createDataFrame(rows, GL), spark.createDataFrame(af, "snp_id long, af double")
    order = spark.createDataFrame([(c, c + 1) for c in range(60)], "cell_id long, rank int")
    got = lambda **settings: {r["cell_id"]: r["cluster"] for r in clusters.greedy_seeds(gl, snps, order, 3, **settings).collect()}
    want, walks, walked = got(), [], clusters.walked
    monkeypatch.setattr(clusters, "walked", lambda *a: walks.append(a) or walked(*a))
    assert got(seeds=4, rounds=2) == want
    assert len(walks) <= 2 and len(set(want.values())) == 3


def test_packed_refinement_equals_that_of_rows(spark, monkeypatch):
    rows, af = unclear(40, 30, 12, seed=2)
    gl, snps = spark.createDataFrame(rows, GL), spark.createDataFrame(af, "snp_id long, af double")
    start = spark.createDataFrame([(c, c % 3) for c in range(35)], "cell_id long, cluster int")
    want = {r["cell_id"]: r.asDict() for r in clusters.em(gl, snps, start, 3, rounds=2).collect()}
    monkeypatch.setattr(packed, "ENTRIES", 100)
    found = clusters.em_packed(packed.of_likelihoods(gl, snps), start, 3, rounds=2).collect()
    assert len(found) == len(want) == 40
    for r in found:
        assert r.asDict() == pytest.approx(want[r["cell_id"]])
