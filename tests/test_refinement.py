import math

import numpy as np
from pyspark.sql import functions as F

from dropletry.operators import likelihood, refinement


def planted(cells, variants, k, reads, seed=0):
    """Bases of droplets that hold one of k genotypes each, the allele frequencies, and which they hold."""
    rng = np.random.default_rng(seed)
    af = rng.uniform(0.2, 0.8, variants)
    gt = rng.binomial(2, af[:, None], (variants, k))
    rows = []
    for c in range(cells):
        for umi, v in enumerate(rng.integers(0, variants, reads).tolist()):
            rows.append((c, v, umi, int((rng.random() < gt[v, c % k] / 2) != (rng.random() < 0.001)), 30))
    return rows, af


def one_by_one(votes, order, k, share, visits, noise, place):
    """The election and the visits droplet by droplet."""
    of, n = {}, len(order)
    against = {c: {} for c in order}
    for c, other, vote in votes:
        against[c][other] = vote

    def elect(c, seen, visit):
        tally = [noise[c, j, visit] for j in range(k)]
        for other, vote in against[c].items():
            if other in seen:
                tally[seen[other]] += vote
        return max(range(k), key=lambda j: (tally[j], -j))

    for i, c in enumerate(order):
        if i <= n * share:
            of[c] = elect(c, of, -1)
    first = dict(of)
    for visit in range(visits):
        was = dict(of)
        for c in sorted(order, key=lambda c: place[c, visit]):
            of[c] = elect(c, of, visit)
        if of == was:
            break
    return first, of


def test_election_and_visits_equal_a_walk(spark):
    share, k, cells, visits = 0.6, 3, 20, 1
    rng = np.random.default_rng(1)
    # Noisy votes, so that order and ties matter.
    pairs = [(a, b, (1 if (a % k == b % k) == (rng.random() < 0.75) else -1)) for a in range(cells) for b in range(a) if rng.random() < 0.3]
    frame = spark.createDataFrame([(a, b, 0.0, 9.0 * v) for a, b, v in pairs], "cell_id long, other_id long, llk0 double, llk2 double")
    votes = refinement.signed_votes(frame).cache()
    listed = [tuple(r) for r in votes.collect()]
    order = rng.permutation(cells).tolist()
    ranks = spark.createDataFrame([(c, i + 1) for i, c in enumerate(order)], "cell_id long, rank int").cache()
    turns = range(-1, visits)
    noise = ranks.select("cell_id", *(refinement.jitter(j, 5, v).alias(f"n{j}_{v}") for j in range(k) for v in turns), *(F.xxhash64("cell_id", F.lit(5), F.lit(v)).alias(f"p{v}") for v in range(visits))).collect()
    by = {(r["cell_id"], j, v): r[f"n{j}_{v}"] for r in noise for j in range(k) for v in turns}
    place = {(r["cell_id"], v): (r[f"p{v}"], r["cell_id"]) for r in noise for v in range(visits)}
    first, last = one_by_one(listed, order, k, share, visits, by, place)
    got = refinement.elected(votes, ranks, k, share, seed=5)
    assert {r["cell_id"]: r["cluster"] for r in got.collect()} == first
    seen = refinement.visited(votes, ranks, got, k, visits, seed=5)
    assert {r["cell_id"]: r["cluster"] for r in seen.collect()} == last


def test_planted_clusters_are_recovered(spark):
    k, cells = 3, 15
    rows, af = planted(cells, 50, k, 90)
    unique = spark.createDataFrame(rows, "cell_id long, snp_id long, umi long, allele int, bq int")
    gl = likelihood.genotype_pairs(unique).cache()
    snps = spark.createDataFrame([(v, float(a)) for v, a in enumerate(af)], "snp_id long, af double")
    order = likelihood.ranked(likelihood.singlet_scores(gl, snps)).select("cell_id", "rank").cache()
    before = []
    found = refinement.refined(gl, snps, order, k, threshold=2.0, share=0.5, visits=1, rounds=2, geno_error=0.0, each=lambda df: before.extend(df.collect()))
    rows = {r["cell_id"]: r for r in found.collect()}
    assert len(rows) == len(before) == cells
    single = {c: r["best_guess"].split(",")[0] for c, r in rows.items() if r["type"] == "SNG"}
    assert len(single) >= cells - 2
    assert len({(c % k, g) for c, g in single.items()}) == k
    assert all(math.isfinite(r["best_llk"]) for r in rows.values())


def test_missing_clusters_are_kept_or_filled(spark):
    votes = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 1, 1), (1, 3, 1)], "cell_id long, other_id long, vote int")
    cells = spark.createDataFrame([(1,), (2,), (3,), (4,)], "cell_id long")
    start = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "cell_id long, cluster int")
    kept = {r["cell_id"]: r["cluster"] for r in refinement.visited(votes, cells, start, 2, visits=1, keep_missing=True).collect()}
    assert kept == {1: 1, 2: 1, 3: None, 4: None}
    filled = {r["cell_id"]: r["cluster"] for r in refinement.visited(votes, cells, start, 2, visits=1).collect()}
    assert filled[1] == filled[2] == filled[3] == 1 and filled[4] in (0, 1)
