import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dropletry.operators import mixture


def planted(cells, genes, k, n, seed=0, doublets=0):
    """Counts of droplets that hold one component, the last ``doublets`` of them two."""
    rng = np.random.default_rng(seed)
    profile = rng.dirichlet(np.full(genes, 0.3), k)
    truth = [(c % k,) if c < cells - doublets else tuple(sorted(rng.choice(k, 2, replace=False).tolist(), reverse=True)) for c in range(cells)]
    x = np.stack([rng.multinomial(n, np.mean([profile[j] for j in t], axis=0)) for t in truth])
    return x, truth


def frame(spark, x):
    return spark.createDataFrame([(int(c), f"g{g:03d}", int(x[c, g])) for c, g in zip(*np.nonzero(x))], "cell_id long, gene string, n long")


def dense_em(x, w, k, doublet, alpha, rounds, tolerance):
    """The same over a full matrix, gene by gene."""
    pairs = [(a, b) for a in range(1, k) for b in range(a)] if doublet else []
    r, before = x + alpha, -math.inf
    for _ in range(rounds):
        half = w[:, :k].copy()
        for i, (a, b) in enumerate(pairs):
            half[:, a] += w[:, k + i] / 2
            half[:, b] += w[:, k + i] / 2
        pi = half.sum(axis=0) / half.sum()
        p = half.T @ r
        p /= p.sum(axis=1, keepdims=True)
        columns = [math.log(1 - doublet) + math.log(pi[j]) + r @ np.log(p[j]) for j in range(k)]
        norm = sum(pi[a] * pi[b] for a, b in pairs)
        columns += [math.log(doublet * pi[a] * pi[b] / norm) + r @ np.log((p[a] + p[b]) / 2) for a, b in pairs]
        z = np.stack(columns, axis=1)
        llk = np.logaddexp.reduce(z, axis=1)
        w = np.exp(z - llk[:, None])
        if llk.sum() - before < tolerance:
            break
        before = llk.sum()
    return w, pi, p, llk.sum()


@pytest.mark.parametrize("doublet", [0.0, 0.15])
def test_em_equals_a_dense_form_and_finds_the_components(spark, doublet):
    k = 3
    x, truth = planted(90, 40, k, 150, doublets=12 if doublet else 0)
    x = x[:, x.sum(axis=0) > 0]
    p = mixture.packed(frame(spark, x), k)
    n = k + (3 if doublet else 0)
    rng = np.random.default_rng(3)
    first = rng.dirichlet(np.ones(n), len(x))
    for c in range(0, 78, 7):
        first[c] = np.eye(n)[c % k]
    start = spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(first)], "cell_id long, w array<double>")
    found, rows = mixture.em(p, k, start, doublet=doublet, alpha=0.05, rounds=60, tolerance=1e-6)
    w, pi, profile, llk = dense_em(x, first, k, doublet, 0.05, 60, 1e-6)
    got = np.array([r["w"] for r in rows.orderBy("cell_id").collect()])
    assert got == pytest.approx(w, abs=1e-6) and found.shares == pytest.approx(pi) and found.llk == pytest.approx(llk)
    assert found.profile.T == pytest.approx(profile) and 1 < found.rounds < 60
    names = [(j,) for j in range(k)] + mixture.pairs_of(k)
    assert np.mean([names[i] == t for i, t in zip(got.argmax(axis=1), truth)]) > 0.95


def test_likelihood_never_falls_and_starts_by_hash(spark):
    x, _ = planted(60, 30, 4, 60, seed=5)
    p = mixture.packed(frame(spark, x), 4)
    start = mixture.random_start(p, 4, 0.2, seed=7)
    assert {sum(r["w"]) for r in start.collect()} == {1.0} and len(start.first()["w"]) == 10
    llk = [mixture.em(p, 4, start, doublet=0.2, alpha=0.0001, rounds=n, tolerance=-1)[0].llk for n in (1, 2, 4, 8)]
    assert all(b >= a - 1e-6 for a, b in zip(llk, llk[1:]))


def test_nothing_and_too_much(spark):
    none = spark.createDataFrame([], "cell_id long, gene string, n long")
    p = mixture.packed(none, 2)
    assert mixture.em(p, 2, mixture.random_start(p, 2, 0.0))[1].count() == 0 and mixture.gibbs(p, 2, sweeps=1, burn_in=0).count() == 0
    some = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (1, "b", None), (2, "b", 0), (3, "b", 4)], "cell_id long, gene string, n long")
    rows = {r["cell_id"]: (r["at"], r["n"]) for r in mixture.packed(some, 2).rows.collect()}
    assert rows == {1: ([0], [3.0]), 3: ([1], [4.0])}
    with pytest.raises(ValueError, match="collapse"):
        mixture.packed(some, 2, most=3)


def test_draws_equal_a_sampler_over_a_full_matrix(spark):
    k, sweeps, blocks = 3, 3, 2
    x, _ = planted(40, 25, k, 30, seed=2)
    x = x[:, x.sum(axis=0) > 0]
    counts = frame(spark, x)
    p = mixture.packed(counts, k)
    keys = p.rows.select("cell_id", F.xxhash64("cell_id", F.lit(0)).alias("first"), (F.pmod(F.xxhash64("cell_id", F.lit("block")), F.lit(blocks))).alias("block"), *(mixture._uniform(0, s).alias(f"u{s}") for s in range(sweeps + 1))).collect()
    by = {r["cell_id"]: r for r in keys}
    beta, gamma = 0.1, 1.0 / k

    def logits(held, cells, row):
        out = []
        for j in range(k):
            total = held[j].sum() + beta * x.shape[1]
            terms = [math.lgamma(held[j][g] + beta + row[g]) - math.lgamma(held[j][g] + beta) for g in range(len(row))]
            out.append(math.log(cells[j] + gamma) + math.lgamma(total) - math.lgamma(total + row.sum()) + sum(terms))
        return np.array(out)

    centres = sorted(by, key=lambda c: (by[c]["first"], c))[:k]
    z = {c: mixture.drawn(logits(x[centres], np.zeros(k), x[c]), by[c]["u0"]) for c in by}
    for s in range(1, sweeps + 1):
        for b in range(blocks):
            new = dict(z)
            for c in by:
                if by[c]["block"] == b:
                    held = np.stack([sum((x[d] for d in z if z[d] == j and d != c), np.zeros(x.shape[1])) for j in range(k)])
                    new[c] = mixture.drawn(logits(held, [sum(z[d] == j and d != c for d in z) for j in range(k)], x[c]), by[c][f"u{s}"])
            z = new
    got = mixture.gibbs(p, k, sweeps=sweeps, burn_in=sweeps - 1, blocks=blocks).collect()
    assert {r["cell_id"]: r["component"] for r in got} == z and {r["share"] for r in got} == {1.0}
    again = mixture.gibbs(mixture.packed(counts.repartition(7), k), k, sweeps=sweeps, burn_in=sweeps - 1, blocks=blocks).collect()
    assert {r["cell_id"]: r["component"] for r in again} == z


def test_sampler_finds_planted_components(spark):
    x, truth = planted(120, 40, 3, 120, seed=9)
    rows = mixture.gibbs(mixture.packed(frame(spark, x), 3), 3, sweeps=6, burn_in=3, blocks=2, seed=1).collect()
    got = {r["cell_id"]: r["component"] for r in rows}
    best = [max((sum(truth[c] == (j,) for c in got if got[c] == z)) for j in range(3)) for z in range(3)]
    assert sum(best) >= 110 and min(best) > 20
