import numpy as np
import pytest
from pyspark.sql import functions as F

from dropletry.operators import demux, likelihood, panel

ALPHAS = [0.0, 0.5]


def planted(donors, cells, variants, reads, seed=0):
    """Calls of donors, and bases of droplets: even ones hold a donor, odd ones two."""
    rng = np.random.default_rng(seed)
    gt = rng.binomial(2, rng.uniform(0.1, 0.9, variants)[:, None], (variants, donors))
    p = np.full((variants, donors, 3), 0.005)
    np.put_along_axis(p, gt[..., None], 0.99, axis=2)
    truth, bases = [], []
    for c in range(cells):
        own = sorted(rng.choice(donors, 1 + c % 2, replace=False).tolist())
        truth.append(own)
        for umi, v in enumerate(rng.integers(0, variants, reads).tolist()):
            alt = rng.random() < gt[v, own[int(rng.integers(len(own)))]] / 2
            bases.append((c, v, umi, int(alt != (rng.random() < 0.001)), 30))
    return p, truth, bases


def frames(spark, p, bases):
    unique = spark.createDataFrame(bases, "cell_id long, snp_id long, umi long, allele int, bq int")
    return likelihood.mixtures(unique, ALPHAS), spark.createDataFrame([(v, x.ravel().tolist()) for v, x in enumerate(p)], "snp_id long, p array<double>")


def brute(p, bases, alphas):
    """The log likelihood of every pair of donors at every share: cells x shares x donors x donors."""
    cells = 1 + max(b[0] for b in bases)
    seen = {}
    for c, v, _, allele, bq in bases:
        e = 0.1 ** (bq / 10)
        r, a = (1 - e, e / 3) if allele == 0 else (e / 3, 1 - e)
        f = np.array([[[0.5 * x + (y - x) * 0.5 * al for y in range(3)] for x in range(3)] for al in alphas])
        seen[c, v] = seen.get((c, v), 1.0) * (r * (1 - f) + a * f)
    out = np.zeros((cells, len(alphas), p.shape[1], p.shape[1]))
    for (c, v), m in seen.items():
        m = (m / m.max() + 1e-10) / (1 + 1e-10)
        for n in range(len(alphas)):
            out[c, n] += np.log(p[v] @ m[n] @ p[v].T)
    return out


def test_equals_the_form_by_columns_at_five_donors(spark):
    p, _, bases = planted(5, 12, 60, 80)
    mix, posteriors = frames(spark, p, bases)
    columns = likelihood.donor_pairs(mix, posteriors, 5, ALPHAS).where("n = 0 or j > k").cache()
    wide = {(r["cell_id"], r["j"], r["k"], r["n"]): r["llk"] for r in columns.collect()}
    for s in (panel.Settings(variants=7, cells=3), panel.Settings()):
        rows = {(r["cell_id"], r["j"], r["k"], r["n"]): r["llk"] for r in panel.panel_pairs(mix, posteriors, 5, ALPHAS, s).collect()}
        assert rows == pytest.approx(wide)
    best = {r["cell_id"]: r.asDict() for r in demux.best_and_next(columns).join(demux.posteriors(columns, 5), "cell_id").collect()}
    for r in panel.panel_best(mix, posteriors, 5, ALPHAS, panel.Settings(variants=7, cells=3)).drop("dbl_best_n", "dbl_next_n").collect():
        assert r.asDict() == pytest.approx(best.pop(r["cell_id"]))
    assert not best


def test_two_hundred_donors_are_found_again(spark):
    donors, cells = 200, 12
    p, truth, bases = planted(donors, cells, 800, 600)
    mix, posteriors = frames(spark, p, bases)
    best = panel.panel_best(mix, posteriors, donors, ALPHAS, panel.Settings(variants=300, cells=5)).cache()
    whole = brute(p, bases, ALPHAS)
    calls = {r["cell_id"]: r for r in demux.calls(best).collect()}
    single, pair = panel.log_priors(donors, ALPHAS)
    below = np.tril_indices(donors, -1)
    for r in best.collect():
        c = r["cell_id"]
        own, two = np.sort(np.diag(whole[c, 0]))[::-1], np.sort(whole[c, 1][below])[::-1]
        assert [r[f"{x}_llk"] for x in ("sng_best", "sng_next", "dbl_best", "dbl_next")] == pytest.approx([own[0], own[1], two[0], two[1]], rel=1e-9)
        assert r["log_total"] == pytest.approx(np.logaddexp.reduce(np.concatenate([own + single, two + pair])), rel=1e-12)
        assert calls[c]["type"] == ("SNG", "DBL")[c % 2]
        assert sorted(set(map(int, calls[c]["best_guess"].split(",")))) == truth[c]
    assert len(calls) == cells


def test_unequal_shares_take_both_orders(spark):
    p, _, bases = planted(6, 6, 50, 40, seed=4)
    unique = spark.createDataFrame(bases, "cell_id long, snp_id long, umi long, allele int, bq int")
    alphas = [0.0, 0.25, 0.5]
    mix = likelihood.mixtures(unique, alphas)
    posteriors = spark.createDataFrame([(v, x.ravel().tolist()) for v, x in enumerate(p)], "snp_id long, p array<double>")
    rows = {(r["cell_id"], r["j"], r["k"], r["n"]): r["llk"] for r in panel.panel_pairs(mix, posteriors, 6, alphas, panel.Settings(variants=20, cells=2)).collect()}
    whole = brute(p, bases, alphas)
    assert len(rows) == 6 * (6 + 30 + 15)
    for (c, j, k, n), llk in rows.items():
        assert llk == pytest.approx(whole[c, n, j, k])
    best = panel.panel_best(mix, posteriors, 6, alphas).collect()
    single, *prior = panel.log_priors(6, alphas, 0.5)
    assert prior[1] == prior[0] + np.log(2)
    for r in best:
        x = [llk + ([single, *prior][n]) for (c, _, _, n), llk in rows.items() if c == r["cell_id"]]
        assert r["log_total"] == pytest.approx(np.logaddexp.reduce(x))
        assert r["dbl_best_llk"] == pytest.approx(rows[r["cell_id"], r["dbl_best"], r["dbl_best2"], r["dbl_best_n"]])


def test_variants_of_one_side_say_nothing(spark):
    p, _, bases = planted(4, 4, 30, 40, seed=5)
    mix, posteriors = frames(spark, p, bases + [(c, 99, 0, 1, 30) for c in range(4)] + [(77, 99, 0, 1, 30)])
    got = panel.panel_pairs(mix, posteriors, 4, ALPHAS).collect()
    want = brute(p, bases, ALPHAS)
    assert {r["cell_id"] for r in got} == {0, 1, 2, 3}
    assert all(r["llk"] == pytest.approx(want[r["cell_id"], r["n"], r["j"], r["k"]]) for r in got)
    assert panel.panel_pairs(mix.limit(0), posteriors, 4, ALPHAS).count() == 0
    with pytest.raises(Exception, match="not those of all donors"):
        panel.panel_pairs(mix, posteriors.withColumn("p", F.slice("p", 1, 3)), 4, ALPHAS).count()


def test_neither_sums_nor_panel_are_shuffled_by_block(spark):
    p, _, bases = planted(5, 12, 60, 80)
    plan = panel.panel_best(*frames(spark, p, bases), 5, ALPHAS)._jdf.queryExecution().executedPlan().toString()
    assert "GroupsInArrow" not in plan


@pytest.mark.parametrize("kinds", [3, 20])
def test_few_and_many_probabilities_of_a_variant_give_equal_sums(kinds):
    rng = np.random.default_rng(kinds)
    given = rng.dirichlet([1, 1, 1], (50, kinds))
    p = np.take_along_axis(given, rng.integers(0, kinds, (50, 20))[..., None], axis=1)
    codes, table = panel._coded(p)
    assert (np.take_along_axis(table, codes[..., None].astype(int), axis=1) == p).all() and table.shape[1] == (3 if kinds == 3 else 20)
    m, pairs, begins = rng.uniform(0.1, 1, (50, 2, 3, 3)), panel.all_pairs(20, ALPHAS), np.array([0, 7, 30])
    want = [panel._sums(p[a:b], m[a:b], pairs) for a, b in ((0, 7), (7, 30), (30, 50))]
    assert panel._few_sums(codes, table, m, begins, pairs) == pytest.approx(np.array(want))
