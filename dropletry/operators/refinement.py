"""Clustering droplets by votes over all pairs, then refining the clusters: the older, quadratic way.

Every pair of droplets votes for or against being of one genotype.  Droplets come in an order and join the
cluster that the votes of those before them elect; then all are visited again and again in random orders, each
time by the votes of all others, as they stand at that moment; at last clusters are rebuilt a fixed number of
rounds from the droplets that are called single.

To visit droplets one after another is a walk without cycles: each depends on those visited before it alone.
So all are decided at once behind a guess, and again behind the result, until nothing changes; what does not
change is the walk's own result, whatever the first guess was, and the rounds that this takes follow from how
decisions hang together, not from the number of droplets.  Each round is one join of the votes with the clusters and
one aggregate.  Random orders and the small numbers that break ties come from hashes of droplet, seed and visit.

Defined results: pairs whose log likelihoods differ by ``threshold`` or less do not vote; a droplet without votes goes
to the cluster its tie-break elects; droplets behind the first ``share`` of the order have no cluster until they are
visited, and keep none with ``keep_missing``; visits end early when one changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropletry.operators.clusters import cluster_posteriors, first_share, merged, pair_likelihoods
from dropletry.operators.demux import best_and_next, calls
from dropletry.operators.likelihood import pair_distances
from dropletry.operators.ranking import saved


def signed_votes(distances: DataFrame, threshold: float = 5.0) -> DataFrame:
    """(cell_id, other_id, vote: 1 or -1) from either end of the pairs (cell_id, other_id, llk0, llk2) that vote."""
    told = F.col("llk2") - F.col("llk0")
    rows = distances.where(F.abs(told) > threshold).select("cell_id", "other_id", F.signum(told).cast("int").alias("vote"))
    return rows.unionByName(rows.select(F.col("other_id").alias("cell_id"), F.col("cell_id").alias("other_id"), "vote"))


def jitter(cluster: Column | int, seed: int, visit: int) -> Column:
    """Under a thousandth of a vote, by hash: what breaks ties."""
    return F.pmod(F.xxhash64(F.col("cell_id"), F.lit(cluster), F.lit(seed), F.lit(visit)), F.lit(1 << 20)) / float(1000 << 20)


def _tally(votes: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """(cell_id, v0, v1, ...): votes for each cluster of the others."""
    of = clusters.select(F.col("cell_id").alias("other_id"), "cluster")
    return votes.join(of, "other_id").groupBy("cell_id").agg(*(F.sum(F.when(F.col("cluster") == j, F.col("vote")).otherwise(0)).alias(f"v{j}") for j in range(k)))


def _walked(cells: DataFrame, before: DataFrame, after: DataFrame | None, guess: DataFrame, k: int, seed: int, visit: int) -> DataFrame:
    """(cell_id, cluster) of ``cells`` visited one after another: each by the new clusters of those ``before`` it
    and the tally of those ``after`` it."""
    total = lambda j: F.coalesce(f"v{j}", F.lit(0)) + (F.coalesce(f"a{j}", F.lit(0)) if after is not None else 0) + jitter(j, seed, visit)
    while True:
        rows = cells.join(_tally(before, guess, k), "cell_id", "left")
        if after is not None:
            rows = rows.join(after.select("cell_id", *(F.col(f"v{j}").alias(f"a{j}") for j in range(k))), "cell_id", "left")
        rows = rows.select("cell_id", *(total(j).alias(f"t{j}") for j in range(k)))
        top = F.greatest(*(f"t{j}" for j in range(k))) if k > 1 else F.col("t0")
        now = rows.select("cell_id", F.coalesce(*(F.when(F.col(f"t{j}") == top, j) for j in range(k))).alias("cluster"))
        now = saved(now.join(guess.select("cell_id", F.col("cluster").alias("was")), "cell_id", "left"))
        changed = now.where(~F.col("cluster").eqNullSafe(F.col("was"))).limit(1).count()
        guess = now.select("cell_id", "cluster")
        if not changed:
            return guess


def elected(votes: DataFrame, order: DataFrame, k: int, share: float = 1.0, seed: int = 0) -> DataFrame:
    """(cell_id, cluster) of the first share of the order (cell_id, rank), each by the votes of those before it."""
    cells = saved(first_share(order, share).select("cell_id", "rank"))
    ranks = lambda name, rank: cells.select(F.col("cell_id").alias(name), F.col("rank").alias(rank))
    before = saved(votes.join(ranks("cell_id", "own"), "cell_id").join(ranks("other_id", "other"), "other_id").where("other < own").select("cell_id", "other_id", "vote"))
    none = cells.select("cell_id", F.lit(None).cast("int").alias("cluster"))
    return _walked(cells.select("cell_id"), before, None, none, k, seed, -1)


def visited(votes: DataFrame, cells: DataFrame, clusters: DataFrame, k: int, visits: int = 10, seed: int = 0, keep_missing: bool = False) -> DataFrame:
    """(cell_id, cluster) after so many visits of all droplets ``cells`` (cell_id) in random orders at most."""
    held = saved(cells.select("cell_id").join(clusters.where("cluster is not null").select("cell_id", "cluster"), "cell_id", "left"))
    goes = saved(held.where("cluster is not null").select("cell_id") if keep_missing else held.select("cell_id"))
    votes = saved(votes.join(goes, "cell_id", "left_semi").join(goes.withColumnRenamed("cell_id", "other_id"), "other_id", "left_semi"))
    for visit in range(visits):
        at = lambda c, visit=visit: F.struct(F.xxhash64(F.col(c), F.lit(seed), F.lit(visit)), F.col(c))
        before, after = votes.where(at("other_id") < at("cell_id")), votes.where(at("other_id") > at("cell_id"))
        told = held.where("cluster is not null")
        now = _walked(goes, before, saved(_tally(after, told, k)), told, k, seed, visit)
        changed = now.join(held.withColumnRenamed("cluster", "was"), "cell_id").where(~F.col("cluster").eqNullSafe(F.col("was"))).limit(1).count()
        held = held.where("cluster is null").join(now, "cell_id", "left_anti").unionByName(now)
        if not changed:
            break
    return held


def rebuilt(gl: DataFrame, snps: DataFrame, clusters: DataFrame, k: int, rounds: int = 10, geno_error: float = 0.1) -> DataFrame:
    """Calls after exactly so many rounds; the error of genotypes is reckoned with in the last one alone."""
    found, assigned = None, clusters.where("cluster is not null").select("cell_id", "cluster")
    for r in range(rounds):
        error = geno_error if r + 1 == rounds else 0.0
        found = saved(calls(best_and_next(pair_likelihoods(gl, cluster_posteriors(merged(gl, assigned), snps, k, error), k))))
        assigned = found.where("type = 'SNG'").select("cell_id", F.split("best_guess", ",")[0].cast("int").alias("cluster"))
    return found


def refined(gl: DataFrame, snps: DataFrame, order: DataFrame, k: int, *, threshold: float = 5.0, share: float = 1.0, start: DataFrame | None = None, visits: int = 10, rounds: int = 10, geno_error: float = 0.1, keep_missing: bool = False, seed: int = 0, each: Callable | None = None) -> DataFrame:
    """Calls of every droplet of likelihoods ``gl``; order: (cell_id, rank); start: (cell_id, cluster) in place of
    the election.  Without an error of genotypes and with half of the droplets elected, this is the variant that
    finds the clusters of multiplexed samples.

    ``each`` is handed the clusters before the rounds, for those who keep them.
    """
    votes = saved(signed_votes(pair_distances(gl, snps), threshold))
    first = elected(votes, order, k, share, seed) if start is None else start.select("cell_id", F.when(F.col("cluster") >= 0, F.col("cluster")).alias("cluster"))
    found = visited(votes, order, first, k, visits, seed, keep_missing) if visits else first
    found = saved(found)
    if each is not None:
        each(found)
    return rebuilt(gl, snps, found, k, rounds, geno_error)
