"""Clustering droplets by genotype without a reference panel."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dropletry.functions.phred import added, hardy_weinberg, string_hash
from dropletry.operators import packed
from dropletry.operators.demux import best_and_next, calls
from dropletry.operators.likelihood import FLOOR
from dropletry.operators.ranking import numbered, saved


def merged_in_order(gl: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster, snp_id, n_cell, g: nine likelihoods): the members' likelihoods taken in one after another,
    scaled, floored and scaled again each time.

    assigned: (cell_id, cluster, rank); members come by rank.  A cluster's members at a variant are one
    row's array; ``merged`` combines before the shuffle instead and floors once.
    """
    own = F.struct("rank", F.array(*(f"g{k}" for k in range(9))).alias("g"))
    rows = gl.join(assigned, "cell_id").groupBy("cluster", "snp_id").agg(F.count("*").alias("n_cell"), F.transform(F.array_sort(F.collect_list(own)), lambda x: x["g"]).alias("gs"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)

    def scaled(v: Column) -> Column:
        # One step through an array of one, so that the sum is taken once.
        return F.element_at(F.transform(F.array(F.struct(v.alias("v"), total(v).alias("t"))), lambda p: F.transform(p["v"], lambda x: x / p["t"])), 1)

    taken = lambda held, own: scaled(F.transform(scaled(F.zip_with(held, own, lambda a, b: a * b)), lambda x: F.greatest(x, F.lit(FLOOR))))
    return rows.select("cluster", "snp_id", "n_cell", F.aggregate("gs", F.array_repeat(F.lit(1.0), 9), taken).alias("g"))


def initial_clusters(cells: DataFrame, listed: DataFrame) -> DataFrame:
    """Every droplet (cell_id, barcode) with its listed cluster (barcode, cluster), null where it has none
    or a negative one."""
    return cells.join(listed.where("cluster >= 0").select("barcode", "cluster"), "barcode", "left").select("cell_id", "barcode", "cluster")


def first_share(order: DataFrame, share: float) -> DataFrame:
    """The droplets (cell_id, rank: from 1) of the first share of all: one more than its whole number."""
    total = order.agg(F.count("*").alias("total"))  # one row
    return order.join(F.broadcast(total)).where(F.col("rank") - 1 <= F.col("total") * share).drop("total")


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """(key, at): a random order, from 0, by the hash of the key and a seed."""
    return numbered(rows.select(key), "at", string_hash(F.col(key).cast("string"), seed), F.col(key))


def voted_clusters(distances: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cell_id, cluster, votes): each droplet's cluster by the votes of all it was compared with: one for
    the other's cluster where the same genotype is likelier than two, one against it otherwise.

    distances: (cell_id, other_id, llk0, llk2), each pair once; assigned: (cell_id, cluster).
    """
    vote = F.when(F.col("llk2") > F.col("llk0"), 1).otherwise(-1).alias("vote")
    both = distances.select("cell_id", "other_id", vote).unionByName(distances.select(F.col("other_id").alias("cell_id"), F.col("cell_id").alias("other_id"), vote))
    of_other = assigned.select(F.col("cell_id").alias("other_id"), "cluster")
    return votes(both.join(of_other, "other_id").select("cell_id", "cluster", "vote"))


def next_level(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(src, dst, w): the graph of communities, with the weights inside one as a loop."""
    of = lambda side: communities.select(F.col("node").alias(side), F.col("community").alias(f"c_{side}"))
    rows = edges.join(of("src"), "src").join(of("dst"), "dst")
    return rows.groupBy(F.least("c_src", "c_dst").alias("src"), F.greatest("c_src", "c_dst").alias("dst")).agg(F.sum("w").alias("w"))


def merged(gl: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster, snp_id, n_cell, c0, c1, c2): the product of the members' likelihoods, floored.

    assigned: (cell_id, cluster).  Products are sums of logarithms, so that large clusters aggregate
    before they are shuffled; the floor applies to the product.
    """
    rows = gl.join(assigned, "cell_id")
    sums = rows.groupBy("cluster", "snp_id").agg(F.count("*").alias("n_cell"), *(F.sum(F.ln(f"g{4 * g}")).alias(f"s{g}") for g in range(3)))
    top = F.greatest("s0", "s1", "s2")
    e = [F.exp(F.col(f"s{g}") - top) for g in range(3)]
    shares = sums.select("cluster", "snp_id", "n_cell", *(F.greatest(x / added(e), F.lit(FLOOR)).alias(f"h{g}") for g, x in enumerate(e)))
    total = added([F.col(f"h{g}") for g in range(3)])
    return shares.select("cluster", "snp_id", "n_cell", *((F.col(f"h{g}") / total).alias(f"c{g}") for g in range(3)))


def cluster_posteriors(clusters: DataFrame, snps: DataFrame, k: int, geno_error: float = 0.1) -> DataFrame:
    """(snp_id, q: k x 3 genotype probabilities); a cluster that lacks a variant has the prior."""
    wide = clusters.groupBy("snp_id").agg(*(F.max(F.when(F.col("cluster") == j, F.col(f"c{g}"))).alias(f"c{j}_{g}") for j in range(k) for g in range(3)))
    prior = hardy_weinberg(F.col("af"))

    def of_cluster(j: int) -> list[Column]:
        raw = [F.coalesce(f"c{j}_{g}", F.lit(1.0)) * prior[g] for g in range(3)]
        return [(1 - geno_error) * raw[g] / added(raw) + geno_error * prior[g] for g in range(3)]

    joined = snps.join(wide, "snp_id", "left")
    return joined.select("snp_id", F.array(*(q for j in range(k) for q in of_cluster(j))).alias("q"))


def pair_likelihoods(gl: DataFrame, posterior: DataFrame, k: int) -> DataFrame:
    """(cell_id, j, k, n, llk) of each cluster (n = 0) and each pair j > k (n = 1)."""
    pairs = [(a, b) for a in range(k) for b in range(a + 1)]

    def likelihood(a: int, b: int) -> Column:
        if a == b:
            return F.ln(added([F.col(f"g{4 * g}") * F.col("q")[3 * a + g] for g in range(3)]))
        return F.ln(added([F.col(f"g{3 * g1 + g2}") * F.col("q")[3 * a + g1] * F.col("q")[3 * b + g2] for g1 in range(3) for g2 in range(3)]))

    return _entries(gl.join(posterior, "snp_id").groupBy("cell_id").agg(*(F.sum(likelihood(a, b)).alias(f"l{a}_{b}") for a, b in pairs)), pairs)


def _entries(sums: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(cell_id, j, k, n, llk) from a droplet's columns of all pairs."""
    entries = F.array(*(F.struct(F.lit(a).alias("j"), F.lit(b).alias("k"), F.lit(int(a != b)).alias("n"), F.col(f"l{a}_{b}").alias("llk")) for a, b in pairs))
    return sums.select("cell_id", F.explode(entries).alias("x")).select("cell_id", "x.*")


def em(gl: DataFrame, snps: DataFrame, assigned: DataFrame, k: int, rounds: int = 10, geno_error: float = 0.1) -> DataFrame:
    """Calls after refinement: clusters are rebuilt from droplets called single until nothing changes."""
    return _refined(lambda now: pair_likelihoods(gl, cluster_posteriors(merged(gl, now), snps, k, geno_error), k), assigned, rounds)


def em_packed(cells: DataFrame, assigned: DataFrame, k: int, rounds: int = 10, geno_error: float = 0.1) -> DataFrame:
    """``em`` of droplets (cell_id, n, pack) of ``packed.singlet_scores``.

    Likelihoods are dealt by variant once, into packs.  A round takes a pack and where the droplets are (a broadcast
    row of few bytes a droplet), and gives a row of sums for each droplet of the pack.
    """
    pairs = [(a, b) for a in range(k) for b in range(a + 1)]
    parts = saved(packed.by_variant(cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, where in zip(batch.column("pack"), batch.column("assigned")):
                at, af, ids, cell, codes, table = packed.got(pack.as_py())
                told = [packed.got(x.as_py()) for x in where]
                cluster = np.full(len(ids), -1)
                for told_ids, own in told:
                    place = np.minimum(np.searchsorted(told_ids, ids), len(told_ids) - 1)
                    cluster[told_ids[place] == ids] = own[place][told_ids[place] == ids]
                q = _posteriors(at, af, cluster[cell], np.log(table[:, ::4])[codes], k, geno_error)
                sums = np.zeros((len(pairs), len(ids)))
                for i in range(0, len(at), 1 << 16):
                    g, own, c = table[codes[i : i + (1 << 16)]], q[at[i : i + (1 << 16)]], cell[i : i + (1 << 16)]
                    for j, (a, b) in enumerate(pairs):
                        like = np.einsum("ei,ei->e", g[:, ::4], own[:, a]) if a == b else np.einsum("ei,ei->e", np.einsum("eij,ej->ei", g.reshape(-1, 3, 3), own[:, b]), own[:, a])
                        sums[j] += np.bincount(c, np.log(like), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(x) for x in sums)], names=["cell_id", *(f"l{a}_{b}" for a, b in pairs)])

    def llk(now: DataFrame) -> DataFrame:
        rows = parts.crossJoin(F.broadcast(packed.places(now)))
        sums = rows.mapInArrow(run, "cell_id long, " + ", ".join(f"l{a}_{b} double" for a, b in pairs))
        return _entries(sums.groupBy("cell_id").agg(*(F.sum(f"l{a}_{b}").alias(f"l{a}_{b}") for a, b in pairs)), pairs)

    return _refined(llk, assigned, rounds)


def _posteriors(at: np.ndarray, af: np.ndarray, cluster: np.ndarray, logs: np.ndarray, k: int, geno_error: float) -> np.ndarray:
    """``cluster_posteriors`` of ``merged`` for the variants of af, from the places ``at`` of droplets' variants, the
    droplets' clusters (-1: none) and the logarithms of their likelihoods: variants x k x 3."""
    own = cluster >= 0
    key = at[own] * k + cluster[own]
    s = np.stack([np.bincount(key, logs[own, g], len(af) * k) for g in range(3)], axis=1)
    e = np.exp(s - s.max(axis=1, keepdims=True))
    h = np.maximum(e / e.sum(axis=1, keepdims=True), FLOOR)
    held = np.where((np.bincount(key, minlength=len(af) * k) > 0)[:, None], h / h.sum(axis=1, keepdims=True), 1.0).reshape(-1, k, 3)
    prior = np.stack([(1 - af) * (1 - af), 2 * af * (1 - af), af * af], axis=1)[:, None]
    raw = held * prior
    return (1 - geno_error) * raw / raw.sum(axis=2, keepdims=True) + geno_error * prior


def _refined(llk: Callable[[DataFrame], DataFrame], assigned: DataFrame, rounds: int) -> DataFrame:
    found = None
    for _ in range(rounds):
        now = saved(calls(best_and_next(llk(assigned))))
        changed = found is None or now.select("cell_id", "type", "best_guess").exceptAll(found.select("cell_id", "type", "best_guess")).limit(1).count()
        found = now
        if not changed:
            break
        assigned = found.where("type = 'SNG'").select("cell_id", F.split("best_guess", ",")[0].cast("int").alias("cluster"))
    return found


def _score(own: list[float], prior: list[float], held: list[float]) -> float:
    """The log likelihood ratio of the same against unrelated genotypes at one variant."""
    same = sum(a * c * p for a, c, p in zip(own, held, prior))
    return math.log(same) - math.log(sum(a * p for a, p in zip(own, prior)) * sum(c * p for c, p in zip(held, prior)))


def _taken(own: list[float], held: list[float] | None) -> list[float]:
    """A cluster's likelihoods at a variant after it takes a droplet's in, floored."""
    m = [a * c for a, c in zip(own, held or (1.0, 1.0, 1.0))]
    total = sum(m)
    m = [max(x / total, FLOOR) for x in m]
    total = sum(m)
    return [x / total for x in m]


def _observed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(snp_id, rank, cell_id, cluster or -1, own, prior, state or None) row by row; state rows have rank 0."""
    for rows in batches:
        prior = np.stack([(1 - rows["af"]) ** 2, 2 * rows["af"] * (1 - rows["af"]), rows["af"] ** 2], axis=1).tolist()
        own = rows[["g0", "g4", "g8"]].to_numpy().tolist()
        yield from zip(rows["snp_id"].tolist(), rows["rank"].tolist(), rows["cell_id"].tolist(), rows["cluster"].tolist(), own, prior, rows["state"])


def _with_state(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """Rows of droplets (rank, cell_id, snp_id, af, g0, g4, g8, cluster) and, as rank 0, the clusters' state before them."""
    rows = rows.withColumn("state", F.lit(None).cast("array<double>"))
    if state is None:
        return rows
    none = {"rank": F.lit(0), "cell_id": F.lit(-1), "cluster": F.lit(-1), "af": F.lit(0.0), "g0": F.lit(0.0), "g4": F.lit(0.0), "g8": F.lit(0.0)}
    covered = state.join(rows.select("snp_id").distinct(), "snp_id", "left_semi")
    return rows.unionByName(covered.select("snp_id", "state", *(x.cast(dict(rows.dtypes)[c]).alias(c) for c, x in none.items())))


def _unpacked(state, k: int) -> list[list[float] | None]:
    """The likelihoods of each cluster at a variant, None where no member covers it."""
    return [None if state[3 * j] < 0 else [float(x) for x in state[3 * j : 3 * j + 3]] for j in range(k)]


def walked(cells: DataFrame, k: int) -> DataFrame:
    """(cell_id, rank, cluster) of droplets (cell_id, rank, cluster: null if not yet known, pack), one after another
    in one task; a droplet's variants are scored together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_of: dict[int, int] = {}
        held, covered = np.ones((1024, k, 3)), np.zeros((1024, k), bool)
        for batch in batches:
            ids, ranks, known = (batch.column(c).to_pylist() for c in ("cell_id", "rank", "cluster"))
            for i, pack in enumerate(batch.column("pack")):
                snp, af, codes, table = packed.got(pack.as_py())
                own, at = table[codes, ::4], np.array([at_of.setdefault(x, len(at_of)) for x in snp.tolist()], dtype=np.int64)
                if len(at_of) > len(held):
                    more = max(len(held), len(at_of) - len(held))
                    held, covered = np.concatenate([held, np.ones((more, k, 3))]), np.concatenate([covered, np.zeros((more, k), bool)])
                if known[i] is None:
                    prior = np.stack([(1 - af) ** 2, 2 * af * (1 - af), af**2], axis=1)
                    c, mine = held[at], own * prior
                    alone = mine[:, 0] + mine[:, 1] + mine[:, 2]
                    ratio = np.einsum("eki,ei->ke", c, mine) / (np.einsum("eki,ei->ke", c, prior) * alone)
                    scores = [math.fsum(x) for x in np.where(covered[at].T, np.log(ratio), 0.0).tolist()]
                    known[i] = scores.index(max(scores))
                m = own * held[at, known[i]]
                m = np.maximum(m / (m[:, 0] + m[:, 1] + m[:, 2])[:, None], FLOOR)
                held[at, known[i]], covered[at, known[i]] = m / (m[:, 0] + m[:, 1] + m[:, 2])[:, None], True
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ranks, pa.int64()), pa.array(known, pa.int32())], names=["cell_id", "rank", "cluster"])

    return cells.repartition(1).sortWithinPartitions("rank").mapInArrow(run, "cell_id long, rank long, cluster int")


def replayed(rows: DataFrame, state: DataFrame | None, k: int, scores: bool) -> DataFrame:
    """Each variant's droplets in order of rank, taken in by the clusters that ``rows`` names (-1: none).

    With ``scores`` (cell_id, rank, s: each cluster's score before the droplet came), else the state
    after them all (snp_id, state).  Variants are independent, so this runs in parallel and streams.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, out = None, [None] * k, []

        def frame() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["cell_id", "rank", "s"] if scores else ["snp_id", "state"])

        def close() -> None:
            if now is not None and not scores:
                out.append((now, [x for c in held for x in (c or (-1.0, -1.0, -1.0))]))

        for snp, rank, cell_id, cluster, own, prior, before in _observed(batches):
            if snp != now:
                close()
                now, held = snp, [None] * k
            if rank == 0:
                held = _unpacked(before, k)
                continue
            if scores:
                out.append((cell_id, rank, [0.0 if c is None else _score(own, prior, c) for c in held]))
            if cluster >= 0:
                held[cluster] = _taken(own, held[cluster])
            if len(out) >= 20_000:
                yield frame()
                out = []
        close()
        if out:
            yield frame()

    schema = "cell_id long, rank long, s array<double>" if scores else "snp_id long, state array<double>"
    return _with_state(rows, state).repartition("snp_id").sortWithinPartitions("snp_id", "rank").mapInPandas(run, schema)


def greedy_seeds(gl: DataFrame, snps: DataFrame, order: DataFrame, k: int, seeds: int = 1000, fraction: float = 1.0, rounds: int = 8) -> DataFrame:
    """``greedy_packed`` of likelihoods (cell_id, snp_id, g0 ... g8) and variants (snp_id, af)."""
    return greedy_packed(packed.of_likelihoods(gl, snps), order, k, seeds, fraction, rounds)


def greedy_packed(cells: DataFrame, order: DataFrame, k: int, seeds: int = 1000, fraction: float = 1.0, rounds: int = 8) -> DataFrame:
    """(cell_id, cluster) of the droplets of ``order`` (cell_id, rank), as if they came one after another.

    cells: (cell_id, pack) of ``packed.singlet_scores``.  Each goes to the cluster with the largest log likelihood
    ratio of the same against unrelated genotypes; an empty cluster scores 0 and the first of equals wins; then the
    cluster takes its likelihoods in.  ``fraction``: of the droplets to take; ``seeds``: droplets that one task
    walks at first.  The others come in blocks that double: all droplets of a block are scored at once behind those
    that a guess puts before them, which gives the next guess.  Up to the first droplet whose cluster changed, a
    guess is the result of strict order; so a block is done when nothing changes.  If one isn't after ``rounds``, or
    proceeds too slowly for that, droplets have no clear clusters, and one task walks all that aren't certain.
    """
    total = order.count()
    order = saved(order.where(F.col("rank") - 1 <= total * fraction).select(F.col("cell_id").cast("long"), F.col("rank").cast("long")))
    total, done, block = order.count(), min(seeds, total), seeds
    cells = saved(cells.select("cell_id", "pack").join(order, "cell_id"))
    found = saved(walked(cells.where(F.col("rank") <= done).withColumn("cluster", F.lit(None).cast("int")), k))
    state, last = None, 0
    while done < total:
        # The settled droplets join the state; their guesses are the result of strict order.
        between = lambda a, b: packed.unpacked(cells.where((F.col("rank") > a) & (F.col("rank") <= b)))
        newly = between(last, done).drop("cluster").join(found.select("cell_id", "cluster"), "cell_id")
        after = replayed(newly, state, k, scores=False)
        state = saved(after if state is None else after.unionByName(state.join(after.select("snp_id"), "snp_id", "left_anti")))
        last, end = done, min(total, done + block)
        part = saved(between(done, end))
        guess, certain = None, done
        for r in range(rounds):
            guessed = part if guess is None else part.drop("cluster").join(guess.select("cell_id", "cluster"), "cell_id")
            # Sums of decimals don't depend on the order of rows, so equal guesses give equal results.
            sums = replayed(guessed, state, k, scores=True).groupBy("cell_id", "rank").agg(*(F.sum(F.col("s")[j].cast("decimal(38,18)")).alias(f"s{j}") for j in range(k)))
            top = F.greatest(*(f"s{j}" for j in range(k))) if k > 1 else F.col("s0")
            now = saved(sums.select("cell_id", "rank", F.coalesce(*(F.when(F.col(f"s{j}") == top, j) for j in range(k))).alias("cluster")))
            if guess is not None:
                other = now.join(guess.select("cell_id", F.col("cluster").alias("was")), "cell_id").where("cluster != was").agg(F.min("rank")).first()[0]
                certain = end if other is None else other
            guess = now
            if certain == end or r and (certain - done) * rounds < (end - done) * r:
                break
        found = saved(found.unionByName(guess.where(F.col("rank") <= certain)))
        block = 2 * (certain - done)
        done = certain
        if certain < end:
            found, done = saved(walked(cells.join(found.select("cell_id", "cluster"), "cell_id", "left"), k)), total
    # A droplet without variants scores 0 everywhere.
    return order.select("cell_id").join(found.select("cell_id", "cluster"), "cell_id", "left").select("cell_id", F.coalesce("cluster", F.lit(0)).alias("cluster"))


def votes(links: DataFrame) -> DataFrame:
    """(cell_id, cluster) by the sum of signed votes (cell_id, cluster, vote); ties to the smaller cluster."""
    sums = links.groupBy("cell_id", "cluster").agg(F.sum("vote").cast("long").alias("votes"))
    order = Window.partitionBy("cell_id").orderBy(F.desc("votes"), "cluster")
    return sums.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def genotype_fields(clusters: DataFrame, snps: DataFrame) -> DataFrame:
    """Best genotype, its quality (at most 255) and Phred-scaled likelihoods of each cluster's variant."""
    prior = hardy_weinberg(F.col("af"))
    rows = clusters.join(snps, "snp_id")
    post = [F.col(f"c{g}") * prior[g] for g in range(3)]
    rows = rows.select("cluster", "snp_id", "n_cell", "c0", "c1", "c2", *((p / added(post)).alias(f"p{g}") for g, p in enumerate(post)))
    best = F.greatest("p0", "p1", "p2")
    top = F.greatest("c0", "c1", "c2")
    return rows.select(
        "cluster", "snp_id", "n_cell", F.when(F.col("p0") == best, "0/0").when(F.col("p1") == best, "0/1").otherwise("1/1").alias("gt"),
        F.least(F.lit(255), (-10 * F.log10(1 - best + 1e-100)).cast("int")).alias("gq"), *((-10 * F.log10(F.col(f"c{g}") / top)).cast("int").alias(f"pl{g}") for g in range(3)),
    )


def louvain_round(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One synchronous pass of greedy modularity: (node, community, gain) for every node.

    edges: (src, dst, w), each once; communities: (node, community).  A node weighs the communities of
    its neighbours by w_in - degree * total / 2m and moves if another beats its own; ties to the
    smaller community; nodes with odd and even hashes would move in turn, so callers pass each in turn.
    """
    both = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    degree = both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree"))
    whole = both.agg(F.sum("w").alias("m2"))
    total = degree.join(communities, "node").groupBy("community").agg(F.sum("degree").alias("total"))
    near = both.join(communities.select(F.col("node").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w").alias("w_in"))
    own = communities.join(degree, "node").withColumnRenamed("community", "own")
    options = near.unionByName(communities.select("node", "community", F.lit(0.0).alias("w_in"))).groupBy("node", "community").agg(F.sum("w_in").alias("w_in"))
    rows = options.join(own, "node").join(total, "community").join(F.broadcast(whole))
    rest = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("degree")).otherwise(F.lit(0.0))
    scored = rows.withColumn("gain", F.col("w_in") - F.col("degree") * rest / F.col("m2"))
    order = Window.partitionBy("node").orderBy(F.desc("gain"), (F.col("community") != F.col("own")).cast("int"), "community")
    return scored.withColumn("r", F.row_number().over(order)).where("r = 1").select("node", "community", "gain")
