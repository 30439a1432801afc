"""Multinomial mixtures of droplets' gene counts, by EM and by collapsed Gibbs sampling.

A droplet's counts are one row (its genes' places and numbers), written once.  A round is one pass over these
rows: tasks get the components' profiles (genes x components), and give sums of the same shape over their own
droplets; these are added by stretches of genes.  So a round moves the profiles, never the counts.  Profiles
grow with genes times components, not with droplets; that product is checked against ``most`` before anything
is sent.  Beyond it, ``expression.mixture_step`` does a round of EM by joins, or genes are put together first
(``expression.collapsed``).

EM: components alone and, if asked, pairs of components, whose profile is the mean of both; a pair's prior is the
product of both shares, scaled to the share of doublets.  ``alpha`` is added to every gene of every droplet.
Rounds end when the log likelihood grows by less than ``tolerance``.

Gibbs: components' counts are kept without the droplet that is drawn, and a droplet's probability of a component
is the Dirichlet-multinomial one.  In a sweep the droplets are drawn in ``blocks`` by hash, one block after the
other: those of a block see the others' latest components and each other's former ones.  A draw depends on
the droplet, the seed and the sweep alone, so neither partitions nor lost tasks change it.

Defined results: null counts and counts of 0 are left out; counts that are given more than once are added; droplets
and genes without counts take no part; no droplets, no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropletry.functions.phred import string_hash
from dropletry.operators.ranking import numbered, saved

#: Genes in a stretch of partial sums.
STRETCH = 4096


@dataclass(frozen=True)
class Packed:
    """rows: (cell_id, at: genes' places, n: their counts); genes: (gene, at); size: how many genes."""

    rows: DataFrame
    genes: DataFrame
    size: int


def packed(counts: DataFrame, k: int, most: int = 1 << 26) -> Packed:
    """The counts (cell_id, gene, n) by droplet; ``most``: genes times components that tasks are sent at most."""
    kept = counts.where("n > 0").groupBy("cell_id", "gene").agg(F.sum("n").cast("double").alias("n"))
    genes = saved(numbered(kept.select("gene").distinct(), "at", F.col("gene")).withColumn("at", F.col("at").cast("int")))
    size = genes.count()
    if size * k > most:
        raise ValueError(f"{size} genes in {k} components are more than {most}; collapse genes first")
    rows = kept.join(genes, "gene").groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("x"))
    return Packed(saved(rows.select("cell_id", F.col("x.at").alias("at"), F.col("x.n").alias("n"))), genes, size)


def _cells(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, places, counts) of each droplet of a batch."""
    at, n = batch.column("at"), batch.column("n")
    flat, many, ends = at.flatten().to_numpy(), n.flatten().to_numpy(), at.offsets.to_numpy() - at.offsets[0].as_py()
    for i in range(batch.num_rows):
        yield i, flat[ends[i] : ends[i + 1]], many[ends[i] : ends[i + 1]]


def _summed(parts: DataFrame, size: int, width: int) -> np.ndarray:
    """Partial sums (stretch, part, block: doubles) of a matrix of genes x width."""

    def run(rows: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(b) for b in rows.sort_by("part")["block"].to_pylist()]
        total = blocks[0].copy()
        for b in blocks[1:]:
            total += b
        return pa.table({"stretch": rows["stretch"][:1], "block": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((size, width))
    for r in parts.groupBy("stretch").applyInArrow(run, "stretch int, block binary").toArrow().to_pylist():
        a = r["stretch"] * STRETCH
        out[a : a + STRETCH] = np.frombuffer(r["block"]).reshape(-1, width)
    return out


def _by_stretch(matrix: np.ndarray, part: int) -> pa.RecordBatch:
    starts = range(0, len(matrix), STRETCH)
    blocks = [matrix[a : a + STRETCH].tobytes() for a in starts]
    return pa.RecordBatch.from_arrays([pa.array([a // STRETCH for a in starts], pa.int32()), pa.array([part] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())], names=["stretch", "part", "block"])


def _pass(rows: DataFrame, size: int, width: int, add: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all droplets: a matrix of genes x width, and as its last row the droplets' own sums.

    ``add`` (matrix, batch) adds a batch's droplets to a matrix of size + 1 rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros((size + 1, width)), -1
        for batch in batches:
            if batch.num_rows:
                part = max(part, batch.column("part")[0].as_py())
                add(total, batch)
        if part >= 0:
            yield _by_stretch(total, part)

    parts = rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, "stretch int, part long, block binary")
    out = _summed(parts, size + 1, width)
    return out[:-1], out[-1]


def pairs_of(k: int) -> list[tuple[int, int]]:
    """The pairs of components, the larger first."""
    return [(a, b) for a in range(1, k) for b in range(a)]


@dataclass(frozen=True)
class Mixture:
    """shares of the components; profile: genes x components; llk: log likelihood of the counts."""

    shares: np.ndarray
    profile: np.ndarray
    llk: float
    rounds: int


@dataclass(frozen=True)
class Model:
    """What a task needs to weigh a droplet: logs of profiles and priors of components, then pairs."""

    log_profile: np.ndarray
    log_prior: np.ndarray
    constant: np.ndarray

    @staticmethod
    def of(shares: np.ndarray, profile: np.ndarray, doublet: float, alpha: float) -> Model:
        k = len(shares)
        both = pairs_of(k) if doublet > 0 else []
        with np.errstate(divide="ignore"):  # an empty component
            log_shares = np.log(shares)
            columns = [np.log(profile), *(np.log((profile[:, a] + profile[:, b]) / 2)[:, None] for a, b in both)]
            prior = log_shares + (math.log1p(-doublet) if doublet > 0 else 0.0)
            if both:
                pair = np.array([log_shares[a] + log_shares[b] for a, b in both])
                prior = np.concatenate([prior, pair - np.logaddexp.reduce(pair) + math.log(doublet)])
        logs = np.concatenate(columns, axis=1)
        return Model(logs, prior, alpha * logs.sum(axis=0))

    def weigh(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """A droplet's responsibilities and log likelihood."""
        x = self.log_prior + self.constant + n @ self.log_profile[at]
        x = np.where(np.isnan(x), -np.inf, x)
        total = float(np.logaddexp.reduce(x))
        return np.exp(x - total), total


def _halves(w: np.ndarray, k: int) -> np.ndarray:
    """Responsibilities of components with half of each pair's."""
    out = w[:k].copy()
    for i, (a, b) in enumerate(pairs_of(k) if len(w) > k else []):
        out[a] += w[k + i] / 2
        out[b] += w[k + i] / 2
    return out


def random_start(p: Packed, k: int, doublet: float, seed: int = 0) -> DataFrame:
    """(cell_id, w): each droplet wholly in one component or, with the share of doublets, one pair, by its hash."""
    uniform = lambda turn: (string_hash(F.col("cell_id").cast("string"), 2 * seed + turn) + 0.5) / 4294967296
    both = len(pairs_of(k)) if doublet > 0 else 0
    drawn = F.when(uniform(0) < doublet * (both > 0), k + F.floor(uniform(1) * both)).otherwise(F.floor(uniform(1) * k))
    return p.rows.select("cell_id", F.transform(F.sequence(F.lit(0), F.lit(k + both - 1)), lambda j: (j == drawn).cast("double")).alias("w"))


def em(p: Packed, k: int, start: DataFrame, *, doublet: float = 0.0, alpha: float = 0.01, rounds: int = 100, tolerance: float = 1e-3) -> tuple[Mixture | None, DataFrame]:
    """The mixture, and (cell_id, w: responsibilities of components and pairs); start: (cell_id, w) likewise."""
    spark = p.rows.sparkSession
    schema = f"cell_id {dict(p.rows.dtypes)['cell_id']}, w array<double>"

    def from_start(total: np.ndarray, batch: pa.RecordBatch) -> None:
        w = batch.column("w").to_pylist()
        for i, at, n in _cells(batch):
            own = _halves(np.array(w[i]), k)
            total[at, :k] += n[:, None] * own
            total[-1, :k] += own

    sums, mass = _pass(p.rows.join(start, "cell_id"), p.size, k + 1, from_start)
    if not mass.any():
        return None, spark.createDataFrame([], schema)
    before = -math.inf
    for turn in range(1, rounds + 1):
        shares = mass[:k] / mass[:k].sum()
        profile = sums[:, :k] + alpha * mass[:k]
        with np.errstate(invalid="ignore"):
            profile = np.nan_to_num(profile / profile.sum(axis=0))
        model = spark.sparkContext.broadcast(Model.of(shares, profile, doublet, alpha))

        def step(total: np.ndarray, batch: pa.RecordBatch, model=model) -> None:
            for _, at, n in _cells(batch):
                w, llk = model.value.weigh(at, n)
                own = _halves(w, k)
                total[at, :k] += n[:, None] * own
                total[-1, :k] += own
                total[-1, k] += llk

        sums, mass = _pass(p.rows, p.size, k + 1, step)
        done = mass[k] - before < tolerance
        before = float(mass[k])
        if done or turn == rounds:
            break

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [model.value.weigh(at, n)[0] for _, at, n in _cells(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("cell_id"), pa.array(w, pa.list_(pa.float64()))], names=["cell_id", "w"])

    return Mixture(shares, profile, before, turn), p.rows.mapInArrow(weights, schema)


def rising(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The logarithm of a (a + 1) ... (a + n - 1), summed over the first axis; n: whole numbers."""
    out, i, left = np.zeros(a.shape[1]), 0, np.arange(len(n))
    while len(left):
        out += np.log(a[left] + i).sum(axis=0)
        i += 1
        left = left[n[left] > i]
    return out


@dataclass(frozen=True)
class Held:
    """What the components hold: counts by gene, all counts and droplets; beta, gamma: added to each gene of a
    component and to each component."""

    counts: np.ndarray
    cells: np.ndarray
    beta: float
    gamma: float

    def logits(self, at: np.ndarray, n: np.ndarray, own: int) -> np.ndarray:
        """The log probability of each component for a droplet that is taken out of ``own`` (none below 0)."""
        counts, cells, totals = self.counts[at].copy(), self.cells.copy(), self.counts.sum(axis=0)
        if own >= 0:
            counts[:, own] -= n
            cells[own] -= 1
            totals[own] -= n.sum()
        totals = totals + self.beta * len(self.counts)
        whole = np.array([math.lgamma(t) - math.lgamma(t + n.sum()) for t in totals])
        return np.log(cells + self.gamma) + whole + rising(counts + self.beta, n)


def drawn(logits: np.ndarray, u: float) -> int:
    """The component that a number of [0, 1) picks."""
    share = np.cumsum(np.exp(logits - logits.max()))
    return int(min(np.searchsorted(share, u * share[-1], side="right"), len(share) - 1))


def _uniform(seed: int, sweep: int) -> Column:
    hashed = F.xxhash64(F.col("cell_id"), F.lit(seed), F.lit(sweep))
    return F.shiftrightunsigned(hashed, 11).cast("double") / float(1 << 53)


def gibbs(p: Packed, k: int, *, sweeps: int = 40, burn_in: int = 20, blocks: int = 4, alpha: float = 1.0, beta: float = 0.1, seed: int = 0) -> DataFrame:
    """(cell_id, component, share): the component that a droplet was drawn into most often after ``burn_in``
    sweeps, and how often; ties to the smaller one.  ``alpha`` is dealt out over all components.

    The first draw is behind k droplets' own counts, those first by hash.
    """
    spark = p.rows.sparkSession
    kind = dict(p.rows.dtypes)["cell_id"]
    schema = f"cell_id {kind}, at array<int>, n array<double>, z int, seen array<long>"
    rows = p.rows.withColumns({"z": F.lit(-1), "seen": F.array_repeat(F.lit(0).cast("long"), k)})

    def held(counts: np.ndarray, cells: np.ndarray):
        return spark.sparkContext.broadcast(Held(counts, cells, beta, alpha / k))

    def counted(total: np.ndarray, batch: pa.RecordBatch) -> None:
        z = batch.column("z").to_pylist()
        for i, at, n in _cells(batch):
            total[at, z[i]] += n
            total[-1, z[i]] += 1

    def redrawn(rows: DataFrame, state, sweep: int, block: int | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z, u, turn = (batch.column(c).to_pylist() for c in ("z", "u", "turn"))
                seen = batch.column("seen").to_pylist()
                for i, at, n in _cells(batch):
                    if turn[i]:
                        z[i] = drawn(state.value.logits(at, n, z[i]), u[i])
                        if sweep > burn_in:
                            seen[i][z[i]] += 1
                columns = [batch.column("cell_id"), batch.column("at"), batch.column("n"), pa.array(z, pa.int32()), pa.array(seen, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["cell_id", "at", "n", "z", "seen"])

        own = F.lit(True) if block is None else F.pmod(F.xxhash64("cell_id", F.lit("block")), F.lit(blocks)) == block
        return saved(rows.withColumns({"u": _uniform(seed, sweep), "turn": own}).mapInArrow(run, schema))

    centres = rows.orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(k).select("at", "n").collect()
    counts = np.zeros((p.size, k))
    for j, c in enumerate(centres):  # k droplets
        counts[c["at"], j] = c["n"]
    rows = redrawn(rows, held(counts, np.zeros(k)), 0, None)
    for sweep in range(1, sweeps + 1):
        for block in range(blocks):
            counts, cells = _pass(rows, p.size, k, counted)
            rows = redrawn(rows, held(counts, cells), sweep, block)
    most = F.array_max("seen") if sweeps > burn_in else None
    component = (F.array_position("seen", most) - 1).cast("int") if most is not None else F.col("z")
    share = most / F.lit(float(sweeps - burn_in)) if most is not None else F.lit(1.0)
    return rows.select("cell_id", component.alias("component"), share.alias("share"))
