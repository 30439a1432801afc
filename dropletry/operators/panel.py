"""Likelihoods of droplets under all pairs of donors from a panel of hundreds.

``likelihood.donor_pairs`` makes a column of every pair, which suits some ten donors.  Here droplets are packed
rows that are dealt into slices, and the variants' genotype probabilities (variants x donors x 3) are packs that
every slice takes in, one after another (``packed``).  The sums of all pairs are held for a slice's droplets
alone, so they are never shuffled.  Where a variant's donors have few different probabilities, as those of calls,
a pack names them by number: likelihoods are then those of pairs of numbers, and a product of matrices counts them
into pairs of donors.  Else probabilities x likelihoods x probabilities is a matrix of all pairs; sixteen of those
are multiplied before a logarithm is taken, which no likelihood of the error model can make too small.

No pair is left out: with a read or two at a variant, as in single cells, no cheap bound tells pairs apart (a
free partner explains any read at least half), so there is nothing sound to prune by.

Defined results: variants that only one side has say nothing, and droplets that share no variant with the
panel have no rows; a null or wrong number of probabilities is an error; of equal likelihoods the smaller j, k
and n come first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dropletry.operators import packed
from dropletry.operators.likelihood import STATES
from dropletry.operators.ranking import saved

#: Likelihoods of one variant, 1e-10 at least, that are multiplied before a logarithm is taken.
TOGETHER = 16
#: Different probabilities of a variant's donors that are told apart by number; variants of droplets taken at once then.
FEW, TOGETHER_FEW = 8, 4096
#: Shares at which j with k is k with j.
EQUAL = 0.5


@dataclass(frozen=True)
class Settings:
    """variants, cells: in a pack and a slice at most; by default as many as fit ``entries`` variants of droplets and
    ``room`` bytes of sums in a slice."""

    variants: int | None = None
    cells: int | None = None
    entries: int = 3 << 20
    room: int = 64 << 20


def all_pairs(donors: int, alphas: list[float]) -> np.ndarray:
    """(j, k, n) of the donors alone (n = 0) and of all pairs at the other shares, in that order; at equal shares
    each pair once, the larger donor first."""
    j, k, n = (x.ravel() for x in np.meshgrid(np.arange(donors), np.arange(donors), np.arange(len(alphas)), indexing="ij"))
    keep = np.where(n == 0, j == k, np.where(np.array(alphas)[n] == EQUAL, j > k, j != k))
    return np.stack([j, k, n], axis=1)[keep]


def log_priors(donors: int, alphas: list[float], doublet: float = 0.5) -> list[float]:
    """Log prior of one donor alone and of one pair at each other share."""
    if donors < 2 or len(alphas) < 2:
        raise ValueError("calls need two donors and a share besides that of a donor alone at least")
    pair = doublet / donors / (donors - 1) / (len(alphas) - 1)
    return [math.log((1 - doublet) / donors), *(math.log(2 * pair if a == EQUAL else pair) for a in alphas[1:])]


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _sums(p: np.ndarray, m: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The log likelihood of all pairs over the variants of a droplet: p: variants x donors x 3, m: variants x
    shares x 3 x 3."""
    out = np.zeros(len(pairs))
    for n in range(m.shape[1]):
        own = pairs[:, 2] == n
        total = np.zeros((p.shape[1], p.shape[1]))
        for a in range(0, len(p), TOGETHER):
            part = p[a : a + TOGETHER]
            total += np.log(np.multiply.reduce(part @ m[a : a + TOGETHER, n] @ part.transpose(0, 2, 1), axis=0))
        out[own] = total[pairs[own, 0], pairs[own, 1]]
    return out


def _coded(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of every donor's probabilities among those of its variant, and the latter (variants x numbers x 3);
    with more than ``FEW`` of a variant every donor has its own."""
    codes = np.full(p.shape[:2], -1, np.int16)
    table = []
    for n in range(FEW):
        left = codes < 0
        if not left.any():
            break
        one = np.take_along_axis(p, left.argmax(axis=1)[:, None, None], axis=1)  # the first again where none is left
        codes[left & (p == one).all(axis=2)] = n
        table.append(one)
    if (codes < 0).any():
        return np.broadcast_to(np.arange(p.shape[1], dtype=np.int16), codes.shape), p
    return codes, np.concatenate(table, axis=1)


def _few_sums(codes: np.ndarray, table: np.ndarray, m: np.ndarray, begins: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """``_sums`` of droplets (which begin at ``begins``) whose variants have few different probabilities."""
    out = np.zeros((len(begins), len(pairs)))
    own = codes[:, None, :] == np.arange(table.shape[1])[None, :, None]
    a = own.astype(np.float64).reshape(-1, codes.shape[1])
    ends = [*begins[1:].tolist(), len(codes)]
    for n in range(m.shape[1]):
        at = np.flatnonzero(pairs[:, 2] == n)
        j, k = pairs[at, 0], pairs[at, 1]
        if n == 0:
            alone = np.log(np.einsum("eug,euh,egh->eu", table, table, m[:, n], optimize=True))
            out[:, at] = np.add.reduceat(np.take_along_axis(alone, codes.astype(np.intp), axis=1), begins, axis=0)[:, j]
            continue
        both = np.log(table @ m[:, n] @ table.transpose(0, 2, 1))
        b = np.take_along_axis(both, np.broadcast_to(codes.astype(np.intp)[:, None, :], own.shape), axis=2).reshape(-1, codes.shape[1])
        u = table.shape[1]
        for i, (x, y) in enumerate(zip(begins.tolist(), ends)):
            out[i, at] = (a[x * u : y * u].T @ b[x * u : y * u])[j, k]
    return out


def _met(mix: DataFrame, posteriors: DataFrame, donors: int, alphas: list[float], settings: Settings | None, found: Callable, schema: str) -> DataFrame:
    """What ``found`` makes of a droplet's id and its sums of all pairs, from ``likelihood.mixtures`` and a panel
    (snp_id, p: donors x 3)."""
    s, pairs = settings or Settings(), all_pairs(donors, alphas)
    log_priors(donors, alphas)
    told = F.when(F.size("p") == 3 * donors, F.col("p")).otherwise(F.raise_error(F.lit("a variant's probabilities are not those of all donors")))
    cells = saved(packed.droplets(mix, [f"m{n}_{a}{b}" for n in range(len(alphas)) for a, b in STATES]))
    n, entries = cells.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    slices = -(-n // s.cells) if s.cells else max(-(-entries // s.entries), -(-n * len(pairs) * 8 // s.room))

    def pack(rows: pa.Table) -> tuple[np.ndarray, ...]:
        rows = rows.sort_by("snp_id")
        return rows["snp_id"].to_numpy(), *_coded(_numbers(rows["p"]).reshape(-1, donors, 3))

    def begin(held: list) -> packed.Slice:
        own = packed.Slice(held)
        own.sums, own.hit = np.zeros((len(held), len(pairs))), np.zeros(len(held), bool)
        return own

    def step(own: packed.Slice, ids: np.ndarray, codes: np.ndarray, table: np.ndarray) -> None:
        at, which = own.places(ids)
        order = np.argsort(at)
        at, which = at[order], which[order]
        cell = np.searchsorted(own.begins, at, "right") - 1
        begins = np.flatnonzero(np.diff(cell, prepend=-1))
        # Whole droplets at a time, some thousand variants.
        for first in np.split(begins, np.flatnonzero(np.diff(begins // TOGETHER_FEW)) + 1) if len(begins) else ():
            a, b = first[0], begins[begins > first[-1]][:1]
            b = b[0] if len(b) else len(at)
            whose, v, inside = cell[first], which[a:b], at[a:b] - own.begins[cell[a:b]]
            ends = np.append(first[1:], b)
            m = np.concatenate([own.arrays[c][2][own.arrays[c][1][inside[x - a : y - a]]] for c, x, y in zip(whose.tolist(), first.tolist(), ends.tolist())]).reshape(-1, len(alphas), 3, 3)
            own.hit[whose] = True
            if table.shape[1] <= FEW:
                own.sums[whose] += _few_sums(codes[v], table[v], m, first - a, pairs)
            else:
                for c, x, y in zip(whose.tolist(), (first - a).tolist(), (ends - a).tolist()):
                    own.sums[c] += _sums(table[v[x:y]], m[x:y], pairs)

    def end(own: packed.Slice) -> Iterator[pa.RecordBatch]:
        for c in np.flatnonzero(own.hit).tolist():
            yield from found(own.ids[c], own.sums[c]).to_batches()

    panel = posteriors.select(F.col("snp_id").cast("long"), told.alias("p"))
    return packed.met(cells, packed.variants(panel, pack, s.variants), max(1, slices), begin, step, end, schema)


def panel_pairs(mix: DataFrame, posteriors: DataFrame, donors: int, alphas: list[float], settings: Settings | None = None) -> DataFrame:
    """(cell_id, j, k, n, llk) of every donor alone and every pair, as ``likelihood.donor_pairs`` gives them but
    for the second order of a pair at equal shares."""
    pairs = all_pairs(donors, alphas)

    def run(cell: int, total: np.ndarray) -> pa.Table:
        return pa.table({"cell_id": pa.array(np.full(len(pairs), cell), pa.int64()), **{c: pa.array(pairs[:, i], pa.int32()) for i, c in enumerate("jkn")}, "llk": pa.array(total, pa.float64())})

    return _met(mix, posteriors, donors, alphas, settings, run, "cell_id long, j int, k int, n int, llk double")


BEST = "cell_id long, sng_best int, sng_best_llk double, sng_next int, sng_next_llk double, dbl_best int, dbl_best2 int, dbl_best_n int, dbl_best_llk double, dbl_next int, dbl_next2 int, dbl_next_n int, dbl_next_llk double, sng_posterior double, sng_only_posterior double, log_total double"


def panel_best(mix: DataFrame, posteriors: DataFrame, donors: int, alphas: list[float], settings: Settings | None = None, doublet: float = 0.5) -> DataFrame:
    """What ``demux.best_and_next`` and ``demux.posteriors`` give of all pairs, a row for each droplet; the shares
    of its pairs (dbl_best_n, dbl_next_n) may be unequal ones.  ``demux.calls`` takes it from there.

    The next pair is null where there is one pair only.
    """
    pairs = all_pairs(donors, alphas)
    alone, prior = pairs[:, 2] == 0, np.array(log_priors(donors, alphas, doublet))[pairs[:, 2]]
    names = [x.split()[0] for x in BEST.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}

    def run(cell: int, llk: np.ndarray) -> pa.Table:
        out: list = [cell]
        for single in (True, False):
            own = np.flatnonzero(alone == single)
            order = own[np.argsort(-llk[own], kind="stable")[:2]]
            for i in [*order.tolist(), None][:2]:
                j, k, n = pairs[i].tolist() if i is not None else (None, None, None)
                out += [*([j] if single else [j, k, n]), None if i is None else float(llk[i])]
        x = llk + prior
        log_total, log_single = np.logaddexp.reduce(x), np.logaddexp.reduce(x[alone])
        out += [float(np.exp(log_single - log_total)), float(np.exp(x[alone].max() - log_single)), float(log_total)]
        return pa.table({c: pa.array([v], kinds[t.split()[1]]) for c, v, t in zip(names, out, BEST.split(", "))})

    return _met(mix, posteriors, donors, alphas, settings, run, BEST)
