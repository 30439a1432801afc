"""Genotypes of any number of alleles, in one or two copies: frequencies and posteriors.

Genotypes stand in the order of VCF: those of the alleles (0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2), ...; a
single copy takes the place of two equal ones, and the others have no probability.

Defined results: likelihoods that are null count as all 1; samples with neither one nor two copies of a place (as a
woman's Y) say nothing and get null; a variant without samples that say anything keeps equal frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropletry.operators.alleles import genotype_index


def pairs(alleles: int) -> np.ndarray:
    """The two alleles of every genotype, in order."""
    return np.array([(a, b) for b in range(alleles) for a in range(b + 1)])


def _counted(x: pa.ListArray, k: int) -> tuple[np.ndarray, ...]:
    """The patterns of some variants of k alleles one after another: the variant's place, likelihoods, copies, samples."""
    flat, size = x.flatten(), k * (k + 1) // 2
    lists, ploidy, n = (flat.field(c) for c in ("l", "ploidy", "n"))
    lists = lists.fill_null(pa.scalar([1.0] * size, lists.type))
    if lists.value_lengths().to_numpy(zero_copy_only=False).tolist() != [size] * len(lists):
        raise ValueError("a sample's likelihoods are not those of all genotypes")
    like = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return np.repeat(np.arange(len(x)), x.value_lengths().to_numpy(zero_copy_only=False)), like, ploidy.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False)


def _frequencies(x: pa.ListArray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequencies of some variants of k alleles after the last round and before it, a row each."""
    af = before = np.full((len(x), k), 1 / k)
    variant, like, ploidy, n = _counted(x, k)
    if not len(variant):
        return af, before
    begins = np.flatnonzero(np.diff(variant, prepend=-1))
    told, held = variant[begins], np.stack([(pairs(k) == a).sum(axis=1) for a in range(k)], axis=1)  # copies of each allele
    (a, b), half, copies = pairs(k).T, (n * ploidy / 2)[:, None], np.add.reduceat(n * ploidy, begins)[:, None]
    # What a frequency's product counts: one copy has equal alleles only.
    times = np.where(a == b, 1.0, np.where(ploidy[:, None] == 1, 0.0, 2.0))
    for _ in range(rounds):
        own = af[variant]
        w = like * times * own[:, a] * np.where((ploidy == 1)[:, None], 1.0, own[:, b])
        share = (w / w.sum(axis=1, keepdims=True)) @ held * half
        af, before = af.copy(), af
        af[told] = np.add.reduceat(share, begins) / copies
    return af, before


def frequencies_by_em(likelihoods: DataFrame, rounds: int = 10) -> DataFrame:
    """(snp_id, af: of every allele, last: those of the round before) from (snp_id, n_allele, ploidy, l: the
    likelihoods of all genotypes) over samples, beginning with equal ones.

    Equal likelihoods are counted first, so a variant is one row of few patterns, and the rounds of a batch of
    variants run together there.
    """
    counted = likelihoods.groupBy("snp_id", "n_allele", "ploidy", "l").agg(F.count("*").alias("n"))
    told = F.when(F.col("ploidy").isin(1, 2), F.struct("ploidy", "l", "n"))
    every = counted.groupBy("snp_id", "n_allele").agg(F.array_sort(F.collect_list(told)).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alleles = batch.column("n_allele")
            for k in alleles.unique().to_pylist():
                own = batch.filter(pc.equal(alleles, k))
                arrays = [pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * k, v.ravel()) for v in _frequencies(own.column("x"), k, rounds)]
                yield pa.RecordBatch.from_arrays([own.column("snp_id"), *arrays], names=["snp_id", "af", "last"])

    return every.mapInArrow(run, f"snp_id {dict(likelihoods.dtypes)['snp_id']}, af array<double>, last array<double>")


def _of_genotypes(alleles: Column, value) -> Column:
    """An array of ``value`` (place, larger allele, smaller allele) of all genotypes."""
    def one(at: Column) -> Column:
        high = F.floor((F.sqrt(8 * at + 1) - 1) / 2).cast("int")
        return value(at, high, (at - high * (high + 1) / 2).cast("int"))

    return F.transform(F.sequence(F.lit(0), (alleles * (alleles + 1) / 2 - 1).cast("int")), one)


def prior(alleles: Column, ploidy: Column, af: Column) -> Column:
    """The probabilities of all genotypes from an array of frequencies."""
    of = lambda x: F.get(af, x)
    two = _of_genotypes(alleles, lambda at, b, a: F.when(a == b, 1.0).otherwise(2.0) * of(a) * of(b))
    one = _of_genotypes(alleles, lambda at, b, a: F.when(a == b, of(a)).otherwise(0.0))
    return F.when(ploidy == 2, two).when(ploidy == 1, one)


def _scaled(p: Column) -> Column:
    # One step through an array of one, so that the sum is taken once.
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.when(p.isNotNull(), F.element_at(F.transform(F.array(total), lambda t: F.transform(p, lambda v: v / t)), 1))


def likelihood_posteriors(likelihoods: DataFrame, rounds: int = 10) -> DataFrame:
    """``likelihoods`` with p: the probabilities of all genotypes under the frequencies before the last round.

    A row for each variant is no small table, whatever Spark guesses, so it is never broadcast.
    """
    af = frequencies_by_em(likelihoods, rounds)
    ones = _of_genotypes(F.col("n_allele"), lambda at, b, a: F.lit(1.0))
    weighed = F.zip_with(F.coalesce("l", ones), prior(F.col("n_allele"), F.col("ploidy"), F.col("last")), lambda x, y: x * y)
    rows = likelihoods.join(af.hint("merge"), "snp_id").withColumn("p", weighed)
    return rows.withColumn("p", _scaled(F.col("p"))).drop("last")


def call_posteriors(calls: DataFrame, error: float = 0.01) -> DataFrame:
    """``calls`` (snp_id, n_allele, ploidy, gt: numbers of its alleles, null or with nulls where missing) with p:
    1 - error for the called genotype, the rest shared; of a missing one, by frequency with one allele more."""
    known = (F.size("gt") > 0) & F.forall("gt", lambda a: a.isNotNull()) & F.col("ploidy").isin(1, 2)
    counts = calls.where(known).select("snp_id", F.explode("gt").alias("allele")).groupBy("snp_id", "allele").agg(F.count("*").alias("n"))
    counts = counts.groupBy("snp_id").agg(F.map_from_entries(F.collect_list(F.struct("allele", "n"))).alias("held"), F.sum("n").alias("an"))
    share = F.transform(F.sequence(F.lit(0), F.col("n_allele") - 1), lambda a: (F.coalesce(F.try_element_at("held", a), F.lit(0)) + 1 / F.col("n_allele")) / (F.coalesce("an", F.lit(0)) + 1))
    rows = calls.join(counts, "snp_id", "left").withColumn("af", share)
    first, last = F.array_min("gt"), F.array_max("gt")
    called = genotype_index(first, last)
    others = F.col("n_allele") * (F.col("n_allele") + 1) / 2 - 1
    told = _of_genotypes(F.col("n_allele"), lambda at, b, a: F.when(at == called, 1 - error).otherwise(error / others))
    p = F.when(F.coalesce(known, F.lit(False)), told).otherwise(prior(F.col("n_allele"), F.col("ploidy"), F.col("af")))
    return rows.withColumn("p", p).drop("held", "an")
