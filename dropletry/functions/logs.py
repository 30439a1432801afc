"""Logarithms of probabilities and counts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def phred_of_error(p: Column) -> Column:
    """The quality of an error probability: rounded, from 0 to 255."""
    d = -10 * F.log10(p)
    return F.when(p <= 0, 255).when(d > 255, 255).when(d < 0, 0).otherwise(F.floor(d + 0.5)).cast("int")


def pl_of(p: Column) -> Column:
    """A probability as a rounded Phred-scaled likelihood."""
    return F.floor(-10 * F.log10(p) + 0.5).cast("int")


def probability_of_pl(pl: Column) -> Column:
    return F.pow(F.lit(10.0), pl / -10.0)


def log10_sum(a: Column, b: Column) -> Column:
    """log10(10^a + 10^b)."""
    top = F.greatest(a, b)
    return top + F.log10(1 + F.pow(F.lit(10.0), F.least(a, b) - top))


def log10_factorial(n: Column) -> Column:
    whole = n.cast("int")
    return F.when(whole <= 1, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(whole, F.lit(1))), F.lit(0.0), lambda s, k: s + F.log10(k)))


def log10_binomial(n: Column, k: Column) -> Column:
    """log10 of the ways to choose k of n."""
    return log10_factorial(n) - log10_factorial(k) - log10_factorial(n - k)


def binomial_two_sided(a: Column, b: Column) -> Column:
    """The probability that of a + b fair draws the rarer side comes as rarely as min(a, b), on either side."""
    n, m = (a + b).cast("int"), F.least(a, b).cast("int")
    first = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.pow(F.lit(0.5), n).alias("total"))
    step = lambda s, i: F.struct((s["term"] * (n - i + 1) / i).alias("term"), (s["total"] + s["term"] * (n - i + 1) / i).alias("total"))
    tail = F.when(m <= 0, first["total"]).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), first, step)["total"])
    return F.when(a == b, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))
