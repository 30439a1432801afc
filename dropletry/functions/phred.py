"""Phred qualities and genotype mathematics as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def error_probability(bq: Column) -> Column:
    """10^(-q/10); qualities of 0 and 1 say nothing, so a base is wrong with probability 0.75."""
    return F.when(bq > 1, F.pow(F.lit(0.1), bq * F.lit(0.1))).otherwise(F.lit(0.75))


def hardy_weinberg(af: Column) -> list[Column]:
    """Prior probabilities of 0, 1 and 2 copies of the alternative allele."""
    return [(1 - af) * (1 - af), 2 * af * (1 - af), af * af]


def added(columns: Sequence[Column]) -> Column:
    """The sum of columns, from left to right."""
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def log_sum_exp(value: Column, greatest: Column) -> Column:
    """ln of the sum of exp(value) over a group, where ``greatest`` is the group's largest value."""
    return F.first(greatest) + F.ln(F.sum(F.exp(value - greatest)))


def string_hash(text: Column, seed: int = 0x811C9DC5) -> Column:
    """h = h * 101 + c modulo 2^32 over the characters' codes."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(seed).cast("long"), lambda h, c: (h * 101 + c) % F.lit(4294967296))
