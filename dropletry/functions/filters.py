"""Filters of variant records as plain column functions, to be joined by & and |.

A field is an array: of a site's values, or of one value for each sample.  A comparison holds for a
record when it holds for any element.  Missing values are null elements: they equal a missing value
only, and differ from every known one; an order never holds for them.  Numbers compare as floats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dropletry.functions.logs import binomial_two_sided

#: Numbers beyond this compare as doubles, as floats don't hold them exactly.
EXACT = float(1 << 24)
_PLAIN: dict[str, Callable] = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}


def holds(x: Column, op: str, y: Column) -> Column:
    """Whether two numbers compare so; missing ones by the rules above."""
    plain = _PLAIN[op]
    known = F.when((x > EXACT) | (y > EXACT), plain(x, y)).otherwise(plain(x.cast("float"), y.cast("float")))
    missing = x.isNull().cast("int") + y.isNull().cast("int")
    lacking = missing == 2 if op == "==" else missing == 1 if op == "!=" else F.lit(False)
    return F.when(missing == 0, known).otherwise(lacking)


def _elements(values: Column) -> Column:
    return F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(None).cast("double")))


def any_value(values: Column, op: str, other: Column | float) -> Column:
    """Whether any element compares so; an empty array is one missing value."""
    y = other if isinstance(other, Column) else F.lit(float(other))
    return F.exists(_elements(values), lambda x: holds(x, op, y))


def by_sample(values: Column, op: str, other: Column | float) -> Column:
    """For each sample whether its value compares so: combine by ``same_sample``."""
    y = other if isinstance(other, Column) else F.lit(float(other))
    return F.transform(values, lambda x: holds(x, op, y))


def same_sample(*tests: Column) -> Column:
    """Whether one sample passes all of these tests by sample."""
    both = tests[0]
    for t in tests[1:]:
        both = F.zip_with(both, t, lambda a, b: a & b)
    return F.exists(both, lambda x: x)


def any_text(text: Column, wanted: list[str]) -> Column:
    """Whether a text is one of a list; a missing one is ".", so a list in a file may name that too."""
    return F.coalesce(text, F.lit(".")).isin(*wanted)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.coalesce(text, F.lit(".")).rlike(f"(?i){pattern}" if ignore_case else pattern)


def at(values: Column, *places: int) -> Column:
    """The elements at these places, from 0."""
    return F.array(*(F.get(values, F.lit(p)) for p in places))


def after(values: Column, first: int) -> Column:
    """The elements from a place on."""
    return F.slice(values, first + 1, F.greatest(F.size(values) - first, F.lit(0)))


def of_samples(values: Column, names: list[str], wanted: list[str]) -> Column:
    """The values of the samples that are named, in the order of ``names``."""
    return at(values, *(k for k, n in enumerate(names) if n in wanted))


# ---- Aggregates of an array; of a sample's own values with ``transform`` ----
def known(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def total(values: Column) -> Column:
    return F.aggregate(known(values), F.lit(0.0), lambda s, x: s + x)


def mean(values: Column) -> Column:
    return total(values) / F.nullif(F.size(known(values)).cast("double"), F.lit(0.0))


def median(values: Column) -> Column:
    v = F.array_sort(known(values))
    n = F.size(v)
    return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)


def stdev(values: Column) -> Column:
    m = mean(values)
    return F.sqrt(mean(F.transform(known(values), lambda x: (x - m) * (x - m))))


def per_sample(values: Column, aggregate: Callable[[Column], Column]) -> Column:
    """The aggregate of each sample's array of values."""
    return F.transform(values, aggregate)


def passing_samples(tests: Column) -> Column:
    """How many samples pass."""
    return F.size(F.filter(tests, lambda x: x))


def passing_share(tests: Column) -> Column:
    return passing_samples(tests) / F.nullif(F.size(tests), F.lit(0))


def phred(p: Column) -> Column:
    return -10 * F.log10(p)


def binomial(depths: Column) -> Column:
    """The two-sided probability of the first two depths, if both alleles are drawn alike."""
    return binomial_two_sided(F.get(depths, F.lit(0)), F.get(depths, F.lit(1)))


# ---- Genotypes: an array of arrays of allele numbers, null where one is missing ----
def alleles_of(gt: Column) -> Column:
    """"0/1" as its allele numbers; "." gives null."""
    return F.transform(F.split(gt, "[/|]"), lambda a: a.try_cast("int"))


GENOTYPES: dict[str, Callable[[Column], Column]] = {
    "mis": lambda g: F.exists(g, lambda a: a.isNull()),
    "hap": lambda g: (F.size(g) == 1) & g[0].isNotNull(),
    "hom": lambda g: (F.size(g) > 1) & F.forall(g, lambda a: F.coalesce(a == g[0], F.lit(False))),
    "het": lambda g: (F.size(g) > 1) & F.forall(g, lambda a: a.isNotNull()) & F.exists(g, lambda a: a != g[0]),
    "ref": lambda g: F.forall(g, lambda a: F.coalesce(a == 0, F.lit(False))),
    "alt": lambda g: F.forall(g, lambda a: a.isNotNull()) & F.exists(g, lambda a: a > 0),
    "rr": lambda g: (F.size(g) == 2) & F.forall(g, lambda a: F.coalesce(a == 0, F.lit(False))),
    "ra": lambda g: (F.size(g) == 2) & F.exists(g, lambda a: a == 0) & F.exists(g, lambda a: a > 0),
    "aA": lambda g: (F.size(g) == 2) & F.forall(g, lambda a: F.coalesce(a > 0, F.lit(False))) & (g[0] != g[1]),
    "aa": lambda g: (F.size(g) == 2) & F.forall(g, lambda a: F.coalesce(a > 0, F.lit(False))) & (g[0] == g[1]),
    "r": lambda g: (F.size(g) == 1) & F.coalesce(g[0] == 0, F.lit(False)),
    "a": lambda g: (F.size(g) == 1) & F.coalesce(g[0] > 0, F.lit(False)),
}


def genotype_is(kind: str, gts: Column) -> Column:
    """For each sample whether its genotype is of a kind, one of ``GENOTYPES``."""
    return F.transform(gts, lambda g: F.coalesce(GENOTYPES[kind](g), F.lit(False)))


def allele_number(gts: Column) -> Column:
    """AN: the alleles that are called."""
    return F.size(known(F.flatten(gts)))


def allele_count(gts: Column, alts: Column) -> Column:
    """AC: how often each alternative allele is called."""
    every = known(F.flatten(gts))
    return F.transform(F.sequence(F.lit(1), F.size(alts)), lambda k: F.size(F.filter(every, lambda a: a == k)))


def minor_count(gts: Column, alts: Column) -> Column:
    """MAC: of each alternative allele its calls or the others', whichever are fewer."""
    an = allele_number(gts)
    return F.transform(allele_count(gts, alts), lambda n: F.least(n, an - n))


def frequency(gts: Column, alts: Column) -> Column:
    """AF of each alternative allele; null without calls."""
    an = allele_number(gts)
    return F.transform(allele_count(gts, alts), lambda n: F.when(an > 0, n / an))


def minor_frequency(gts: Column, alts: Column) -> Column:
    """MAF of each alternative allele."""
    return F.transform(frequency(gts, alts), lambda x: F.least(x, 1 - x))


def missing_samples(gts: Column) -> Column:
    """N_MISSING: samples without a whole call; F_MISSING is its share."""
    return F.size(F.filter(gts, lambda g: F.exists(g, lambda a: a.isNull())))


def length_change(ref: Column, alts: Column) -> Column:
    """ILEN: bases that each alternative allele inserts, or deletes as a negative number; null if neither."""
    return F.transform(alts, lambda a: F.when(F.length(a) != F.length(ref), F.length(a) - F.length(ref)))


def kind_of(ref: Column, alt: Column) -> Column:
    """TYPE of one alternative allele: ref, snp, mnp, indel, bnd, overlap or other."""
    spelt, same = alt.rlike("^[ACGTNacgtn]+$"), F.length(alt) == F.length(ref)
    return (
        F.when(alt.isin(".", "<*>", "<NON_REF>") | (F.upper(alt) == F.upper(ref)), "ref").when(alt == "*", "overlap").when(alt.contains("[") | alt.contains("]"), "bnd")
        .when(~spelt, "other").when(same & (F.length(ref) == 1), "snp").when(same, "mnp").otherwise("indel")
    )


def any_kind(ref: Column, alts: Column, kind: str) -> Column:
    """Whether any alternative allele is of a kind."""
    return F.exists(alts, lambda a: kind_of(ref, a) == kind)
