"""Alleles and reads as values: normal forms of variants, ploidy, codes of bases, ends of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropletry.functions.phred import string_hash
from dropletry.operators.ranking import saved

# The part of X that males have once, 1-based and closed.
X_BEGIN, X_END = 2699520, 154931044
#: Codes of two bases.
IUPAC = {"AA": "A", "CC": "C", "GG": "G", "TT": "T", "AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}


def is_normalized(ref: Column, alts: Column) -> Column:
    """Whether a variant is in normal form: its alleles end in different bases, and one of them is a single
    base or they begin with different ones; without alternatives, or with those equal to ref, it is."""
    every = F.transform(F.concat(F.array(ref), alts), F.upper)
    first = F.element_at(every, 1)
    same = lambda part: F.forall(every, lambda x: part(x) == part(first))
    single = F.exists(every, lambda x: F.length(x) == 1)
    bad = same(lambda x: F.right(x, F.lit(1))) | (~single & same(lambda x: F.left(x, F.lit(1))))
    plain = (F.size(alts) == 1) & F.forall(every, lambda x: F.length(x) == 1)
    return (F.size(alts) == 0) | plain | F.forall(every, lambda x: x == first) | ~bad


def _bound(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _shared(x: Column, y: Column) -> Column:
    """How many leading letters two strings share, less than the shorter one has."""
    n = F.least(F.length(x), F.length(y))
    same = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.coalesce(p == q, F.lit(False)))
    upto = _bound(same, lambda v: F.when(F.array_position(v, False) == 0, F.size(v)).otherwise(F.array_position(v, False) - 1))
    return F.greatest(F.least(upto, n - 1), F.lit(0)).cast("int")


def normalized(pos: Column, ref: Column, alt: Column, before: Column) -> Column:
    """struct(pos, ref, alt): a pair of alleles trimmed from the right, moved left and trimmed from the left.

    ``before``: the reference's bases that end just before pos; the variant moves no further than they go.
    """
    whole = F.struct(F.concat(before, ref).alias("r"), F.concat(before, alt).alias("a"))
    cut = lambda v, n: F.struct(F.left(v["r"], F.length(v["r"]) - n).alias("r"), F.left(v["a"], F.length(v["a"]) - n).alias("a"))
    ended = _bound(whole, lambda v: _bound(_shared(F.reverse(v["r"]), F.reverse(v["a"])), lambda n: cut(v, n)))
    begun = lambda v, n: F.struct((pos - F.length(before) + n).alias("pos"), F.right(v["r"], F.length(v["r"]) - n).alias("ref"), F.right(v["a"], F.length(v["a"]) - n).alias("alt"))
    moved = _bound(ended, lambda v: _bound(_shared(v["r"], v["a"]), lambda n: begun(v, n)))
    return F.when(ref == alt, F.struct(pos.alias("pos"), ref.alias("ref"), alt.alias("alt"))).otherwise(moved)


def normalized_by_reference(variants: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """``variants`` (chrom, pos: from 1, ref, alt and others) in normal form against a reference.

    blocks: ``sequences.blocks`` of that width.  In a round every variant that can still move left meets the
    block before it by an equality and moves up to that block's begin; only those that used it up go on.
    Alleles are compared as they are written; the reference is taken in upper case.  A variant whose sequence is
    not listed moves no further than its own alleles allow.
    """
    others = [c for c in variants.columns if c not in ("pos", "ref", "alt")]
    ends_alike = (F.right("ref", F.lit(1)) == F.right("alt", F.lit(1))) & (F.col("ref") != F.col("alt"))
    near = blocks.select("chrom", F.col("pos0").alias("_pos0"), F.col("seq").alias("_seq"))

    def moved(rows: DataFrame, before: Column) -> DataFrame:
        found = rows.select(*others, normalized(F.col("pos"), F.col("ref"), F.col("alt"), before).alias("_v"), (F.length(before) > 0).alias("_met"))
        return found.select(*others, "_v.*", "_met")

    todo = saved(moved(variants, F.lit("")))
    done = todo.where(~F.coalesce(ends_alike, F.lit(False)))
    todo = todo.where(ends_alike)
    while True:
        keyed = todo.drop("_met").withColumn("_pos0", F.floor((F.col("pos") - 2) / width) * width)
        before = F.coalesce(F.substring("_seq", F.lit(1), (F.col("pos") - 1 - F.col("_pos0")).cast("int")), F.lit(""))
        rows = saved(moved(keyed.join(near, ["chrom", "_pos0"], "left"), before))
        more = rows.where(ends_alike & F.col("_met"))
        done = done.unionByName(rows.where(~F.coalesce(ends_alike & F.col("_met"), F.lit(False))))
        if more.isEmpty():
            return done.select(variants.columns)
        todo = more


def reduced_sv_type(alt: Column) -> Column:
    """Numbered copy-number and repeat alleles by their kind alone."""
    return F.when(alt.rlike(r"^<CN\d+>$"), "<CNV>").when(alt.rlike(r"^<VN\d+>$"), "<VNTR>").otherwise(alt)


def repeat_unit(seq: Column, most: int = 6) -> Column:
    """struct(motif, copies): the shortest unit of up to ``most`` bases that repeats to give the whole; else null."""
    copies = lambda n: F.floor(F.length(seq) / n).cast("int")
    fits = lambda n: (copies(n) >= 2) & (F.repeat(F.left(seq, F.lit(n)), copies(n)) == seq)
    out = F.lit(None)
    for n in range(most, 0, -1):
        out = F.when(fits(n), F.struct(F.left(seq, F.lit(n)).alias("motif"), copies(n).alias("copies"))).otherwise(out)
    return out


def variant_text(chrom: Column, pos: Column, ref: Column, alts: Column) -> Column:
    """chrom:pos:ref:alt,alt with the alternatives in the order of their letters."""
    return F.concat_ws(":", chrom, pos.cast("string"), ref, F.array_join(F.array_sort(alts), ","))


def consistent_reference(ref: Column, bases: Column) -> Column:
    """Whether ref is what the reference's bases at its place say; letters that are no base match any."""
    pairs = F.arrays_zip(F.split(F.upper(ref), "").alias("r"), F.split(F.upper(bases), "").alias("b"))
    return (F.length(ref) == F.length(bases)) & F.forall(pairs, lambda p: (p["r"] == p["b"]) | ~p["b"].isin("A", "C", "G", "T"))


def probes(ref: Column, alt: Column, before: Column, after: Column, flank: int) -> Column:
    """struct(ref, alt): both alleles between ``flank`` bases of the reference."""
    around = lambda x: F.concat(F.right(before, F.lit(flank)), x, F.left(after, F.lit(flank)))
    return F.struct(around(ref).alias("ref"), around(alt).alias("alt"))


def ploidy(chrom: Column, pos: Column, male: Column) -> Column:
    """Copies of a place: of the sex chromosomes by sex, of the mitochondrion one."""
    plain = F.regexp_replace(chrom, "^chr", "")
    once = pos.between(X_BEGIN, X_END) & male
    return F.when(plain == "X", F.when(once, 1).otherwise(2)).when(plain == "Y", F.when(male, 1).otherwise(0)).when(plain.isin("M", "MT"), 1).otherwise(2)


def genotype_index(a: Column, b: Column) -> Column:
    """The place of a diploid genotype among those of all alleles."""
    low, high = F.least(a, b), F.greatest(a, b)
    return low + F.floor(high * (high + 1) / 2).cast("long")


def genotype_count(alleles: Column, copies: int) -> Column:
    """How many genotypes so many alleles make: C(alleles + copies - 1, copies)."""
    top = F.lit(1.0)
    for k in range(copies):
        top = top * (alleles + k) / (k + 1)
    return F.round(top).cast("long")


def iupac(a: Column, b: Column) -> Column:
    """The code of two bases, N if one is no base."""
    known = F.create_map(*[F.lit(x) for pair in IUPAC.items() for x in pair])
    return F.coalesce(F.element_at(known, F.concat(F.least(F.upper(a), F.upper(b)), F.greatest(F.upper(a), F.upper(b)))), F.lit("N"))


def phred_score(p: Column) -> Column:
    """-10 log10 of a probability, 99 at most."""
    return F.when(p == 0, 99.0).otherwise(F.least(F.lit(99.0), -4.3429 * F.ln(p)))


def kmer_code(seq: Column) -> Column:
    """Bases as digits of base four, A 0 to T 3."""
    return F.conv(F.translate(F.upper(seq), "ACGT", "0123"), 4, 10).cast("long")


def thinned(key: Column, share: float, seed: int = 0) -> Column:
    """Whether a row stays when ``share`` of all are kept: by its key's hash, so that a rerun keeps the same."""
    return string_hash(key, seed) % 65535 < int(65535 * share)


def read_ends(pos0: Column, cigar: Column) -> Column:
    """struct(end, clip_beg, clip_end, ops): where an alignment ends (excluded), its ends with clipped bases
    counted in, and how many operations on bases it has."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[A-Z=])"), 1)
    total = lambda xs, ops: F.aggregate(xs, F.lit(0).cast("long"), lambda s, p: s + F.when(F.right(p, F.lit(1)).isin(*ops), F.regexp_extract(p, r"^(\d+)", 1).cast("long")).otherwise(0))
    clips = lambda xs: F.aggregate(xs, F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("on")), lambda s, p: F.struct(F.when(s["on"] & F.right(p, F.lit(1)).isin("S", "H"), s["n"] + F.regexp_extract(p, r"^(\d+)", 1).cast("long")).otherwise(s["n"]).alias("n"), (s["on"] & F.right(p, F.lit(1)).isin("S", "H")).alias("on")))["n"]
    end = pos0 + total(parts, "MDN=X")
    return F.struct(end.alias("end"), (pos0 - clips(parts)).alias("clip_beg"), (end + clips(F.reverse(parts))).alias("clip_end"), total(parts, "MIDNSHP=X").alias("ops"))
