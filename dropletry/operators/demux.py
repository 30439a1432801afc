"""From likelihoods of donors and pairs of donors to calls."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A call needs this much more log likelihood than its rival.
MARGIN = 2.0


def best_and_next(llk: DataFrame, unordered: bool = True) -> DataFrame:
    """Per droplet the best and second-best single donor and pair of (j, k, n, llk).

    Ties go to the smaller j, k, n.  ``unordered``: at equal shares j with k is k with j, and one of
    them counts.
    """
    rows = llk.where((F.col("n") == 0) | (F.col("j") > F.col("k"))) if unordered else llk
    rows = rows.withColumn("single", F.col("n") == 0)
    order = Window.partitionBy("cell_id", "single").orderBy(F.desc("llk"), "j", "k", "n")
    top = rows.withColumn("r", F.row_number().over(order)).where("r <= 2")
    pick = lambda single, r, c: F.max(F.when((F.col("single") == single) & (F.col("r") == r), F.col(c)))
    named = {}
    for name, single, r in (("sng_best", True, 1), ("sng_next", True, 2), ("dbl_best", False, 1), ("dbl_next", False, 2)):
        named[name] = pick(single, r, "j")
        if not single:
            named[f"{name}2"] = pick(single, r, "k")
        named[f"{name}_llk"] = pick(single, r, "llk")
    return top.groupBy("cell_id").agg(*(c.alias(n) for n, c in named.items()))


def log_priors(donors: int, alphas: int, doublet: float) -> tuple[float, float]:
    """Log prior of each single donor and of each unordered pair at equal shares."""
    if donors < 2 or alphas < 2:
        raise ValueError("calls need two donors and a share besides 0 at least")
    return math.log((1 - doublet) / donors), math.log(2 * doublet / donors / (donors - 1) / (alphas - 1))


def posteriors(llk: DataFrame, donors: int, doublet: float = 0.5) -> DataFrame:
    """(cell_id, sng_posterior, sng_only_posterior, log_total): by a proper log-sum-exp."""
    single, pair = log_priors(donors, 2, doublet)
    rows = llk.where((F.col("n") == 0) | (F.col("j") > F.col("k"))).withColumn("x", F.col("llk") + F.when(F.col("n") == 0, F.lit(single)).otherwise(F.lit(pair)))
    top = rows.groupBy("cell_id").agg(F.max("x").alias("top"), F.max(F.when(F.col("n") == 0, F.col("x"))).alias("best"))
    scaled = rows.join(top, "cell_id").withColumn("e", F.exp(F.col("x") - F.col("top")))
    sums = scaled.groupBy("cell_id").agg(F.sum("e").alias("all"), F.sum(F.when(F.col("n") == 0, F.col("e"))).alias("singles"), F.first("top").alias("top"), F.first("best").alias("best"))
    return sums.select(
        "cell_id", (F.col("singles") / F.col("all")).alias("sng_posterior"), (F.exp(F.col("best") - F.col("top")) / F.col("singles")).alias("sng_only_posterior"),
        (F.col("top") + F.ln("all")).alias("log_total"),
    )


def droplet_type(sng: Column, sng_next: Column, dbl: Column) -> Column:
    """DBL, SNG or AMB."""
    return F.when(dbl > sng + MARGIN, "DBL").when(sng > sng_next + MARGIN, "SNG").otherwise("AMB")


def calls(best: DataFrame) -> DataFrame:
    """The call of each droplet, its best and next guess ("j,k") and their log likelihoods."""
    one = lambda a: F.concat_ws(",", F.col(a), F.col(a))
    two = lambda a: F.concat_ws(",", F.col(a), F.col(f"{a}2"))
    kind = droplet_type(F.col("sng_best_llk"), F.col("sng_next_llk"), F.col("dbl_best_llk"))
    double = F.col("type") == "DBL"
    # The rival: after a pair another pair or the best donor, after a donor a pair or the next donor.
    rival_pair = F.when(double, F.col("dbl_next_llk") > F.col("sng_best_llk") + MARGIN).otherwise(F.col("dbl_best_llk") > F.col("sng_next_llk") + MARGIN)
    out = best.withColumn("type", kind).withColumn("pair", rival_pair)
    out = out.withColumns({
        "best_guess": F.when(double, two("dbl_best")).otherwise(one("sng_best")), "best_llk": F.when(double, F.col("dbl_best_llk")).otherwise(F.col("sng_best_llk")),
        "next_guess": F.when(double, F.when(F.col("pair"), two("dbl_next")).otherwise(one("sng_best"))).otherwise(F.when(F.col("pair"), two("dbl_best")).otherwise(one("sng_next"))),
        "next_llk": F.when(double, F.when(F.col("pair"), F.col("dbl_next_llk")).otherwise(F.col("sng_best_llk"))).otherwise(F.when(F.col("pair"), F.col("dbl_best_llk")).otherwise(F.col("sng_next_llk"))),
    })
    return out.select("cell_id", "type", "best_guess", "best_llk", "next_guess", "next_llk")
