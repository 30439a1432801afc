"""Communities of a weighted graph by greedy modularity, level by level.

A level starts with every node on its own.  In a round all nodes find the community that gains most, at once.
Of those that would move, two sets could do so together: those without a neighbour of higher rank (by gain, then
by hash) that would move too, for which the communities' totals tell exactly what all their moves change; and
those that are the best mover of both communities they touch, whose gains add up.  The set that gains more
moves, so modularity never falls, however many nodes move at once.  After ``rounds`` rounds, or when none gains,
communities become the nodes of the next level, their inner edges loops; levels end when one changes nothing.
At last single nodes move again, ``rounds`` rounds at most, in the graph of the first level.

Defined results: repeated edges are added; a node whose edges are loops only stays alone; edges with a null end,
a null weight or one that is not above 0 are left out; no edges, no rows; of equal gains the smaller community and
of equal movers one by hash comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dropletry.operators.ranking import saved

#: Gains in modularity under this are rounding.
LEAST = 1e-12


def _both(edges: DataFrame) -> DataFrame:
    """Every edge from either end; a loop twice, so that it counts twice in its node's degree."""
    return edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """Of communities (node, community) in a graph (src, dst, w); 0 for a graph without edges."""
    rows = _both(edges).join(communities.select(F.col("node").alias("src"), F.col("community").alias("a")), "src")
    rows = rows.join(communities.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    sums = rows.groupBy("a").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    whole, inside, squares = sums.agg(F.sum("total"), F.sum("inside"), F.sum(F.col("total") * F.col("total"))).first()
    return inside / whole - squares / whole**2 if whole else 0.0


def _moves(near: DataFrame, nodes: DataFrame, whole: float, turn: int) -> DataFrame | None:
    """(node, community) of the nodes that move, if any; near: edges from either end without loops; nodes: (node, k:
    degree, community)."""
    totals = nodes.groupBy("community").agg(F.sum("k").alias("total"))
    to = near.join(nodes.select(F.col("node").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w").alias("w_in"))
    rows = to.join(nodes.select("node", "k", F.col("community").alias("own")), "node").join(totals, "community")
    home = F.col("community") == F.col("own")
    # What a community gives to a node, apart from the node itself.
    value = F.col("w_in") - F.col("k") * (F.col("total") - F.when(home, F.col("k")).otherwise(0.0)) / whole
    rows = rows.withColumn("value", value)
    best = F.max_by(F.struct("community", "value", "w_in"), F.struct("value", -F.col("community")))
    found = rows.groupBy("node").agg(F.first("own").alias("own"), F.first("k").alias("k"), F.coalesce(F.max(F.when(home, F.col("w_in"))), F.lit(0.0)).alias("w_own"), best.alias("best"))
    found = found.join(totals.select(F.col("community").alias("own"), F.col("total").alias("own_total")), "own")
    gain = F.col("best.value") - (F.col("w_own") - F.col("k") * (F.col("own_total") - F.col("k")) / whole)
    rank = F.struct(gain.alias("gain"), F.xxhash64("node", F.lit(turn)).alias("hash"), "node")
    movers = found.where((F.col("best.community") != F.col("own")) & (gain > LEAST * whole))
    movers = saved(movers.select("node", "own", "k", F.col("best.community").alias("community"), (F.col("best.w_in") - F.col("w_own")).alias("more"), rank.alias("rank")))
    # Those with a neighbour of higher rank wait.
    ends = lambda side: movers.select(F.col("node").alias(side), F.col("rank").alias(f"r_{side}"))
    waiting = near.join(ends("src"), "src").join(ends("dst"), "dst").where("r_src < r_dst").select(F.col("src").alias("node")).distinct()
    apart = movers.join(waiting, "node", "left_anti")
    sides = F.array(F.struct(F.col("own").alias("community"), (-F.col("k")).alias("k"), "more"), F.struct("community", "k", F.lit(0.0).alias("more")))
    shifts = apart.select(F.explode(sides).alias("x")).groupBy("x.community").agg(F.sum("x.k").alias("shift"), F.sum("x.more").alias("more")).join(totals, "community")
    more, squares = shifts.agg(F.sum("more"), F.sum(F.col("shift") * (2 * F.col("total") + F.col("shift")))).first()
    if more is None:
        return None
    touched = movers.select("rank", F.explode(F.array("own", "community")).alias("touched")).groupBy("touched").agg(F.max("rank").alias("first"))
    firsts = lambda side: touched.select(F.col("touched").alias(side), F.col("first").alias(f"first_{side}"))
    matched = movers.join(firsts("own"), "own").join(firsts("community"), "community")
    matched = saved(matched.where((F.col("rank") == F.col("first_own")) & (F.col("rank") == F.col("first_community"))).select("node", "community", F.col("rank.gain").alias("gain")))
    crowd = matched.agg(2 * F.sum("gain")).first()[0]
    return apart.select("node", "community") if 2 * more - squares / whole > crowd else matched.drop("gain")


def _settled(near: DataFrame, nodes: DataFrame, whole: float, rounds: int, turn: int) -> tuple[DataFrame, bool]:
    """``nodes`` after so many rounds at most, and whether any moved."""
    changed = False
    for k in range(rounds):
        if (moves := _moves(near, nodes, whole, turn + k)) is None:
            break
        changed = True
        joined = nodes.join(moves.withColumnRenamed("community", "to"), "node", "left")
        nodes = saved(joined.select("node", "k", F.coalesce("to", "community").alias("community")))
    return nodes, changed


def louvain(edges: DataFrame, rounds: int = 6, levels: int = 60) -> tuple[DataFrame, list[float]]:
    """((node, community), the modularity after each level, and after the last moves): a community is named by a node.

    edges: (src, dst, w), nodes being whole numbers, each edge from either end or both.
    """
    graph = saved(edges.where("src is not null and dst is not null and w > 0").groupBy(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).agg(F.sum(F.col("w").cast("double")).alias("w")))
    first, told = graph, []
    whole = graph.agg(2 * F.sum("w")).first()[0]
    found = saved(_both(graph).select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")))
    if not whole:
        return found, told
    degrees = None
    for level in range(levels):
        both = _both(graph)
        nodes = saved(both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).withColumn("community", F.col("node")))
        degrees = nodes.drop("community") if degrees is None else degrees
        nodes, changed = _settled(saved(both.where("src <> dst")), nodes, whole, rounds, level * rounds)
        if not changed:
            break
        of = nodes.select("node", "community")
        found = saved(found.withColumnRenamed("community", "inner").join(of.withColumnRenamed("node", "inner"), "inner").select("node", "community"))
        ends = lambda side: of.select(F.col("node").alias(side), F.col("community").alias(f"c_{side}"))
        rows = graph.join(ends("src"), "src").join(ends("dst"), "dst")
        graph = saved(rows.groupBy(F.least("c_src", "c_dst").alias("src"), F.greatest("c_src", "c_dst").alias("dst")).agg(F.sum("w").alias("w")))
        told.append(modularity(first, found))
    nodes, changed = _settled(saved(_both(first).where("src <> dst")), saved(found.join(degrees, "node").select("node", "k", "community")), whole, rounds, levels * rounds)
    if changed:
        found = nodes.select("node", "community")
        told.append(modularity(first, found))
    return found, told
