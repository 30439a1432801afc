"""Exact search for the largest inner products as a Voronoi join of queries and data.

Inner products become distances: every vector of the data is shortened by the longest one's length and gets
one more component that puts it on the unit sphere; a query has length one and a zero there.  The nearest
points of a query are then its largest inner products, in the same order, whatever the lengths.

Pivots, taken from a bounded sample, cut that space into cells, and their directions cut the queries.  Each cell is summed up: how far its queries
lie from its pivot at most, and how near its nearest vectors lie.  By the triangle inequality these summaries
alone bound how far a cell's queries must look: so far that enough vectors are certain to be met.  A vector is
needed in a cell of queries if its distance from the pivot, less the radius of the queries, is within that
bound; it is sent once to each team of neighbouring cells that needs it, and there compared by cell.  Any
choice of pivots gives exact results; the bounds decide only how many vectors travel.

Data without any clusters let no bound rule much out: each team then needs most of the data, and what
travels is the data times the number of teams.  Within a team the data are dealt out in blocks.

Equal vectors are one candidate with its smallest ids, so many as a result can hold, and equal queries are
searched for once.

Defined results: rows that take part are those of ``whole_vectors.usable``; scores that are equal stand in the
order of their ids, however many they are; a zero query scores zero with all, so it gets the smallest ids;
extra columns are ignored; without candidates a query has no rows; inner products beyond 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dropletry.llm.tables import checkpointed
from dropletry.llm.whole_vectors import centres, nearest, products, sample, usable, whole

#: Distances are worked out to about 3e-8; bounds are kept this much wider.
SLACK = 1e-6


@dataclass(frozen=True)
class Settings:
    """k: results of a query; sample: vectors that pivots are taken from; rows: wanted in a cell; fewest, most:
    pivots; team: distinct queries that are searched for together at most; block: vectors that a task compares
    them with, about."""

    k: int = 20
    sample: int = 4096
    rows: int = 1024
    fewest: int = 8
    most: int = 512
    team: int = 8192
    block: int = 8192


def on_sphere(x: np.ndarray, longest: float) -> np.ndarray:
    x = x / (longest or 1.0)
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)


def asking(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True)), 1e-300)
    return np.concatenate([x, np.zeros((len(x), 1))], axis=1)


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (to * to).sum(axis=1) - 2 * (x @ to.T)))


@dataclass(frozen=True)
class Plan:
    """views: the pivots of the queries; longest: length of the data's vectors; cells: that have queries; radius,
    reach: of each of those; team_of: the teams that the pieces of a cell's queries belong to; teams: how many."""

    views: np.ndarray
    longest: float
    cells: np.ndarray
    radius: np.ndarray
    reach: np.ndarray
    team_of: dict[int, list[int]]
    teams: int

    def needed(self, x: np.ndarray, at: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Which cells of queries need each vector of the data (on the sphere)."""
        return distances(x, self.views[self.cells[at]]) - self.radius[at] <= self.reach[at] + SLACK


def reaches(views: np.ndarray, pivots: np.ndarray, cells: np.ndarray, radius: np.ndarray, near: list[tuple[int, float, int]], k: int) -> np.ndarray:
    """How far the queries of each cell must look to meet k rows for certain; near: (cell, distance from its
    pivot, rows) of the vectors that lie nearest to their pivots."""
    if not near:
        return np.full(len(cells), np.inf)
    own, d, n = (np.array(x) for x in zip(*near))
    out = []
    for i, r in zip(cells, radius):
        bound = r + distances(views[i : i + 1], pivots)[0][own] + d
        order = np.argsort(bound, kind="stable")
        enough = np.flatnonzero(np.cumsum(n[order]) >= k)
        out.append(bound[order[enough[0]]] if len(enough) else np.inf)
    return np.array(out)


def teams_of(pivots: np.ndarray, counts: dict[int, int], most: int) -> tuple[dict[int, list[int]], int]:
    """Teams of neighbouring cells with at most so many queries; a cell with more is cut into pieces."""
    left, chain = set(counts), []
    while left:
        to = pivots[chain[-1]] if chain else pivots[min(left)]
        some = np.array(sorted(left))
        chain.append(int(some[((pivots[some] - to) ** 2).sum(axis=1).argmin()]))
        left.discard(chain[-1])
    out: dict[int, list[int]] = {}
    team, filled = 0, 0
    for cell in chain:
        pieces = -(-counts[cell] // most)
        for _ in range(pieces):
            share = -(-counts[cell] // pieces)
            if filled and filled + share > most:
                team, filled = team + 1, 0
            out.setdefault(cell, []).append(team)
            filled += share
    return out, team + 1


def _placed(rows: DataFrame, pivots: np.ndarray, on, schema: str) -> DataFrame:
    """``rows`` with the cell of their vector and its distance from the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = on(whole(batch.column("vector")))
                cell = nearest(x, pivots)
                d = np.sqrt(np.maximum(0, ((x - pivots[cell]) ** 2).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d, pa.float64())], names=[*batch.schema.names, "cell", "d"])

    return checkpointed(rows.mapInArrow(run, f"{schema}, cell int, d double"))


def best(score: np.ndarray, first: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, int]]:
    """(score, id) of the k largest scores of vectors that have ids, the first of them in ``first``."""
    least = np.partition(score, max(0, len(score) - k))[max(0, len(score) - k)]
    top = np.flatnonzero(score >= least)
    top = top[np.lexsort((first[top], -score[top]))[:k]]
    return sorted(((s, i) for s, t in zip(score[top].tolist(), top.tolist()) for i in ids[t]), key=lambda x: (-x[0], x[1]))[:k]


def search(vectors: DataFrame, is_query: Column, settings: Settings | None = None, *, key: str = "vec_id", embedding: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query with all other rows,
    from rank 1.  ``is_query`` may refer to ``id``."""
    s = settings or Settings()
    spark = vectors.sparkSession
    rows = checkpointed(usable(vectors, key, embedding, scale))
    # Of equal vectors the smallest ids alone can be in a result; one more, as a query passes over itself.
    of_vector = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("id")
    kept = rows.withColumn("n", F.row_number().over(of_vector)).where(F.col("n") <= s.k + 1)
    distinct = checkpointed(kept.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    squares = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    total, square = distinct.agg(F.count("*"), F.max(squares)).first()
    queries = rows.where(is_query)
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = float(square) ** 0.5
    pivots = centres(on_sphere(sample(distinct, s.sample), longest), min(s.most, max(s.fewest, total // s.rows)))
    views = asking(pivots[:, :-1])  # where queries lie, right below the pivots
    data = _placed(distinct, pivots, lambda x: on_sphere(x, longest), "vector array<long>, ids array<long>")
    reps = queries.groupBy("vector").agg(F.min("id").alias("rep"))
    asked = _placed(reps, views, asking, "vector array<long>, rep long")

    # The summaries: some rows for each cell, whose number the settings bound.
    nearest_of = Window.partitionBy("cell").orderBy("d")
    near = data.select("cell", "d", F.size("ids").alias("n")).withColumn("r", F.row_number().over(nearest_of)).where(F.col("r") <= s.k + 1)
    near = [(r["cell"], r["d"], r["n"]) for r in near.collect()]
    about = {r["cell"]: r for r in asked.groupBy("cell").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect()}
    cells = np.array(sorted(about), np.int64)
    radius = np.array([about[c]["d"] for c in cells.tolist()])
    team_of, teams = teams_of(views, {c: about[c]["n"] for c in about}, s.team)
    plan = spark.sparkContext.broadcast(Plan(views, longest, cells, radius, reaches(views, pivots, cells, radius, near, s.k + 1), team_of, teams))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        member = np.zeros((len(p.cells), p.teams), np.float32)
        for i, c in enumerate(p.cells.tolist()):
            member[i, p.team_of[c]] = 1
        for batch in batches:
            if batch.num_rows:
                need = p.needed(on_sphere(whole(batch.column("vector")), p.longest)) @ member > 0
                yield pa.RecordBatch.from_arrays([batch.column("vector"), batch.column("ids"), pa.array([np.flatnonzero(x) for x in need], pa.list_(pa.int32()))], names=["vector", "ids", "teams"])

    routed = checkpointed(data.mapInArrow(route, "vector array<long>, ids array<long>, teams array<int>"))
    sent = routed.select("vector", "ids", F.explode("teams").alias("team"))
    # A row for each team, whose number is that of the queries over the size of a team.
    blocks = [(r["team"], -(-r["count"] // s.block)) for r in sent.groupBy("team").count().collect()]
    blocks_of = F.broadcast(spark.createDataFrame(blocks, "team int, blocks int"))
    dealt = sent.join(blocks_of, "team").withColumn("block", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int"))

    def teamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = plan.value.team_of
            team = [own[c][h % len(own[c])] for c, h in zip(batch.column("cell").to_pylist(), batch.column("hash").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("vector"), batch.column("cell"), pa.array(team, pa.int32())], names=["rep", "vector", "cell", "team"])

    sides = asked.withColumn("hash", F.xxhash64("rep")).mapInArrow(teamed, "rep long, vector array<long>, cell int, team int")
    sides = sides.join(blocks_of, "team").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def solve(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        p = plan.value
        if ours.num_rows and theirs.num_rows:
            q, x, reps_, ids = whole(ours["vector"]), whole(theirs["vector"]), ours["rep"].to_numpy(), theirs["ids"].to_pylist()
            first = np.array([i[0] for i in ids])
            cell = np.searchsorted(p.cells, ours["cell"].to_numpy())
            sphere = on_sphere(x, p.longest)
            for c in np.unique(cell):
                near_ = np.flatnonzero(p.needed(sphere, np.array([c]))[:, 0])
                mine = np.flatnonzero(cell == c)
                some = [ids[t] for t in near_.tolist()]
                for a in range(0, len(mine) if len(near_) else 0, 256):
                    part = mine[a : a + 256]
                    for rep, score in zip(reps_[part].tolist(), products(q[part], x[near_])):
                        out += [(rep, i, v) for v, i in best(score, first[near_], some, s.k + 1)]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({"rep": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.int64())})

    found = sides.select("team", "block", "rep", "vector", "cell").groupBy("team", "block").cogroup(dealt.select("team", "block", "vector", "ids").groupBy("team", "block")).applyInArrow(solve, "rep long, vec_id long, score long")
    of_rep = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("r", F.row_number().over(of_rep)).where(F.col("r") <= s.k + 1).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top"))
    each = queries.join(reps, "vector").select("id", "rep").join(top, "rep")
    others = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("id")), 1, s.k)
    return each.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
