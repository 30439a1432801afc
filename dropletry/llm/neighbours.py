"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph, which recursive spectral bisection cuts into
partitions of equal size; swaps across each cut then raise the edges inside.  A small network learns,
from a vector, in which partitions its neighbours lie.  It indexes every row under its most probable
partition, and sends each query to the most probable partitions, whose rows are all reranked by the
exact inner product.  Where the table needs more partitions than one network tells apart, each is cut
again in the same way, by a network fitted on a sample of its own; all of these are fitted in tasks.

How many partitions a query looks into depends on how sure the networks are: few where vectors lie in
clusters, most where they have no structure, as recall would be lost otherwise.

Equal vectors are one candidate with its smallest ids, so many as a result can hold; that loses
nothing, as of equal vectors smaller ids come first.  Partitions are dealt out in blocks, so that no
task holds a whole one; queries meet blocks, never each other.

Defined results: rows whose id or vector is null, or whose vector is zero or has null or non-finite
components or not the most frequent length take no part; of rows that share id and vector one
counts; scores that are equal stand in the order of their ids, however many they are; vectors of any
length are taken whole; extra columns are ignored; without candidates a query has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dropletry.llm.tables import checkpointed


@dataclass(frozen=True)
class Settings:
    """k: neighbours; sample: vectors that a network and its partitions are fitted on; rows: wanted in a
    partition; fewest: partitions, unless they would have under eight vectors; most: that one network
    tells apart; edges: of a vector in the graph; hidden, epochs, rate: of the network; mass: of
    probability that the probed partitions of a query hold; least: share of partitions probed at
    least; block: candidates and queries in a block."""

    k: int = 20
    sample: int = 8192
    rows: int = 2048
    fewest: int = 8
    most: int = 128
    edges: int = 16
    hidden: int = 96
    epochs: int = 60
    rate: float = 0.01
    mass: float = 0.985
    least: float = 0.12
    block: int = 4096


def neighbour_graph(x: np.ndarray, edges: int) -> np.ndarray:
    """The nearest other rows of each row by inner product: rows x edges."""
    out = []
    x = x.astype(np.float32)
    for a in range(0, len(x), 256):
        score = x[a : a + 256] @ x.T
        score[np.arange(len(score)), np.arange(a, a + len(score))] = -np.inf
        out.append(np.argpartition(-score, min(edges, len(x) - 1) - 1, axis=1)[:, :edges])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Partition numbers of equal frequency (within one) that keep neighbours together."""
    part = np.zeros(len(graph), np.int64)
    a, b = np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()
    u, v = np.concatenate([a, b]), np.concatenate([b, a])
    for level in range(parts.bit_length() - 1):
        inside = part[u] == part[v]
        p, q = u[inside], v[inside]
        degree = np.maximum(np.bincount(p, minlength=len(graph)), 1)
        members = np.bincount(part)
        f = np.random.default_rng(level).standard_normal(len(graph))
        for _ in range(40):  # power steps towards the slowest mode of the walk within each part
            f = f - (np.bincount(part, f * degree) / np.bincount(part, degree))[part]
            f = (f + np.bincount(p, f[q], len(graph)) / degree) / 2
            f /= np.sqrt(np.bincount(part, f * f) / members)[part] + 1e-300
        order = np.lexsort((f, part))
        rank = np.empty(len(graph), np.int64)
        rank[order] = np.arange(len(graph)) - np.repeat(np.cumsum(members) - members, members)
        side = (rank >= (members[part] + 1) // 2).astype(np.int64)
        for _ in range(6):  # swap as many from either side as gain by it
            gain = np.bincount(p, np.where(side[p] != side[q], 1, -1), len(graph))
            order = np.lexsort((-gain, part * 2 + side))
            group = (part * 2 + side)[order]
            place = np.arange(len(graph)) - np.searchsorted(group, group)
            eager = np.bincount(part * 2 + side, gain > 0, 2 * (1 << level)).reshape(-1, 2).min(axis=1) // 2
            moved = order[place < eager[group // 2].astype(np.int64)]
            if not len(moved):
                break
            side[moved] ^= 1
        part = part * 2 + side
    return part


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer; its outputs are log probabilities of partitions."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(x / np.linalg.norm(x, axis=1, keepdims=True) @ self.w1 + self.b1, 0)
        z = h @ self.w2 + self.b2
        return z - np.logaddexp.reduce(z, axis=1, keepdims=True)


def fit(x: np.ndarray, parts: int, s: Settings) -> Router:
    """The router of a sample of vectors."""
    rng = np.random.default_rng(0)
    sizes = [(x.shape[1], s.hidden), (s.hidden,), (s.hidden, parts), (parts,)]
    w = [rng.standard_normal(z) * (2 / z[0]) ** 0.5 if len(z) == 2 else np.zeros(z) for z in sizes]
    if parts == 1:
        return Router(w[0], w[1], np.zeros(sizes[2]), w[3])
    graph = neighbour_graph(x, min(s.edges, len(x) - 1))
    part = balanced_parts(graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x))[:, None], part[graph]), 1.0 / graph.shape[1])
    target[np.arange(len(x)), part] += 0.5
    target /= target.sum(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    m, v = [np.zeros(z) for z in sizes], [np.zeros(z) for z in sizes]
    step = 0
    for _ in range(s.epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            xb, tb = x[order[a : a + 256]], target[order[a : a + 256]]
            h = np.maximum(xb @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - tb) / len(xb)
            dh = (d @ w[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((xb.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                w[i] -= s.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*w)


@dataclass(frozen=True)
class Routers:
    """The first network and, by its partitions, the second ones; partitions are numbered through."""

    first: Router
    second: dict[int, Router]
    parts: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        log_p = self.first(x)
        if not self.second:
            return log_p
        out = np.full((len(x), log_p.shape[1], self.parts), -np.inf)
        for p in range(log_p.shape[1]):
            below = self.second[p](x) if p in self.second else np.zeros((len(x), 1))
            out[:, p, : below.shape[1]] = log_p[:, [p]] + below
        return out.reshape(len(x), -1)

    def part(self, x: np.ndarray) -> np.ndarray:
        """The partition that holds each vector: the most probable one, network by network."""
        out = self.first(x).argmax(axis=1)
        if self.second:
            below = np.zeros(len(x), np.int64)
            for p in np.unique(out).tolist():
                at = np.flatnonzero(out == p)
                below[at] = self.second[p](x[at]).argmax(axis=1) if p in self.second else 0
            out = out * self.parts + below
        return out


def probes(log_p: np.ndarray, s: Settings) -> list[np.ndarray]:
    """The partitions each query looks into: the most probable ones, up to the mass."""
    order = np.argsort(-log_p, axis=1, kind="stable")
    mass = np.cumsum(np.exp(np.take_along_axis(log_p, order, axis=1)), axis=1)
    n = np.maximum((mass < s.mass).sum(axis=1) + 1, int(np.ceil(s.least * log_p.shape[1])))
    return [o[:k] for o, k in zip(order, n.tolist())]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("vector")).where("id is not null and vector is not null")
    rows = rows.where(finite & F.exists("vector", lambda c: c != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["size"] if sizes else 0))


def fitted(drawn: DataFrame, parts: int, s: Settings) -> dict[int, Router]:
    """The network of each part's sample, fitted in a task; drawn: part, vector."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        r = fit(matrix(rows["vector"]), min(parts, power_below(rows.num_rows // 8)), s)
        flat = [np.ascontiguousarray(w, np.float64).tobytes() for w in (r.w1, r.b1, r.w2, r.b2)]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), **{n: pa.array([w], pa.binary()) for n, w in zip(("w1", "b1", "w2", "b2"), flat)}})

    def router(r: dict) -> Router:
        w1, b1, w2, b2 = (np.frombuffer(r[n]) for n in ("w1", "b1", "w2", "b2"))
        return Router(w1.reshape(-1, s.hidden), b1, w2.reshape(s.hidden, -1), b2)

    found = drawn.groupBy("part").applyInArrow(run, "part int, w1 binary, b1 binary, w2 binary, b2 binary").toArrow().to_pylist()
    return {r["part"]: router(r) for r in found}


def power_below(n: int) -> int:
    """The largest power of two up to n, at least 1."""
    return 1 << max(0, n.bit_length() - 1)


def index(distinct: DataFrame, s: Settings) -> Routers | None:
    """The networks of a table of distinct vectors."""
    total = distinct.count()
    if not total:
        return None
    wanted = max(power_below(total // s.rows), min(s.fewest, power_below(total // 8)))
    hashed = F.xxhash64("vector")
    drawn = distinct.orderBy(hashed, "vector").limit(s.sample).select(F.lit(0).alias("part"), "vector")
    first = fitted(drawn, min(s.most, wanted), s)[0]
    parts = min(s.most, wanted // s.most)
    if parts < 2:
        return Routers(first, {}, 1)
    top = distinct.sparkSession.sparkContext.broadcast(first)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(top.value(matrix(batch.column("vector"))).argmax(axis=1), pa.int32()), batch.column("vector")], names=["part", "vector"])

    kind = dict(distinct.dtypes)["vector"]
    placed = checkpointed(distinct.select("vector").mapInArrow(place, f"part int, vector {kind}"))
    # By hash, about ``sample`` vectors of each part; a row for each part comes to the driver.
    shares = [(r["part"], min(1.0, s.sample / r["count"])) for r in placed.groupBy("part").count().collect()]
    share = F.broadcast(distinct.sparkSession.createDataFrame(shares, "part int, share double"))
    own = placed.join(share, "part").where(F.pmod(hashed, F.lit(1 << 20)) < F.col("share") * (1 << 20))
    return Routers(first, fitted(own.select("part", "vector"), parts, s), parts)


def search(vectors: DataFrame, is_query: Column, settings: Settings | None = None, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest of each query by inner product, from rank 1.

    ``is_query`` may refer to ``id``.
    """
    s = settings or Settings()
    spark = vectors.sparkSession
    rows = checkpointed(usable(vectors, key, embedding))
    # Of equal vectors the smallest ids alone can be in a result; one more, as a query passes over itself.
    of_vector = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("id")
    kept = rows.dropDuplicates(["id", "vector"]).withColumn("n", F.row_number().over(of_vector)).where(F.col("n") <= s.k + 1)
    distinct = checkpointed(kept.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    routers = index(distinct, s)
    if routers is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(routers)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best = shared.value.part(matrix(batch.column("vector")))
                yield pa.RecordBatch.from_arrays([batch.column("vector"), batch.column("ids"), pa.array(best, pa.int32())], names=["vector", "ids", "part"])

    kind = dict(rows.dtypes)["vector"]
    placed = checkpointed(distinct.select("vector", "ids").mapInArrow(place, f"vector {kind}, ids array<long>, part int"))
    # A row for each partition, whose number the settings bound.
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    blocks = {p: -(-n // s.block) for p, n in sizes.items()}
    count_of = spark.createDataFrame(list(blocks.items()), "part int, blocks int")
    query_rows = rows.dropDuplicates(["id", "vector"]).where(is_query)
    teams = max(1, -(-query_rows.count() // (4 * s.block)))  # queries that meet a block at a time
    numbered = placed.join(F.broadcast(count_of), "part").withColumn("block", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int"))
    candidates = numbered.select("vector", "ids", "part", "block", F.explode(F.sequence(F.lit(0), F.lit(teams - 1))).alias("team"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids, wanted = part.column("id").to_pylist(), probes(shared.value(matrix(part.column("vector"))), s)
                at = [(i, p, b) for i, ps in enumerate(wanted) for p in ps.tolist() for b in range(blocks.get(p, 0))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i, _, _ in at], pa.int64()), part.column("vector").take(pa.array([i for i, _, _ in at], pa.int64())), pa.array([p for _, p, _ in at], pa.int32()), pa.array([b for _, _, b in at], pa.int32())],
                    names=["id", "vector", "part", "block"],
                )

    asked = query_rows.mapInArrow(route, f"id long, vector {kind}, part int, block int").withColumn("team", F.pmod(F.xxhash64("id"), F.lit(teams)).cast("int"))

    def rerank(queries: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if queries.num_rows and found.num_rows:
            c, ids = matrix(found["vector"]), found["ids"].to_pylist()
            longest = np.sqrt((c * c).sum(axis=1).max())
            for a in range(0, queries.num_rows, 256):
                part = queries.slice(a, 256)
                q = matrix(part["vector"])
                rough = q @ c.T
                # All that may be among the k best by the exact score: ties and rounding included.
                last = max(0, len(c) - s.k - 1)
                least = np.partition(rough, last, axis=1)[:, last] - 1e-12 * longest * np.sqrt((q * q).sum(axis=1)) * q.shape[1]
                for i, own in enumerate(part["id"].to_pylist()):
                    top = np.flatnonzero(rough[i] >= least[i])
                    # Summed in one fixed order, so that a score does not depend on the block it is found in.
                    exact = (q[i] * c[top]).sum(axis=1)
                    best = sorted((-e, j) for t, e in zip(top.tolist(), exact.tolist()) for j in ids[t] if j != own)[: s.k]
                    out += [(own, j, -e) for e, j in best]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    near = asked.groupBy("part", "block", "team").cogroup(candidates.groupBy("part", "block", "team")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
