"""Hard negatives by product quantisation: rows of another label whose score lies in a window below a positive's.

Every vector is cut into short pieces, and each piece is stored as the nearest of 256 centres and the length of
what is left, its residual norm.  An anchor's score with a row is then a sum of looked-up products of its pieces
with the centres, and the true score lies no further from that sum than the anchor's piece lengths times the
residual norms.  So a row has a lower and an upper bound, and only rows that may be among the wanted ones are
scored on their whole vectors, in integers: those whose upper bound reaches the lower bound that enough certain
rows have.  Centres come from a bounded sample; any choice of them gives exact results, and decides only how
many rows are scored.

Two passes of the same kind: the first finds each anchor's positives, the second the rows of each positive's
window.  Anchors are dealt out in teams and rows in blocks by hash, whatever their label; a task holds one of
each and gives no more rows for an anchor (and positive) than the result can hold.

Defined results: rows that take part are those of ``whole_vectors.usable``; scores that are equal stand in the
order of their ids; an anchor without another row of its label has no rows, and neither has a window without
rows, as any of a negative positive score is; extra columns are ignored; inner products beyond 64 bits are an
error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dropletry.llm.tables import checkpointed
from dropletry.llm.whole_vectors import centres, nearest, paired_products, sample, usable, whole


@dataclass(frozen=True)
class Settings:
    """positives: of an anchor; negatives: of a positive; low, high: the window in hundredths of the positive's
    score; sample: vectors that centres are taken from; piece: components in a piece; team, block: anchors and
    rows that meet in a task, about."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    sample: int = 2048
    piece: int = 2
    team: int = 2048
    block: int = 8192


@dataclass(frozen=True)
class Codebook:
    """The centres of each piece; the last piece may be shorter."""

    centres: list[np.ndarray]
    piece: int

    def pieces(self, x: np.ndarray) -> list[np.ndarray]:
        x = x.astype(np.float64)
        return [x[:, a : a + self.piece] for a in range(0, x.shape[1], self.piece)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and residual norms (rounded up) of each piece: two matrices of rows x pieces."""
        codes, norms = [], []
        for part, c in zip(self.pieces(x), self.centres):
            code = np.concatenate([nearest(part[a : a + 4096], c) for a in range(0, len(part), 4096)])
            codes.append(code.astype(np.uint8))
            norms.append(np.sqrt(((part - c[code]) ** 2).sum(axis=1)))
        norm = np.stack(norms, axis=1).astype(np.float32)
        return np.stack(codes, axis=1), np.nextafter(norm, np.float32(np.inf))

    def bounds(self, anchors: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of anchors with coded rows."""
        near = np.zeros((len(anchors), len(codes)))
        lengths = []
        for m, (part, c) in enumerate(zip(self.pieces(anchors), self.centres)):
            near += (part @ c.T)[:, codes[:, m]]  # looked up in the table of the anchor's piece
            lengths.append(np.sqrt((part * part).sum(axis=1)))
        far = np.stack(lengths, axis=1) @ norms.astype(np.float64).T
        far += 1e-6 + 1e-12 * (np.abs(near) + far)  # rounding
        return near - far, near + far


def fitted(x: np.ndarray, piece: int) -> Codebook:
    parts = [x[:, a : a + piece] for a in range(0, x.shape[1], piece)]
    return Codebook([centres(part, 256) for part in parts], piece)


def reached(low: np.ndarray, may: np.ndarray, n: int) -> np.ndarray:
    """For each anchor the lower bound that n rows have for certain, or none at all; ``may``: rows that count."""
    if low.shape[1] < n:
        return np.full(len(low), -np.inf)
    return np.partition(np.where(may, low, -np.inf), low.shape[1] - n, axis=1)[:, low.shape[1] - n]


def first_by_score(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The places of the n largest scores of each group, ties to the smaller id."""
    order = np.lexsort((ids, -score, group))
    begins = np.searchsorted(group[order], group[order])
    return order[np.arange(len(order)) - begins < n]


def windows(positive: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest whole score in the window of each positive score."""
    return -(-(positive * s.low) // 100), (positive * s.high) // 100


def positives_in(book: Codebook, s: Settings) -> Callable[[dict, dict], list[tuple]]:
    """(anchor, positive, score) among the rows of a block."""

    def run(a: dict, x: dict) -> list[tuple]:
        out = []
        for label in np.intersect1d(a["label"], x["label"]):
            rows = np.flatnonzero(x["label"] == label)
            ours = np.flatnonzero(a["label"] == label)
            for k in range(0, len(ours), 128):
                part = ours[k : k + 128]
                low, high = book.bounds(a["vector"][part], x["codes"][rows], x["norms"][rows])
                other = a["id"][part][:, None] != x["id"][rows]
                i, j = np.nonzero(other & (high >= reached(low, other, s.positives)[:, None]))
                score = paired_products(a["vector"], part[i], x["vector"], rows[j])
                best = first_by_score(i, score, x["id"][rows[j]], s.positives)
                out += zip(a["id"][part[i[best]]].tolist(), x["id"][rows[j[best]]].tolist(), score[best].tolist())
        return out

    return run


def negatives_in(book: Codebook, s: Settings) -> Callable[[dict, dict], list[tuple]]:
    """(anchor, positive, negative, positive's score, score) among the rows of a block."""

    def run(a: dict, x: dict) -> list[tuple]:
        out = []
        for k in range(0, len(a["id"]), 128):
            part = np.arange(k, min(k + 128, len(a["id"])))
            low, high = book.bounds(a["vector"][part], x["codes"], x["norms"])
            other = a["label"][part][:, None] != x["label"]
            given = [a["positives"][p] for p in part.tolist()]
            for turn in range(max(map(len, given))):
                here = np.array([p for p, g in enumerate(given) if turn < len(g)])
                wanted = np.array([given[p][turn]["score"] for p in here.tolist()], np.int64)
                least, most = windows(wanted, s)
                lo, hi, may = low[here], high[here], other[here]
                inside = may & (lo >= least[:, None]) & (hi <= most[:, None])
                maybe = may & (hi >= np.maximum(least, reached(lo, inside, s.negatives))[:, None]) & (lo <= most[:, None])
                i, j = np.nonzero(maybe)
                score = paired_products(a["vector"], part[here[i]], x["vector"], j)
                fits = (score >= least[i]) & (score <= most[i])
                i, j, score = i[fits], j[fits], score[fits]
                best = first_by_score(i, score, x["id"][j], s.negatives)
                for p, r, v in zip(i[best].tolist(), j[best].tolist(), score[best].tolist()):
                    out.append((int(a["id"][part[here[p]]]), given[here[p]][turn]["id"], int(x["id"][r]), int(wanted[p]), v))
        return out

    return run


def _met(anchors: DataFrame, coded: DataFrame, count: int, rows: int, s: Settings, find: Callable[[dict, dict], list[tuple]], names: list[str]) -> DataFrame:
    """What ``find`` makes of every team of anchors with every block of rows."""
    teams, blocks = max(1, -(-count // s.team)), max(1, -(-rows // s.block))
    a = anchors.withColumns({"team": F.pmod(F.xxhash64("id"), F.lit(teams)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    x = coded.withColumns({"block": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"), "team": F.explode(F.sequence(F.lit(0), F.lit(teams - 1)))})

    def numbers(t: pa.Table) -> dict:
        out = {"id": t["id"].to_numpy(), "label": t["label"].to_numpy(), "vector": whole(t["vector"])}
        if "positives" in t.schema.names:
            out["positives"] = t["positives"].to_pylist()
        if "codes" in t.schema.names:
            out["codes"] = np.stack([np.frombuffer(c, np.uint8) for c in t["codes"].to_pylist()])
            out["norms"] = np.stack([np.frombuffer(c, np.float32) for c in t["norms"].to_pylist()])
        return out

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        found = find(numbers(ours), numbers(theirs)) if ours.num_rows and theirs.num_rows else []
        columns = list(zip(*found)) or [[] for _ in names]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    return a.groupBy("team", "block").cogroup(x.groupBy("team", "block")).applyInArrow(run, ", ".join(f"{n} long" for n in names))


def mine(vectors: DataFrame, is_anchor: Column, label: Column, settings: Settings | None = None, *, key: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label`` is any whole-number column of ``vectors``; ``is_anchor`` may refer to ``id``.
    """
    s = settings or Settings()
    spark = vectors.sparkSession
    rows = checkpointed(usable(vectors, key, embedding, scale, label=label.cast("long")))
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    total, count = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    if not count:
        return empty
    book = spark.sparkContext.broadcast(fitted(sample(rows, s.sample), s.piece))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, norms = book.value.encode(whole(batch.column("vector")))
                more = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (codes, norms)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "codes", "norms"])

    coded = checkpointed(rows.select("id", "label", "vector").mapInArrow(encode, "id long, label long, vector array<long>, codes binary, norms binary"))
    anchors = coded.where(is_anchor).select("id", "label", "vector")
    near = _met(anchors, coded, count, total, s, lambda a, x: positives_in(book.value, s)(a, x), ["anchor_id", "positive_id", "score"])
    of_anchor = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    near = near.withColumn("r", F.row_number().over(of_anchor)).where(F.col("r") <= s.positives)
    given = near.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), "score")).alias("positives"))
    asked = checkpointed(anchors.join(given.withColumnRenamed("anchor_id", "id"), "id").select("id", "label", "vector", "positives"))
    names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
    hard = _met(asked, coded, count, total, s, lambda a, x: negatives_in(book.value, s)(a, x), names)
    of_pair = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(of_pair)).where(F.col("rank") <= s.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
