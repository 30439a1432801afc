"""Packing documents into training sequences by order-preserving dynamic programming.

Documents stay in the order of their ids.  Their tokens form one line, on which the end of each
document, of each sentence and, in sentences that are very long, of short stretches are possible
cuts.  The cuts taken are those of least total cost: the padding of every sequence plus a penalty
for a cut inside a document (less at a sentence's end).  With P(j) the tokens before cut j,

    cost(j) = penalty(j) + min over i of cost(i) + padding(P(j) - P(i)),   P(j) - P(i) <= size

and as padding is size minus length, the minimum is of cost(i) + P(i) over a sliding window, which
a monotone queue gives at constant cost; lengths that need no padding are tried beside it.

The line is cut into ranges of ids that different tasks pack, and within a task into blocks, so that
no task holds more than a block.  Defined results: a null or empty text is its end token alone; rows
with a null id come first; rows with equal ids keep no particular order among them; each id lies in
exactly one piece; of cuts of equal cost those that make longer windows are taken; very long texts are
cut like others; extra columns are ignored, whatever their names; an empty table has no pieces.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dropletry.llm import bpe
from dropletry.llm.tables import release


@dataclass(frozen=True)
class Settings:
    """size: of a sequence; end: id after each document; sentence, hard: penalties in tokens for a cut
    at a sentence's end and elsewhere in a document; stretch: tokens between hard cuts in a sentence
    that is longer than ``long``; unpadded: shorter lengths that stay as they are; block: tokens
    packed at a time; range_bytes: text of a task's range, unless there were more than ``ranges`` then."""

    size: int = 4096
    end: int = 2
    sentence: int = 4
    hard: int = 48
    long: int = 192
    stretch: int = 64
    unpadded: tuple[int, ...] = (512, 1024, 2048)
    block: int = 1_000_000
    range_bytes: int = 16_000_000
    ranges: int = 20_000


def candidates(lengths: np.ndarray, ends_sentence: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Positions of possible cuts on a line of documents, and the penalty of each.

    lengths: tokens of each document; ends_sentence: for each token of the line.
    """
    doc_ends = np.cumsum(lengths)
    penalty = np.full(int(doc_ends[-1]) + 1, -1, np.int32)
    penalty[np.flatnonzero(ends_sentence) + 1] = s.sentence
    penalty[doc_ends] = 0
    at = np.concatenate([[0], np.flatnonzero(penalty >= 0)])
    wide = np.flatnonzero(np.diff(at) > s.long)
    for a, b in zip(at[wide].tolist(), at[wide + 1].tolist()):
        penalty[a + s.stretch : b : s.stretch] = s.hard
    penalty[0] = -1
    cuts = np.flatnonzero(penalty >= 0)
    return cuts, penalty[cuts]


def best_cuts(cuts: np.ndarray, penalties: np.ndarray, s: Settings) -> np.ndarray:
    """The cuts of least cost, the line's end included; of equal costs the longest windows win."""
    n = len(cuts)
    at = np.concatenate([[0], cuts])
    exact: dict[int, list[int]] = {}
    for length in s.unpadded:
        i = np.searchsorted(at, cuts - length)
        hit = np.flatnonzero((cuts >= length) & (at[np.minimum(i, n)] == cuts - length))
        for j, k in zip((hit + 1).tolist(), i[hit].tolist()):
            exact.setdefault(j, []).append(k)
    place, fee = at.tolist(), [0, *penalties.tolist()]
    cost, back = [0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost(i) + P(i), i), rising
    size, pop, append, popleft = s.size, queue.pop, queue.append, queue.popleft
    for j in range(1, n + 1):
        p = place[j]
        while place[queue[0][1]] < p - size:
            popleft()
        value, i = queue[0]
        value += size - p
        if j in exact:
            for k in exact[j]:
                if cost[k] < value:
                    value, i = cost[k], k
        value += fee[j]
        cost[j], back[j] = value, i
        value += p
        while queue and queue[-1][0] > value:
            pop()
        append((value, j))
    taken = []
    j = n
    while j:
        taken.append(place[j])
        j = back[j]
    return np.array(taken[::-1], np.int64)


def pieces(lengths: np.ndarray, cuts: np.ndarray) -> dict[str, np.ndarray]:
    """The pieces that windows ending at ``cuts`` make of documents on a line."""
    doc_ends = np.cumsum(lengths)
    ends = np.unique(np.concatenate([doc_ends, cuts]))
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.searchsorted(doc_ends, starts, side="right")
    window = np.searchsorted(cuts, starts, side="right")
    first = np.concatenate([[0], cuts])
    return {"doc": doc, "at": starts, "start": starts - (doc_ends - lengths)[doc], "length": ends - starts, "window": window, "offset": starts - first[window]}


def _ends_sentence(codec: bpe.Codec, end: int) -> np.ndarray:
    """Whether each token closes a sentence."""
    closing = re.compile(r"[.!?]+[)\"']*</w>")
    table = np.array([bool(closing.fullmatch(t)) for t in codec.text])
    table[end] = False
    return table


def pack(df: DataFrame, path: str, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id and offset in that sequence."""
    s = settings or Settings()
    rows = df.select(key, text)
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = max(1, min(s.ranges, -(-int(total) // s.range_bytes)))
    # By what rows hold alone, so that a task that runs again deals them out alike; wholly equal rows stay together.
    ordered = rows.repartitionByRange(ranges, key, F.xxhash64(text)).sortWithinPartitions(key, F.xxhash64(text))
    kind = to_arrow_type(rows.schema[key].dataType)
    names = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def packed(keys: list, ids: list[np.ndarray], closes: np.ndarray, sequence: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.array([len(i) for i in ids])
        flat = np.concatenate(ids)
        cuts = best_cuts(*candidates(lengths, closes[flat], s), s)
        p = pieces(lengths, cuts)
        raw = flat.astype("<u4").tobytes()
        spans = [raw[4 * a : 4 * (a + n)] for a, n in zip(p["at"].tolist(), p["length"].tolist())]
        arrays = [
            pa.array([keys[d] for d in p["doc"].tolist()], kind), pa.array(p["start"], pa.int64()), pa.array(p["length"], pa.int64()), pa.array(spans, pa.binary()),
            pa.array(lengths[p["doc"]], pa.int64()), pa.array(p["window"] + sequence, pa.int64()), pa.array(p["offset"], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=names), sequence + len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(path)
        closes = _ends_sentence(codec, s.end)
        sequence = TaskContext.get().partitionId() << 40
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0
        last = np.array([s.end], np.int32)
        for batch in batches:
            texts = (t for a in range(0, batch.num_rows, 256) for t in batch.column(text).slice(a, 256).to_pylist())
            for k, i in zip(batch.column(key).to_pylist(), codec.encode_each(texts)):
                keys.append(k)
                ids.append(np.concatenate([i, last]))
                held += len(ids[-1])
                if held >= s.block:
                    out, sequence = packed(keys, ids, closes, sequence)
                    keys, ids, held = [], [], 0
                    yield out
                    del out
                    release()
        if ids:
            yield packed(keys, ids, closes, sequence)[0]
        del keys, ids
        release()

    return ordered.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
