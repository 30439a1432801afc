"""Vectors of integers: the rows that take part in a search, and exact inner products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, key: str, embedding: str, scale: float, *, label: Column | None = None) -> DataFrame:
    """(id, vector and, if asked, label): components times ``scale``, rounded down, as long integers.

    Rows take part whose id and vector (and label) are not null, whose components are some and all finite, and whose
    vector has the most frequent length (the smaller one, if two are as frequent).  Of rows that share an id
    the first by label and vector counts.
    """
    finite = F.forall("raw", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("raw"), *([] if label is None else [label.alias("label")]))
    rows = rows.where("id is not null and size(raw) > 0").where(finite)
    if label is not None:
        rows = rows.where("label is not null")
    sizes = rows.groupBy(F.size("raw").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    rows = rows.where(F.size("raw") == (sizes[0]["size"] if sizes else 0))
    kept = ["label", "vector"] if label is not None else ["vector"]
    whole = rows.withColumn("vector", F.transform("raw", lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("long")))
    return whole.groupBy("id").agg(F.min(F.struct(*kept)).alias("x")).select("id", *(f"x.{c}" for c in kept))


def whole(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix of 64-bit integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _longest(x: np.ndarray) -> float:
    return float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """The numbers in which no sum of products of rows of both loses a digit; beyond 64 bits it is an error."""
    bound = _longest(a) * _longest(b)
    if bound < 2.0**52:
        return np.float64
    if bound >= 2.0**62:
        raise OverflowError("inner products leave 64 bits")
    return np.int64


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of every row of one matrix with every row of the other, exactly."""
    kind = _kind(a, b)
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def paired_products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, step: int = 65536) -> np.ndarray:
    """The inner products of the rows i of one matrix with the rows j of the other, exactly."""
    out = np.zeros(len(i), np.int64)
    kind = _kind(a, b)
    a, b = a.astype(kind), b.astype(kind)
    for k in range(0, len(i), step):
        out[k : k + step] = np.einsum("ij,ij->i", a[i[k : k + step]], b[j[k : k + step]])
    return out


def sample(rows: DataFrame, most: int) -> np.ndarray:
    """Vectors of so many rows at most, the same for the same rows: first by hash."""
    return whole(rows.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(most).toArrow()["vector"])


def centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """At most n cluster centres of the rows of a matrix."""
    x = x.astype(np.float64)
    found = np.unique(x, axis=0)
    found = found[np.random.default_rng(0).permutation(len(found))[:n]]
    if len(found) < n or len(x) <= n:
        return found
    for _ in range(rounds):
        own = np.concatenate([nearest(x[a : a + 1024], found) for a in range(0, len(x), 1024)])
        size = np.bincount(own, minlength=n)
        sums = np.stack([np.bincount(own, x[:, j], n) for j in range(x.shape[1])], axis=1)
        found = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], found)
    return found


def nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The nearest row of ``to`` for each row of ``x``."""
    return ((to * to).sum(axis=1) - 2 * (x @ to.T)).argmin(axis=1)
