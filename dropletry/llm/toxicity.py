"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its UTF-8 bytes (A-Z lower-cased, framed by spaces),
hashed into buckets.  Each bucket's log ratio of smoothed document counts under the two labels
scales its presence; a logistic regression over the scaled features gives the score.

Fitting uses a bounded sample of labelled rows per class (``Settings.per_class``, the smallest by a
hash of the id), weighted back to the classes' true sizes; scoring covers every whole text.  Tasks
count the sample's features, then list each sampled text's few buckets that tell the labels apart; the
gradient steps see only those lists.

Defined results: a null or empty text is scored as one without features; labels that are null or
not 0 or 1 are ignored; without rows of both labels every score is the share of label 1 (0.0 if
there is none); of rows that share an id all are sampled, if it is, up to ``per_class`` rows of a label; equal texts get equal scores; ties
of the sample's hash go to smaller ids; very long texts are read whole; an empty table has no rows;
other columns are kept, and one that has the score's name is replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropletry.llm.tables import checkpointed, release


@dataclass(frozen=True)
class Settings:
    """What is fixed before fitting.

    grams: lengths of n-grams in bytes; bits: of the bucket number; per_class: labelled rows of each
    class at most; smoothing: added to counts; certain: standard errors by which a bucket's log ratio
    must differ from 0 to be a feature; decay: of the weights per step; epochs, batch, rate: of the
    gradient steps.
    """

    grams: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    per_class: int = 4000
    smoothing: float = 1.0
    certain: float = 3.0
    decay: float = 1e-5
    epochs: int = 5
    batch: int = 64
    rate: float = 0.05


@dataclass(frozen=True)
class Model:
    settings: Settings
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        hashed = Hasher(self.settings)
        z = np.array([self.weights[hashed(t)].sum(dtype=np.float64) for t in texts]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Hasher:
    """The distinct buckets of a text's n-grams."""

    def __init__(self, settings: Settings):
        self.grams, self.shift = settings.grams, np.uint32(32 - settings.bits)
        self.last = np.zeros(1 << settings.bits, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer(f" {text} ".encode() if text else b"", np.uint8)
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint32)
        found = []
        h = raw
        for n in range(2, max(self.grams) + 1):
            if len(raw) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) + (raw[n - 1 :] + np.uint32(1)) * np.uint32(0x85EBCA6B)
            if n in self.grams:
                found.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> self.shift)
        if not found:
            return np.empty(0, np.int64)
        buckets = np.concatenate(found).astype(np.int64)
        # The last to write in a bucket stands for all that share it: no sort is needed.
        order = np.arange(len(buckets), dtype=np.int32)
        self.last[buckets] = order
        return buckets[self.last[buckets] == order]


def ratios(seen: np.ndarray, docs: np.ndarray, settings: Settings) -> np.ndarray:
    """The log ratio of each bucket from the texts that have it, 0 where it may be chance; seen, docs: by label."""
    seen = seen + settings.smoothing
    ratio = np.log(seen[1] / (docs[1] + 2 * settings.smoothing)) - np.log(seen[0] / (docs[0] + 2 * settings.smoothing))
    return np.where(np.abs(ratio) >= settings.certain * np.sqrt((1 / seen).sum(axis=0)), ratio, 0.0).astype(np.float32)


def prior(labels: np.ndarray, row_weights: np.ndarray, settings: Settings) -> Model | None:
    """The model of labels that are all alike or absent."""
    total = row_weights.sum()
    share = float(row_weights @ labels / total) if total else 0.0
    if 0 < share < 1:
        return None
    return Model(settings, np.zeros(1 << settings.bits, np.float32), float(np.log(share + 1e-300) - np.log(1 - share + 1e-300)) if total else -500.0)


def fit(texts: list[str | None], labels: np.ndarray, row_weights: np.ndarray, settings: Settings) -> Model:
    """The model of labelled texts; ``row_weights``: how many rows each stands for."""
    plain = prior(labels, row_weights, settings)
    if plain is not None:
        return plain
    hashed = Hasher(settings)
    seen = np.zeros((2, 1 << settings.bits))
    for t, label in zip(texts, labels):
        seen[int(label), hashed(t)] += 1
    ratio = ratios(seen, np.array([(labels == v).sum() for v in (0, 1)]), settings)
    return descend([b[ratio[b] != 0].astype(np.int32) for b in map(hashed, texts)], ratio, labels, row_weights, settings)


def descend(rows: list[np.ndarray], ratio: np.ndarray, labels: np.ndarray, row_weights: np.ndarray, settings: Settings) -> Model:
    """Gradient steps over rows of buckets."""
    lengths = np.array([len(r) for r in rows])
    ends = np.cumsum(lengths)
    flat = np.concatenate(rows)
    share = float(row_weights @ labels / row_weights.sum())
    w, squares = np.zeros(len(ratio), np.float32), np.full(len(ratio), 1e-6, np.float32)
    bias = float(np.log(share / (1 - share)))
    order_of = np.random.default_rng(0)
    for _ in range(settings.epochs):
        order = order_of.permutation(len(rows))
        for start in range(0, len(order), settings.batch):
            part = order[start : start + settings.batch]
            idx = np.concatenate([flat[ends[i] - lengths[i] : ends[i]] for i in part])
            of = np.repeat(np.arange(len(part)), lengths[part])
            x = ratio[idx]
            z = np.bincount(of, w[idx] * x, len(part)) + bias
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels[part]) * row_weights[part] / row_weights[part].sum()
            touched, back = np.unique(idx, return_inverse=True)
            g = np.bincount(back, err[of] * x).astype(np.float32) + np.float32(settings.decay) * w[touched]
            squares[touched] += g * g
            w[touched] -= settings.rate * g / np.sqrt(squares[touched])
            bias -= settings.rate * float(err.sum())
    return Model(settings, w * ratio, bias)


def sample(labelled: DataFrame, settings: Settings, label: str = "toxic", key: str = "doc_id") -> DataFrame:
    """At most ``per_class`` rows of each label, with how many rows each stands for."""
    ok = labelled.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("label"))
    sizes = ok.groupBy("label").agg(F.count("*").alias("n"))
    parts = [ok.where(F.col("label") == v).orderBy(F.xxhash64(key), key).limit(settings.per_class) for v in (0, 1)]
    return parts[0].unionByName(parts[1]).join(F.broadcast(sizes), "label").withColumn("stands_for", F.col("n") / F.least("n", F.lit(settings.per_class)))


def train(docs: DataFrame, labelled: DataFrame, settings: Settings | None = None, text: str = "text", key: str = "doc_id") -> Model:
    """A model of the documents that ``labelled`` marks.

    The driver gets the counts of the buckets and the sampled rows' lists of telling ones, no texts.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    chosen = sample(labelled, settings, key=key)
    rows = checkpointed(docs.select(key, text).join(F.broadcast(chosen), key).select(F.col(text).alias("text"), "label", "stands_for"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if max(counts.values(), default=0) > settings.per_class:
        # Rows that share an id are all its label's; of too many the first by hash stand for the others too.
        parts = [rows.where(F.col("label") == v).orderBy(F.xxhash64("text"), "text").limit(settings.per_class).withColumn("stands_for", F.col("stands_for") * max(1.0, n / settings.per_class)) for v, n in sorted(counts.items())]
        rows = checkpointed(functools.reduce(DataFrame.unionByName, parts))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed, seen = Hasher(settings), np.zeros((2, 1 << settings.bits), np.int32)
        for batch in batches:
            for t, label in zip(batch["text"].tolist(), batch["label"].tolist()):
                seen[label, hashed(t)] += 1
        for label in (0, 1):
            bucket = np.flatnonzero(seen[label])
            yield pd.DataFrame({"label": np.full(len(bucket), label), "bucket": bucket, "n": seen[label, bucket]})
        release()

    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    counts = rows.select("text", "label").mapInPandas(count, "label int, bucket int, n long").groupBy("bucket").pivot("label", [0, 1]).agg(F.sum("n")).toArrow()
    seen = np.zeros((2, 1 << settings.bits))
    for label in (0, 1):
        seen[label, counts["bucket"].to_numpy()] = counts[str(label)].fill_null(0).to_numpy()
    ratio = ratios(seen, np.array([sizes.get(v, 0) for v in (0, 1)]), settings)
    shared = spark.sparkContext.broadcast(np.packbits(ratio != 0))

    def telling(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed, known = Hasher(settings), np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            found = [b[known[b]] for b in map(hashed, batch["text"].tolist())]
            yield pd.DataFrame({"label": batch["label"], "stands_for": batch["stands_for"], "buckets": [np.sort(b).astype(">i4").tobytes() for b in found]})
        release()

    got = rows.mapInPandas(telling, "label int, stands_for double, buckets binary").toArrow()
    lists = got["buckets"].to_pylist()
    order = sorted(range(len(lists)), key=lambda i: (got["label"][i].as_py(), lists[i]))  # equal rows do the same in any order
    labels, weights = (got[c].to_numpy()[order].astype(np.float64) for c in ("label", "stands_for"))
    buckets = [np.frombuffer(lists[i], ">i4").astype(np.int32) for i in order]
    del got, lists
    model = prior(labels, weights, settings) or descend(buckets, ratio, labels, weights, settings)
    del buckets
    release()  # the driver goes on to other work
    return model


def score(df: DataFrame, model: Model, text: str = "text", score_column: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 for each text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        out = pd.Series(shared.value.scores(texts.tolist()), index=texts.index)
        release()
        return out

    return df.withColumn(score_column, toxicity(F.col(text)))


def id_hash(key: Column | str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key) % modulus
