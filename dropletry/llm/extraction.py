"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

Each leaf block is main text or not.  The field scores a block by its own tag, its ancestors' tags
and names, its length, links and punctuation, and its place, and scores each change of label.  It is
trained by the gradient of the conditional likelihood on labelled pages; Viterbi decoding gives the
best labels of a page, and the blocks labelled main are joined in page order.

Defined results: a null or empty page, or one without main blocks, has an empty text; broken markup
is read as far as it goes, in time that grows in proportion to the page; white space of any kind inside
a block becomes one space; very long pages are taken whole; equal pages have equal texts; extra columns
are carried through, and those named like the result's are replaced; an empty table has no rows.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dropletry.llm.blocks import Block, blocks
from dropletry.llm.labelled_pages import labelled_page


@dataclass(frozen=True)
class Settings:
    """pages: labelled pages trained on; epochs, rate, decay: of the gradient steps."""

    pages: int = 700
    epochs: int = 6
    rate: float = 0.3
    decay: float = 1e-4


def features(page: list[Block]) -> list[list[str]]:
    """The features of each block of a page."""
    out = []
    for k, b in enumerate(page):
        n = len(b.text)
        f = ["bias", f"tag {b.tag}", f"length {min(8, int(math.log2(n + 1)))}", f"links {min(4, 5 * b.links // max(1, n))}"]
        f += [f"in {t}" for t in b.path]
        f += [f"named {x}" for x in b.names]
        f.append(f"stops {b.text[-1] in '.!?:'}")
        if "©" in b.text:
            f.append("copyright")
        f += ["first"] * (k == 0) + ["last"] * (k == len(page) - 1)
        out.append(f)
    return out


@dataclass(frozen=True)
class Field:
    """weights: for each feature, of label 1 against label 0; change: of label a followed by b."""

    weights: dict[str, float]
    change: np.ndarray

    @functools.cached_property
    def names(self) -> frozenset[str]:
        """The names of elements that have a weight."""
        return frozenset(x.removeprefix("named ") for x in self.weights if x.startswith("named "))

    def scores(self, page: list[Block]) -> list[float]:
        get = self.weights.get
        return [sum(get(x, 0.0) for x in f) for f in features(page)]

    def labels(self, page: list[Block]) -> list[int]:
        """Viterbi: the labels of greatest total score; of equal ones, 1 stays 1."""
        if not page:
            return []
        (aa, ab), (ba, bb) = self.change.tolist()
        back, (x, y) = [], (0.0, 0.0)
        for k, s in enumerate(self.scores(page)):
            if k:
                back.append((0 if x + aa > y + ba else 1, 0 if x + ab > y + bb else 1))
                x, y = max(x + aa, y + ba), max(x + ab, y + bb) + s
            else:
                y = s
        label = int(y >= x)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def _posteriors(scores: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of label 1 for each block, and the expected number of each change."""
    n = len(scores)
    own = np.stack([np.zeros(n), scores], axis=1)
    ahead, after = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = own[0]
    for k in range(1, n):
        ahead[k] = own[k] + np.logaddexp(ahead[k - 1, 0] + change[0], ahead[k - 1, 1] + change[1])
    for k in range(n - 2, -1, -1):
        step = own[k + 1] + after[k + 1]
        after[k] = np.logaddexp(change[:, 0] + step[0], change[:, 1] + step[1])
    total = np.logaddexp(*ahead[-1])
    pairs = np.zeros((2, 2))
    if n > 1:
        pairs = np.exp(ahead[:-1, :, None] + change[None] + (own + after)[1:, None, :] - total).sum(axis=0)
    return np.exp(ahead[:, 1] + after[:, 1] - total), pairs


def train(pages: list[tuple[list[Block], list[int]]], s: Settings) -> Field:
    """A field fitted to pages of labelled blocks."""
    index: dict[str, int] = {}
    rows = []
    for page, labels in pages:
        if page:
            found = [[index.setdefault(x, len(index)) for x in f] for f in features(page)]
            of = np.repeat(np.arange(len(page)), [len(f) for f in found])
            rows.append((np.array([i for f in found for i in f]), of, np.array(labels)))
    w, squares = np.zeros(len(index)), np.full(len(index), 1e-2)
    change, change_squares = np.zeros((2, 2)), np.full((2, 2), 1e-2)
    rng = np.random.default_rng(0)
    for _ in range(s.epochs):
        for k in rng.permutation(len(rows)):
            idx, of, labels = rows[k]
            p, pairs = _posteriors(np.bincount(of, w[idx], len(labels)), change)
            g = np.bincount(idx, (p - labels)[of], len(w)) + s.decay * w
            squares += g * g
            w -= s.rate * g / np.sqrt(squares)
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels[:-1], labels[1:]), 1)
            g = pairs - seen
            change_squares += g * g
            change -= s.rate * g / np.sqrt(change_squares)
    return Field({x: float(w[i]) for x, i in index.items()}, change)


def labelled(seeds: range) -> list[tuple[list[Block], list[int]]]:
    """Blocks of labelled pages: a block is main if the page's main text has it, in order."""
    out = []
    for seed in seeds:
        raw, main = labelled_page(seed)
        page, labels, at = blocks(raw), [], 0
        for b in page:
            hit = at < len(main) and b.text == main[at]
            at += hit
            labels.append(int(hit))
        out.append((page, labels))
    return out


@functools.lru_cache(maxsize=2)
def trained(s: Settings = Settings()) -> Field:
    return train(labelled(range(s.pages)), s)


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page, field.names)
    return "\n\n".join(b.text for b, label in zip(found, field.labels(found)) if label)


def extract(df: DataFrame, settings: Settings = Settings(), html: str = "html") -> DataFrame:
    """``df`` with the main text of its pages and the number of its code points."""
    shared = df.sparkSession.sparkContext.broadcast(trained(settings))

    @F.pandas_udf("string")
    def extracted(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, shared.value) for p in pages], index=pages.index, dtype=object)

    return df.withColumn("text", extracted(F.col(html))).withColumn("n_chars", F.length("text").cast("long"))
