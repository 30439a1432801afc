"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text is a sequence of words (A-Z lower-cased, split at ASCII white space) and an end.  It is coded
in binary decisions, and the product of the decisions' probabilities is the text's:

1. Each token is a symbol: one of the most frequent words of training, else the first two bytes of the
   word, or the end.  A symbol is the path of decisions through a Huffman tree.  Three contexts of the
   running text (the last very frequent word, the symbol before, the two before) look up in hashed
   tables how often training went either way at such a place.  A logistic mix of these predictors' log
   odds gives the probability; its weights are gated by the number of contexts that training knows,
   and are learnt online along the text, as is a map that refines the mixed probability.
2. A word that is not a symbol was met in training or is new: one decision, whose odds come from the
   words that training met once among those with these first bytes (Good and Turing), mixed and
   learnt online in the same way.  A known word has its share of the training tokens with these bytes.
3. A new word is spelt byte by byte, each byte a path through another Huffman tree.  Contexts of the
   word's last 2, 3, 4 and 6 bytes look up how the spellings of the training vocabulary went on; gated
   weights and an adaptive map mix them.  These are learnt online over the vocabulary in fixed shards, each in a
   fixed order, with a word's own occurrence taken out of the counts, and averaged.

So contexts cross the borders of words in step 1 and stay within a word in step 3: a word is spelt
once, however often it occurs, and its result returns to the texts by a join.  All counts are those
of all training texts.  The tables of contexts grow with the input up to a bound (they are broadcast);
counts of words are exact, joined, and have none.  A score depends on the text and the training texts
alone: not on partitions, nor on the texts beside it.

Defined results: a null text is an empty one; a row with a null id counts as training text; equal
texts get equal scores; without training texts every decision but the symbol's has even odds; very
long texts are read in pieces, with what was learnt carried on; extra columns are ignored; an empty
table has no rows.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropletry.llm.shingles import mixed, slices, word_hashes
from dropletry.llm.tables import checkpointed, release


@dataclass(frozen=True)
class Settings:
    """frequent: words that are symbols; heads: of them, those that the contexts of frequent words keep;
    text_bits: most bits of the table of each context of the running text; text_prior: added to its
    counts; first_block, last_block: decisions after which weights are learnt, doubling from the one to
    the other; step: of that learning; caution: decisions that the weights at the start count for; piece: bytes of a text read at a time; orders: bytes of each context in a word; bits: of its table;
    prior: added to either count; levels: of confidence, by powers of two; rate, map_rate: of learning
    from the vocabulary; lanes: decisions learnt from at a time; words: of a spelling step; shards: of
    the vocabulary; chunk_bytes: of text that ask for their words together; slice_slots: of a table's
    piece when counts are summed; fan: tasks whose pieces are summed at a time."""

    frequent: int = 2_048
    heads: int = 256
    text_bits: tuple[int, ...] = (19, 21, 21)
    text_prior: float = 0.3
    first_block: int = 64
    last_block: int = 1 << 11
    step: float = 1.0
    caution: float = 15.0
    piece: int = 1_000_000
    orders: tuple[int, ...] = (2, 3, 4, 6)
    bits: tuple[int, ...] = (18, 19, 19, 19)
    prior: float = 0.4
    levels: int = 12
    rate: float = 0.03
    map_rate: float = 0.02
    lanes: int = 2048
    words: int = 16_000
    shards: int = 32
    chunk_bytes: int = 32_000_000
    slice_slots: int = 1 << 18
    fan: int = 64


#: Knots of the adaptive maps, in log odds.
KNOTS = np.linspace(-12, 12, 33, dtype=np.float32)
CLIP = np.float32(1 / 65536)
#: The weights that a text starts with: of the three contexts, by how many of them training met more than once; chosen on held-out texts.
START = np.array([[0.35, 0.2, 0.05], [0.48, 0.3, 0.1], [0.55, 0.3, 0.15], [0.58, 0.48, 0.33]], np.float32)
#: A word's first and second byte in its head, A-Z lower-cased; white space behind a word of one byte counts nothing.
FIRST_BYTE = np.array([ord(bytes([b]).lower()) << 8 for b in range(256)])
SECOND_BYTE = np.array([0 if bytes([b]).isspace() else ord(bytes([b]).lower()) for b in range(256)])
#: No symbol before the text.
NOTHING = 1 << 30


# ---- Step 1 and 2: running text ----


class Places:
    """Where hashes would stand among sorted distinct ones: an index by their first bits, then single steps."""

    def __init__(self, hashes: np.ndarray):
        bits = min(20, max(4, len(hashes).bit_length() + 2))
        self.shift = np.uint64(64 - bits)
        self.hashes = np.append(hashes, np.int64((1 << 63) - 1))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self._bucket(hashes), minlength=1 << bits))[:-1]]).astype(np.int32)

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> self.shift).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The place of the first that is not less, which may be behind the last."""
        at = self.first[self._bucket(hashes)]
        on = np.flatnonzero(self.hashes[at] < hashes)
        while len(on):
            at[on] += 1
            on = on[self.hashes[at[on]] < hashes[on]]
        return at


def unique_hashes(hashes: np.ndarray) -> np.ndarray:
    """The distinct ones, ascending."""
    found = np.sort(hashes)
    return found[np.diff(found, prepend=found[:1] - 1) != 0]


@dataclass
class Code:
    """The symbols of running text and their decisions.

    hashes, symbol: of frequent words, by hash; count: of each frequent word; of_head: symbol of two
    first bytes, -1 for those that training lacks; tokens, new: of training tokens with these bytes
    their number and the log odds that one is new; paths: of symbols, the last two of which are the end
    and other first bytes; spelling: paths of bytes.
    """

    hashes: np.ndarray
    symbol: np.ndarray
    count: np.ndarray
    of_head: np.ndarray
    tokens: np.ndarray
    new: np.ndarray
    paths: Paths
    spelling: Paths

    @functools.cached_property
    def places(self) -> Places:
        return Places(self.hashes)

    def is_often(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each is the hash of a frequent word."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        return self.hashes[np.minimum(self.places(hashes), len(self.hashes) - 1)] == hashes


def hashes_of(words: list[bytes]) -> np.ndarray:
    return word_hashes([b"\n".join(words)])[0].view(np.int64)


@dataclass
class Paths:
    """The way to each leaf of a binary tree: its depth and where it begins in node and bit."""

    depth: np.ndarray
    first: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    def __call__(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many decisions each leaf has, and the node and bit of all decisions."""
        depth = self.depth[leaves]
        ends = np.cumsum(depth, dtype=np.int64)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[leaves] - (ends - depth), depth)
        return depth, self.node[at], self.bit[at]


def huffman(weight: np.ndarray) -> Paths:
    """The tree of least mean depth for leaves of these weights; ties to lower numbers."""
    n = len(weight)
    heap = [(int(w), k) for k, w in enumerate(weight)]
    heapq.heapify(heap)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        left[k], right[k] = x, y
        heapq.heappush(heap, (a + b, n + k))
    above, side, depth = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8), np.zeros(2 * n, np.int64)
    for k in range(n - 2, -1, -1):
        for child, b in ((left[k], 0), (right[k], 1)):
            above[child], side[child], depth[child] = k, b, depth[n + k] + 1
    depth = depth[:n].astype(np.int32)
    first = (np.cumsum(depth) - depth).astype(np.int64)
    node, bit = np.zeros(int(depth.sum()), np.uint32), np.zeros(int(depth.sum()), np.uint8)
    at, here = np.arange(n), np.arange(n)
    for d in range(int(depth.max())):  # from the leaves up
        at, here = at[depth[at] > d], here[depth[at] > d]
        place = first[at] + depth[at] - 1 - d
        node[place], bit[place] = above[here], side[here]
        here = n + above[here]
    return Paths(depth, first, node, bit)


def code_of(words: list[bytes], counts: np.ndarray, heads: np.ndarray, tokens: np.ndarray, once: np.ndarray, ends: int, s: Settings) -> Code:
    """The code of frequent words with their counts, and of heads with their tokens and single words."""
    hashes = hashes_of(words)
    order = np.argsort(hashes)
    of_head, total, new = np.full(1 << 16, -1, np.int32), np.zeros(1 << 16), np.zeros(1 << 16, np.float32)
    of_head[heads] = len(words) + np.arange(len(heads))
    total[heads] = tokens
    new[heads] = np.log((once + 0.5) / (tokens - once + 0.5))
    paths = huffman(np.concatenate([counts, tokens, [ends, 0]]).astype(np.int64) + 1)
    spelling = huffman(np.bincount(np.frombuffer(b" ".join(words) + b" ", np.uint8), minlength=256) + 1)
    return Code(hashes[order], order.astype(np.int32), counts, of_head, total, new, paths, spelling)


@dataclass
class Carry:
    """What a piece of a text hands to the next: learning, the last symbols and frequent words."""

    mixers: list
    before: tuple[int, int] = (NOTHING, NOTHING)
    frequent: int = NOTHING


class Reading:
    """The tokens of some texts, each followed by an end unless ``open_end``."""

    def __init__(self, raws: list[bytes], code: Code, s: Settings, carry: Carry | None = None, open_end: bool = False):
        found, starts, offsets = word_hashes(raws)
        data = np.frombuffer(b"\n".join(raws) + b"\n\n", np.uint8)
        head = FIRST_BYTE[data[starts]] | SECOND_BYTE[data[starts + 1]]
        text = np.repeat(np.arange(len(raws)), np.diff(np.searchsorted(starts, offsets)))
        ends = 0 if open_end else len(raws)
        n = len(found) + ends
        place = np.arange(len(found)) + (text if ends else 0)
        self.text = np.zeros(n, np.int64)
        self.symbol = np.full(n, len(code.paths.depth) - 2, np.int64)
        self.hash, self.head = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.is_word = np.zeros(n, bool)
        hashes = found.view(np.int64)
        at = np.minimum(code.places(hashes), max(0, len(code.hashes) - 1))
        known = code.hashes[at] == hashes if len(code.hashes) else np.zeros(len(hashes), bool)
        symbol = np.where(known, code.symbol[at], code.of_head[head]) if len(code.hashes) else code.of_head[head]
        self.symbol[place] = np.where(symbol < 0, len(code.paths.depth) - 1, symbol)
        self.text[place], self.hash[place], self.head[place], self.is_word[place] = text, hashes, head, True
        if ends:
            last = np.cumsum(np.bincount(text, minlength=len(raws))) + np.arange(len(raws))
            self.text[last] = np.arange(len(raws))
        self.rare = self.is_word & (self.symbol >= len(code.hashes))
        carry = carry or Carry([])
        self.opens = np.concatenate([[True], self.text[1:] != self.text[:-1]]) if n else np.zeros(0, bool)
        before, second = self._back(self.symbol, carry.before)
        frequent = np.flatnonzero(self.symbol < min(s.heads, len(code.hashes)))
        self.contexts = [self._hash(1, self._frequent(frequent, carry.frequent)), self._hash(2, before), self._hash(3, before, second)]
        tail = [*self.symbol[-2:].tolist()][::-1]
        self.before = tuple([*tail, *carry.before][:2])
        self.frequent = int(self.symbol[frequent[-1]]) if len(frequent) else carry.frequent

    def _back(self, symbol: np.ndarray, carried: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The symbol before each and the one before that; at a text's start those carried on."""
        one, two = np.full(len(symbol), NOTHING), np.full(len(symbol), NOTHING)
        one[1:], two[2:] = symbol[:-1], symbol[:-2]
        start = np.flatnonzero(self.opens)
        one[start], two[start] = carried
        start = start[start + 1 < len(symbol)] + 1
        start = start[~self.opens[start]]
        two[start] = carried[0]
        return one, two

    def _frequent(self, at: np.ndarray, carried: int) -> np.ndarray:
        """The last frequent word before each token of its text."""
        is_one = np.zeros(len(self.symbol), np.int64)
        is_one[at] = 1
        count = np.cumsum(is_one) - is_one  # of them before each token
        first = count[self.opens][np.cumsum(self.opens) - 1] if len(self.opens) else count
        symbols = np.append(self.symbol[at], carried)
        return symbols[np.where(count > first, count - 1, len(at))]

    @staticmethod
    def _hash(salt: int, *symbols: np.ndarray) -> np.ndarray:
        h = np.full(len(symbols[0]), salt, np.uint32)
        for x in symbols:
            h = (h ^ (x.astype(np.uint32) + np.uint32(1))) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        return h

    def slots(self, depth: np.ndarray, node: np.ndarray, bits: list[int]) -> Iterator[np.ndarray]:
        """The slot of each decision in the table of each context."""
        for c, b in zip(self.contexts, bits):
            yield slots_of(c, depth, node, b)


def slots_of(context: np.ndarray, depth: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """The slot of each decision in the table of a context."""
    h = node + np.uint32(1)
    h *= np.uint32(0x85EBCA6B)
    h ^= np.repeat(context, depth)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - bits)
    return h.astype(np.int64)


def table_bits(tokens: int, s: Settings) -> list[int]:
    """The bits of the tables of running text: about eight slots for a training token, up to the bounds."""
    return [min(b, max(12, (8 * tokens).bit_length())) for b in s.text_bits]


def packed(counts: np.ndarray, s: Settings) -> np.ndarray:
    """The log odds of each slot in 1/512, the last bit telling whether it was met more than once."""
    zeros, ones = counts[0::2].astype(np.float32), counts[1::2].astype(np.float32)
    odds = np.clip(np.log((ones + np.float32(s.text_prior)) / (zeros + np.float32(s.text_prior))), -12, 12)
    return ((odds * 512).astype(np.int16) << 1) | (zeros + ones >= 2).astype(np.int16)


def odds_to_probability(opposite: np.ndarray) -> np.ndarray:
    """The probability of these log odds against it."""
    p = np.exp(opposite)
    p += 1
    return np.divide(1, p, out=p)


class Mixer:
    """Weights of each text by gate and input, and its map; learnt block by block along the texts."""

    def __init__(self, texts: int, start: np.ndarray, s: Settings, more: bool = False):
        self.more = more  # whether what the last block teaches is still needed
        self.s, self.gates, self.inputs = s, *start.shape
        self.weights = np.tile(start.astype(np.float32).T[:, None, :], (1, texts, 1)).reshape(self.inputs, -1)
        self.seen = np.full(texts * self.gates, s.caution, np.float32)
        self.map, self.map_seen = np.zeros(texts * len(KNOTS), np.float32), np.full(texts * len(KNOTS), s.caution / 3, np.float32)
        self.done = np.zeros(texts, np.int64)

    def _blocks(self, opens: np.ndarray, sizes: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The decisions block by block, in each text by text, and where blocks begin and the last one ends.

        ``opens``, ``sizes``, ``done``: each text's first decision, how many follow and how many came before.
        """
        doublings, last = int(math.log2(self.s.last_block / self.s.first_block)), self.s.last_block
        limits = np.concatenate([[0], np.cumsum(self.s.first_block << np.arange(doublings + 1))])

        def block_of(place: np.ndarray) -> np.ndarray:
            return np.searchsorted(limits[1:], place, side="right") + np.maximum(place - limits[-1], 0) // last

        def begin_of(block: np.ndarray) -> np.ndarray:
            return limits[np.minimum(block, doublings + 1)] + np.maximum(block - doublings - 1, 0) * last

        first = block_of(done)
        parts = block_of(done + sizes - 1) - first + 1
        text = np.repeat(np.arange(len(opens)), parts)
        block = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts - first, parts)
        by_block = np.argsort(block, kind="stable")
        text, block = text[by_block], block[by_block]
        begin = np.maximum(begin_of(block), done[text])
        length = np.minimum(begin_of(block + 1), (done + sizes)[text]) - begin
        ends = np.cumsum(length)
        order = np.arange(int(ends[-1])) + np.repeat((opens - done)[text] + begin - (ends - length), length)
        return order, np.concatenate([[0], ends[np.flatnonzero(np.diff(block, append=-1))]])

    def score(self, inputs: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The log10 probability of each decision; decisions of a text stand together and in order."""
        out = np.zeros(len(bit), np.float32)
        if not len(bit):
            return out
        opens = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        sizes = np.diff(np.append(opens, len(bit)))
        order, edges = self._blocks(opens, sizes, self.done[text[opens]])
        np.add.at(self.done, text[opens], sizes)
        inputs, bits, knots = [i.take(order) for i in inputs], bit.take(order).astype(np.float32), (text * len(KNOTS)).take(order)
        cells, scores = (text * self.gates + gate).take(order), np.zeros(len(bit), np.float32)
        step, half = np.float32(1 / (KNOTS[1] - KNOTS[0])), np.float32(0.5)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            x, cell, y = [i[a:b] for i in inputs], cells[a:b], bits[a:b]
            z = np.zeros(b - a, np.float32)
            for w, i in zip(self.weights, x):
                part = w.take(cell)
                part *= i
                z += part
            np.clip(z, KNOTS[0], KNOTS[-1], out=z)
            knot = knots[a:b] + ((z - KNOTS[0]) * step + half).astype(np.int64)
            np.negative(z, out=z)
            p, q = odds_to_probability(z), odds_to_probability(z - self.map.take(knot))
            both = (p + q) * half
            np.abs(np.subtract(1 - y, both, out=both), out=both)  # where the bit is 0, of the other way
            scores[a:b] = np.log10(np.clip(both, CLIP, 1 - CLIP, out=both), out=both)
            if b == len(order) and not self.more:
                break
            # The mean error of all decisions so far moves each weight, and each knot in log odds.
            err = y - p
            self.seen += np.bincount(cell, minlength=len(self.seen)).astype(np.float32)
            for w, i in zip(self.weights, x):
                w += (self.s.step * np.bincount(cell, err * i, len(self.seen)) / self.seen).astype(np.float32)
            self.map_seen += np.bincount(knot, minlength=len(self.map)).astype(np.float32)
            self.map += (6 * np.bincount(knot, y - q, len(self.map)) / self.map_seen).astype(np.float32)
        out[order] = scores
        return out


def running(reading: Reading, code: Code, tables: list[np.ndarray], known: np.ndarray, mixers: list[Mixer]) -> np.ndarray:
    """The log10 probability of each token's symbol and, of a rare word, of being known or not."""
    depth, node, bit = code.paths(reading.symbol)
    inputs, sure = [], np.zeros(len(node), np.int16)
    bits = [len(t).bit_length() - 1 for t in tables]
    for table, slot in zip(tables, reading.slots(depth, node, bits)):
        raw = table.take(slot)
        sure += raw & np.int16(1)
        raw >>= np.int16(1)
        odds = raw.astype(np.float32)
        odds *= np.float32(1 / 512)
        inputs.append(odds)
    lp = mixers[0].score(inputs, sure, bit, np.repeat(reading.text, depth))
    out = np.add.reduceat(lp, np.cumsum(depth) - depth, dtype=np.float64) if len(depth) else np.zeros(0)
    other = reading.symbol == len(code.paths.depth) - 1
    out[other] -= 16 * math.log10(2)  # which first bytes
    flag = np.flatnonzero(reading.rare & ~other)
    odds = code.new[reading.head[flag]]
    out[flag] += mixers[1].score([odds, np.ones(len(flag), np.float32)], np.zeros(len(flag), np.int64), (~known[flag]).astype(np.int64), reading.text[flag])
    return out


def fresh_mixers(texts: int, s: Settings, more: bool = False) -> list[Mixer]:
    return [Mixer(texts, START, s, more), Mixer(texts, np.array([[1.0, 0.0]]), s, more)]


def pieces_of(raw: bytes, size: int) -> list[bytes]:
    """A text cut behind white space into pieces of about ``size`` bytes, or longer where a word is."""
    out, at = [], 0
    while len(raw) - at > size:
        cut = min((c for c in (raw.find(b, at + size) for b in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if c >= 0), default=len(raw) - 1) + 1
        out.append(raw[at:cut])
        at = cut
    return [*out, raw[at:]]


# ---- Step 3: spelling ----


@dataclass
class Weights:
    """mix: by order count of confident predictors, predictor and confidence; map: by that count and knot."""

    mix: np.ndarray
    map: np.ndarray
    squares: np.ndarray = field(default=None)


def fresh(s: Settings) -> Weights:
    k = len(s.orders)
    return Weights(np.full((k + 1, k, s.levels), 1.5 / k, np.float64), np.tile(1 / (1 + np.exp(-KNOTS)), (k + 1, 1)), np.full((k + 1, k, s.levels), 1e-3))


class Spelling:
    """The byte decisions of some words behind their first bytes, and the hashes of their contexts."""

    def __init__(self, words: list[bytes], paths: Paths, s: Settings):
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(data)) - np.repeat(first, lengths)
        one_byte = np.concatenate([data, [0]])[first + 1] == 0  # a second byte of 0 is not in the head
        known = np.minimum(lengths - 1, 2) - (one_byte & (lengths > 2))
        keep = place >= np.repeat(known, lengths)
        word = np.repeat(np.arange(len(words)), lengths)[keep]
        sums, contexts = np.zeros(len(data), np.uint64), []
        for back in range(1, max(s.orders) + 1):
            # A context that reaches the word's start keeps a mark of it and does not grow on.
            seen = np.zeros(len(data), np.uint64)
            seen[back:] = data[:-back].astype(np.uint64) + np.uint64(2)
            seen = np.where(place > back - 1, seen, np.where(place == back - 1, np.uint64(1), np.uint64(0)))
            sums = sums * np.uint64(0x9E3779B97F4A7C15) + seen
            if back in s.orders:
                contexts.append((mixed(sums[keep]) >> np.uint64(32)).astype(np.uint32))
        depth, node, self.bit = paths(data[keep])
        self.word = np.repeat(word, depth)
        salt = (node + np.uint32(1)) * np.uint32(0x85EBCA6B)
        self.slots = []
        for c, b in zip(contexts, s.bits):
            h = (np.repeat(c, depth) ^ salt) * np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            self.slots.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - b)).astype(np.int64))


def count(words: list[bytes], paths: Paths, s: Settings) -> list[np.ndarray]:
    """How often each slot's decision was 0 and 1 in spelling the words: slots x 2 for each table."""
    tables = [np.zeros(2 << b, np.int32) for b in s.bits]
    for a in range(0, len(words), s.words):
        x = Spelling(words[a : a + s.words], paths, s)
        one = np.ones(len(x.bit), np.int32)
        for table, slot in zip(tables, x.slots):
            np.add.at(table, slot * 2 + x.bit, one)
    return tables


def _inputs(tables: list[np.ndarray], slots: list[np.ndarray], own: np.ndarray | None, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each predictor's log odds and confidence level, and how many are confident.

    ``own``: bits whose own occurrence is taken out of the counts.
    """
    k, n = len(slots), len(slots[0])
    odds, level = np.empty((k, n), np.float32), np.empty((k, n), np.int64)
    for i, (table, slot) in enumerate(zip(tables, slots)):
        both = table.reshape(-1, 2).view(np.int64).take(slot).view(np.int32)
        zeros, ones = both[0::2].astype(np.float32), both[1::2].astype(np.float32)
        if own is not None:
            ones -= own
            zeros -= 1 - own
            np.maximum(ones, 0, out=ones)
            np.maximum(zeros, 0, out=zeros)
        total = zeros + ones
        ones += np.float32(s.prior)
        zeros += np.float32(s.prior)
        ones /= zeros
        np.log(ones, out=odds[i])
        level[i] = np.minimum(np.frexp(total)[1], s.levels - 1)
    return odds, level, (level >= 2).sum(axis=0)


def _mapped(w: Weights, sure: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.clip((z - KNOTS[0]) / (KNOTS[1] - KNOTS[0]), 0, len(KNOTS) - 1.001)
    low = at.astype(np.int64)
    part = at - low
    return w.map[sure, low] * (1 - part) + w.map[sure, low + 1] * part, low, part


def _probability(z: np.ndarray, mapped: np.ndarray) -> np.ndarray:
    return np.clip((1 / (1 + np.exp(-z)) + mapped) / 2, CLIP, 1 - CLIP)


def learn(w: Weights, tables: list[np.ndarray], words: list[bytes], paths: Paths, s: Settings) -> None:
    """Online learning of the weights over the words."""
    rows = np.arange(len(s.orders))[:, None]
    for a in range(0, len(words), s.words):
        x = Spelling(words[a : a + s.words], paths, s)
        odds_all, level_all, sure_all = _inputs(tables, x.slots, x.bit, s)
        cell_all = (sure_all[None, :] * len(s.orders) + rows) * s.levels + level_all
        for b in range(0, len(x.bit), s.lanes):
            part = slice(b, b + s.lanes)
            bit, odds, cell, sure = x.bit[part], odds_all[:, part], cell_all[:, part], sure_all[part]
            z = np.clip((w.mix.ravel().take(cell) * odds).sum(axis=0), -20, 20)
            mapped, low, frac = _mapped(w, sure, z)
            err = (bit - 1 / (1 + np.exp(-z))) / len(bit)
            g = np.bincount(cell.ravel(), (odds * err).ravel(), w.mix.size).reshape(w.mix.shape)
            w.squares += g * g
            w.mix += s.rate * g / np.sqrt(w.squares)
            cell = sure * len(KNOTS) + low
            for shift, share in ((0, 1 - frac), (1, frac)):
                total = np.bincount(cell + shift, share, w.map.size)
                move = np.bincount(cell + shift, share * (bit - mapped), w.map.size)
                w.map += s.map_rate * (move / np.maximum(total, 1e-9)).reshape(w.map.shape)


def log10_probability(w: Weights, tables: list[np.ndarray], words: list[bytes], paths: Paths, s: Settings) -> np.ndarray:
    """The log10 probability of each word with its closing space, its first bytes given."""
    rows = np.arange(len(s.orders))[:, None]
    out = np.zeros(len(words))
    for a in range(0, len(words), s.words):
        x = Spelling(words[a : a + s.words], paths, s)
        odds, level, sure = _inputs(tables, x.slots, None, s)
        z = np.clip((w.mix[sure[None, :], rows, level] * odds).sum(axis=0), -20, 20)
        p = _probability(z, _mapped(w, sure, z)[0])
        out[a : a + s.words] = np.bincount(x.word, np.log10(np.where(x.bit == 1, p, 1 - p)), len(words[a : a + s.words]))
    return out


# ---- Spark ----


def runs(sizes: np.ndarray, size: int, most: int) -> Iterator[tuple[int, int]]:
    """Where to cut rows of these sizes into runs of about ``size``, or of ``most`` rows."""
    ends, a = np.cumsum(sizes, dtype=np.int64), 0
    while a < len(ends):
        b = min(a + most, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size)) + 1, len(ends))
        yield a, b
        a = b


def counted(low: pa.Array, training: bool) -> pa.Table:
    """(word, n: occurrences, or 0 outside of training) of lower-cased texts.

    Arrow lower-cases A-Z alone and cuts at the six ASCII white-space characters; white space at a text's
    edge leaves an empty word, which is none."""
    found = pc.value_counts(pc.list_flatten(pc.ascii_split_whitespace(low)))
    words, n = found.field(0).cast(pa.binary()), found.field(1)
    is_word = pc.greater(pc.binary_length(words), 0)
    return pa.table({"word": words.filter(is_word), "n": pc.multiply(n.filter(is_word), pa.scalar(int(training), pa.int64()))})


def vocabulary(docs: DataFrame) -> DataFrame:
    """(hash, word, n: occurrences in training texts) for the words of all texts, and for the empty word,
    of hash 0, the training texts, and for a null word the bytes of all texts; docs: text, held_out."""

    def rows_of(hashes: np.ndarray | list, words: pa.Array | list, n: pa.Array | list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["hash", "word", "n"])

    def frames(held: pa.Table, texts: int, size: int) -> Iterator[pa.RecordBatch]:
        for part in held.to_batches(max_chunksize=50_000):
            yield rows_of(hashes_of(part.column("word").to_pylist()), part.column("word"), part.column("n"))
        yield rows_of([0, 0], [b"", None], [texts, size])

    def merged(parts: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return pa.table({"word": found["word"], "n": found["n_sum"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [counted(pa.array([], pa.string()), False)]
        texts = size = 0
        for batch in batches:
            out, low = batch.column("held_out"), pc.ascii_lower(batch.column("text"))
            sizes = pc.binary_length(low).to_numpy(zero_copy_only=False)
            for a, b in runs(sizes, 4_000_000, 2000):
                part, flag = low.slice(a, b - a), out.slice(a, b - a)
                held += [counted(part.filter(pc.invert(flag)), True), counted(part.filter(flag), False)]
                if sum(h.num_rows for h in held) > 1_000_000:
                    held = [merged(held)]
                    if held[0].num_rows > 500_000:
                        yield from frames(held[0], 0, 0)
                        held = [held[0].slice(0, 0)]
            texts, size = texts + len(out) - (pc.sum(out).as_py() or 0), size + int(sizes.sum())
        yield from frames(merged(held), texts, size)

    rows = docs.select("text", "held_out").mapInArrow(run, "hash long, word binary, n long")
    return rows.groupBy("hash", "word").agg(F.sum("n").alias("n"))


def most_frequent(words: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The words that training has most often, and their counts: as many whole bins of a fine histogram of
    counts as make up to ``most``, by count and then word; the driver gets the histogram and them."""
    spelt = words.where("n > 0 and octet_length(word) > 0")
    bin_of = F.floor(F.log2("n") * 64)
    sizes = sorted(((r["bin"], r["count"]) for r in spelt.groupBy(bin_of.alias("bin")).count().collect()), reverse=True)
    held, least = 0, None
    for b, size in sizes:
        if held + size > most:
            break
        held, least = held + size, b
    if least is None:
        return [], np.zeros(0, np.int64)
    found = spelt.where(bin_of >= least).select("word", "n").toArrow()
    order = sorted(zip((-n for n in found["n"].to_pylist()), map(bytes, found["word"].to_pylist())))
    return [w for _, w in order], np.array([-n for n, _ in order], np.int64)


def summed(rows: DataFrame, shapes: list[int], s: Settings) -> list[np.ndarray]:
    """Tables of these lengths, summed over the tasks of ``rows`` (task, piece, counts); the sizes are
    fixed by the settings, and no task sums more than ``fan`` pieces before the last round."""
    flat = np.zeros(sum(shapes), np.int32)
    slots = len(flat)

    def counts_of(piece: int, raw: pa.Buffer | bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(raw, 4 * min(s.slice_slots, slots - piece * s.slice_slots), "zstd"), np.int32)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for raw in batch.column("counts"):
                part = counts_of(key[1].as_py(), raw.as_buffer())
                total = part.copy() if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), pa.array([pa.compress(total, "zstd", asbytes=True)], pa.binary())], names=["task", "piece", "counts"])

    schema = "task long, piece int, counts binary"
    for fan in (s.fan, s.fan * s.fan):
        rows = rows.withColumn("task", F.expr(f"task div {fan}")).groupBy("task", "piece").applyInArrow(add, schema)
    rows = rows.withColumn("task", F.lit(0).cast("long")).groupBy("task", "piece").applyInArrow(add, schema)
    found = rows.toArrow()
    for piece, counts in zip(found["piece"].to_pylist(), found["counts"].to_pylist()):
        part = counts_of(piece, counts)
        flat[piece * s.slice_slots : piece * s.slice_slots + len(part)] = part
    edges = np.concatenate([[0], np.cumsum(shapes)])
    return [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def sliced(tables: list[np.ndarray], task: int, s: Settings) -> Iterator[pd.DataFrame]:
    flat = np.concatenate(tables)
    for k, a in enumerate(range(0, len(flat), s.slice_slots)):
        part = flat[a : a + s.slice_slots]
        if part.any():
            yield pd.DataFrame({"task": [task], "piece": [k], "counts": [pa.compress(part, "zstd", asbytes=True)]})


def gathered(batches: Iterator[pd.DataFrame], column: str, size: int) -> Iterator[list[bytes]]:
    """The values of a binary column, about ``size`` at a time."""
    held: list[bytes] = []
    for batch in batches:
        held += [bytes(w) for w in batch[column]]
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


def add_pairs(tables: list[np.ndarray], tokens: list[np.ndarray], bits: list[int], code: Code) -> None:
    """Adds the decisions of tokens (their symbols, then each context) to the tables, those of a symbol
    behind a context once, times how often both meet."""
    for table, context, b in zip(tables, tokens[1:], bits):
        pairs = np.sort(context.astype(np.uint64) << np.uint64(32) | tokens[0])
        first = np.flatnonzero(np.diff(pairs, prepend=pairs[:1] - np.uint64(1)))
        times, pairs = np.diff(first, append=len(pairs)).astype(np.int32), pairs[first]
        for a in range(0, len(pairs), 30_000):
            part = pairs[a : a + 30_000]
            depth, node, bit = code.paths((part & np.uint64(0xFFFFFFFF)).astype(np.int64))
            slot = slots_of((part >> np.uint64(32)).astype(np.uint32), depth, node, b)
            np.add.at(table, slot * 2 + bit, np.repeat(times[a : a + 30_000], depth))


def text_tables(docs: DataFrame, shared, bits: list[int], s: Settings) -> list[np.ndarray]:
    """The packed tables of the contexts of running text, over all training texts."""
    from pyspark import TaskContext

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = shared.value
        tables = [np.zeros(2 << b, np.int32) for b in bits]
        held: list[list[np.ndarray]] = []  # symbols of tokens and their contexts
        for batch in batches:
            for raws in slices(batch["text"].tolist(), 200_000):
                for part, carry, more in portions(raws, s):
                    reading = Reading(part, code, s, carry[0], more)
                    carry[0] = Carry([], reading.before, reading.frequent)
                    held.append([reading.symbol.astype(np.uint32), *reading.contexts])
                    if sum(len(h[0]) for h in held) >= 1_000_000:
                        add_pairs(tables, [np.concatenate(c) for c in zip(*held)], bits, code)
                        held = []
            release()
        if held:
            add_pairs(tables, [np.concatenate(c) for c in zip(*held)], bits, code)
        yield from sliced(tables, TaskContext.get().partitionId(), s)

    rows = docs.where(~F.col("held_out")).select("text").mapInPandas(run, "task long, piece int, counts binary")
    return [packed(t, s) for t in summed(rows, [2 << b for b in bits], s)]


def portions(raws: list[bytes], s: Settings) -> Iterator[tuple[list[bytes], list, bool]]:
    """Texts to read together; a very long text alone and in pieces, with a place for what they carry on."""
    short: list[bytes] = []
    for r in raws:
        if len(r) > s.piece:
            if short:
                yield short, [None], False
                short = []
            carry, parts = [None], pieces_of(r, s.piece)
            for k, p in enumerate(parts):
                yield [p], carry, k + 1 < len(parts)
        else:
            short.append(r)
    if short:
        yield short, [None], False


def spelling_tables(words: DataFrame, shared, s: Settings) -> list[np.ndarray]:
    from pyspark import TaskContext

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in gathered(batches, "word", s.words):
            found = count(part, shared.value.spelling, s)
            total = found if total is None else [a + b for a, b in zip(total, found)]
        if total is not None:
            yield from sliced(total, TaskContext.get().partitionId(), s)

    return summed(words.select("word").mapInPandas(run, "task long, piece int, counts binary"), [2 << b for b in s.bits], s)


def weights_of(words: DataFrame, code, shared, s: Settings) -> Weights:
    """Weights learnt in each shard of the vocabulary, averaged by the words they saw; a row for a shard."""
    shape, map_shape = fresh(s).mix.shape, fresh(s).map.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learnt: tuple | None = None

        def row() -> pd.DataFrame:
            number, w, seen = learnt
            return pd.DataFrame({"shard": [number], "seen": [float(seen)], "v": [np.concatenate([w.mix.ravel(), w.map.ravel()])]})

        held: list[bytes] = []
        for batch in batches:
            for number, rows in batch.groupby("shard", sort=True):
                if learnt is None or learnt[0] != number:
                    if learnt is not None:
                        learn(learnt[1], shared.value, held, code.value.spelling, s)
                        yield row()
                    learnt, held = (number, fresh(s), 0), []
                held += [bytes(w) for w in rows["word"]]
                learnt = (number, learnt[1], learnt[2] + len(rows))
                while len(held) >= s.words:
                    learn(learnt[1], shared.value, held[: s.words], code.value.spelling, s)
                    held = held[s.words :]
        if learnt is not None:
            learn(learnt[1], shared.value, held, code.value.spelling, s)
            yield row()

    dealt = words.select("word", "hash", F.pmod("hash", F.lit(s.shards)).cast("int").alias("shard")).repartition(s.shards, "shard").sortWithinPartitions("shard", "hash", "word")
    found = dealt.select("shard", "word").mapInPandas(run, "shard int, seen double, v array<double>").toArrow().to_pylist()
    if not found:
        return fresh(s)
    found.sort(key=lambda r: r["shard"])
    mean = np.average(np.array([r["v"] for r in found]), axis=0, weights=[r["seen"] for r in found])
    return Weights(mean[: math.prod(shape)].reshape(shape), mean[math.prod(shape) :].reshape(map_shape))


@dataclass
class Lookup:
    """Of the words that a chunk asked for, by hash: training count and log10 probability of the spelling."""

    hashes: np.ndarray
    n: np.ndarray
    lp: np.ndarray

    def __post_init__(self) -> None:
        self.places = Places(self.hashes)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.places(hashes)
        return self.n[at], self.lp[at]


def scored(raws: list[bytes], code: Code, tables: list[np.ndarray], words: Lookup, train_docs: int, base: float, s: Settings) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score, score of some texts."""
    parts: list[tuple] = []
    for part, carry, more in portions(raws, s):
        reading = Reading(part, code, s, carry[0], more)
        mixers = carry[0].mixers if carry[0] else fresh_mixers(len(part), s, more)
        rare = np.flatnonzero(reading.rare)
        n = np.full(len(reading.symbol), train_docs, np.int64)
        often = reading.is_word & ~reading.rare
        n[often] = code.count[reading.symbol[often]]
        n[rare], spelt = words(reading.hash[rare])
        lp = running(reading, code, tables, n > 0, mixers)
        own = np.where(n[rare] > 0, np.log10(np.maximum(n[rare], 1) / np.maximum(code.tokens[reading.head[rare]], 1)), spelt)
        lp[rare] += own
        size = len(part)
        sums = (np.bincount(reading.text, minlength=size), np.bincount(reading.text, n > 0, size), np.bincount(reading.text, np.log10(n + 1.0) - base, size), np.bincount(reading.text, lp, size))
        if carry[0]:
            parts[-1] = tuple(a + b for a, b in zip(parts[-1], sums))
        else:
            parts.append(sums)
        carry[0] = Carry(mixers, reading.before, reading.frequent)
    return tuple(np.concatenate(c) for c in zip(*parts))


def score(docs: DataFrame, held_out: Column, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    bits_per_byte: of the whole text in UTF-8; null for an empty one.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    docs = docs.select(key, F.coalesce(text, F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    words = checkpointed(vocabulary(docs))
    totals = words.agg(
        F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("tokens"), F.count_if(F.col("word").isNotNull() & (F.col("n") > 0)).alias("distinct"),
        F.max(F.when(F.octet_length("word") == 0, F.col("n"))).alias("docs"), F.max(F.when(F.col("word").isNull(), F.col("n"))).alias("bytes"),
    ).first()
    tokens, distinct, train_docs, size = (int(totals[c] or 0) for c in ("tokens", "distinct", "docs", "bytes"))
    chunks = max(1, -(-size // s.chunk_bytes))
    spelt = words.where("octet_length(word) > 0")
    often, counts = most_frequent(words, s.frequent)
    listed = F.broadcast(spark.createDataFrame([(h,) for h in hashes_of(often).tolist()], "hash long"))
    rare = spelt.join(listed, "hash", "left_anti")
    first_two = F.conv(F.hex(F.substring("word", 1, 2)), 16, 10).cast("int") * F.when(F.octet_length("word") == 1, 256).otherwise(1)
    heads = rare.where("n > 0").groupBy(first_two.alias("head")).agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).orderBy("head").toArrow()
    head_arrays = [heads[c].to_numpy() for c in ("head", "n", "once")]
    code = spark.sparkContext.broadcast(code_of(often, counts, *head_arrays, train_docs, s))
    tables = spark.sparkContext.broadcast(text_tables(docs, code, table_bits(tokens, s), s))
    trained = rare.where("n > 0")
    shared = spark.sparkContext.broadcast(spelling_tables(trained, code, s))
    weights = spark.sparkContext.broadcast(weights_of(trained, code, shared, s))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def frame() -> pd.DataFrame:
            rows = pd.concat(held)
            new = (rows["n"] == 0).to_numpy()
            lp = np.zeros(len(rows))
            lp[new] = log10_probability(weights.value, shared.value, [bytes(w) for w in rows["word"][new]], code.value.spelling, s)
            return pd.DataFrame({"hash": rows["hash"], "n": rows["n"], "lp": lp})

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= s.words:
                yield frame()
                held = []
        if held:
            yield frame()

    judged = rare.select("word", "hash", "n").mapInPandas(judge, "hash long, n long, lp double")
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64(key, "text"), F.lit(chunks))).repartition("chunk")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}  # of each chunk: what is distinct so far, then what came since

        def frames() -> Iterator[pd.DataFrame]:
            for chunk, parts in held.items():
                found = unique_hashes(np.concatenate(parts))
                yield pd.DataFrame({"chunk": np.full(len(found), chunk), "hash": found})
            held.clear()

        for batch in batches:
            for chunk, rows in batch.groupby("chunk"):
                parts = held.setdefault(chunk, [np.empty(0, np.int64)])
                for raws in slices(rows["text"].tolist()):
                    hashes = word_hashes(raws)[0].view(np.int64)
                    parts.append(unique_hashes(hashes[~code.value.is_often(hashes)]))
                if sum(map(len, parts[1:])) > max(500_000, len(parts[0])):
                    held[chunk] = [unique_hashes(np.concatenate(parts))]
            if sum(len(p) for parts in held.values() for p in parts) > 4_000_000:
                yield from frames()
        yield from frames()

    # All columns, though two are read: so the texts are exchanged once, for this pass and the last.
    asked = dealt.mapInPandas(ask, "chunk long, hash long").join(judged, "hash").select("chunk", "hash", "n", "lp")
    base = math.log10(tokens + distinct + 1)

    def combine(texts: pa.Table, known: pa.Table) -> pa.Table:
        hashes, first = np.unique(known["hash"].to_numpy(), return_index=True)
        lookup = Lookup(hashes, known["n"].to_numpy()[first], known["lp"].to_numpy()[first])
        # Texts of like lengths together: they have like numbers of blocks to learn from.
        sizes = pc.binary_length(texts["text"]).to_numpy()
        order = np.argsort(sizes, kind="stable")
        texts, sizes = texts.select([key, "held_out", "text"]).take(order), sizes[order]
        parts = []
        for a, b in runs(sizes, 150_000, 4096):
            raws = [r.encode() for r in texts["text"].slice(a, b - a).to_pylist()]
            parts.append((*scored(raws, code.value, tables.value, lookup, train_docs, base, s), sizes[a:b]))
        n_tokens, n_known, base_score, model, size = (np.concatenate(c) for c in zip(*parts)) if parts else ([], [], [], [], [])
        size = np.asarray(size, np.float64)
        bits = np.where(size > 0, -np.asarray(model) * math.log2(10) / np.maximum(size, 1), np.nan)
        release()
        return pa.table({
            key: texts[key], "held_out": texts["held_out"], "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(np.asarray(n_known, np.int64), pa.int64()),
            "train_tokens": pa.array([tokens] * len(n_tokens), pa.int64()), "base_score": pa.array(base_score, pa.float64()), "score": pa.array(model, pa.float64()),
            "bits_per_byte": pa.array(bits, pa.float64(), from_pandas=True),
        })

    schema = f"`{key}` {dict(docs.dtypes)[key]}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(combine, schema)
