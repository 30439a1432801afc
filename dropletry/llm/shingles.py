"""Sets of hashed word shingles, computed for many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes of text handled at a time.
SLICE_BYTES = 750_000


_FACTOR = 0x9E3779B97F4A7C15


def _pairs() -> np.ndarray:
    """What two bytes at the start of a word add to its sum."""
    one = np.arange(1, 257, dtype=np.uint64)
    one[65:91] = one[97:123]
    one[[9, 10, 11, 12, 13, 32]] = 0
    both = np.arange(1 << 16)
    return one[both & 255] * np.uint64(_FACTOR) + one[both >> 8] * np.uint64(_FACTOR * _FACTOR & 0xFFFFFFFFFFFFFFFF)


_PAIRS = _pairs()


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing steps of the splitmix64 generator: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row (A-Z lower-cased), and where words and texts start.

    Words are runs of bytes other than the six ASCII white-space characters; texts stand one after
    another, each followed by a line feed.
    """
    joined = b"\n".join(raws) + b"\n\n"
    data = np.frombuffer(joined, np.uint8)[:-1]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.concatenate([[not space[0]], space[1:] != space[:-1]]))
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    # The sum of (byte + 1) * factor^place over a word, two bytes at a time; the white space behind counts nothing.
    pairs = np.ndarray(len(data), "<u2", joined, strides=(1,))
    sums = _PAIRS[pairs[starts]]
    power, left = 1, np.flatnonzero(ends - starts > 2)
    at, stop = starts[left] + 2, ends[left]
    while len(left):
        power = power * _FACTOR * _FACTOR & 0xFFFFFFFFFFFFFFFF
        sums[left] += _PAIRS[pairs[at]] * np.uint64(power)
        at += 2
        on = at < stop
        left, at, stop = left[on], at[on], stop[on]
    return mixed(sums), starts, offsets


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """Each text's distinct shingles of ``width`` words as sorted int64 hashes.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    for part in slices(texts):
        yield from _sets(part, width)


def slices(texts: list[str | None], size: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The texts in UTF-8, about ``size`` bytes at a time."""
    part: list[bytes] = []
    held = 0
    for t in texts:
        part.append((t or "").encode())
        held += len(part[-1])
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def _sets(raws: list[bytes], width: int) -> Iterator[np.ndarray]:
    words, starts, offsets = word_hashes(raws)
    firsts = np.searchsorted(starts, offsets)
    n = max(0, len(words) - width + 1)
    sums = np.full(n, np.uint64(width))
    factor = np.uint64(1)
    for j in range(width):
        factor = np.uint64((int(factor) * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
        sums += words[j : j + n] * factor
    windows = mixed(sums).view(np.int64)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= width:
            yield np.unique(windows[a : b - width + 1])
        elif b > a:
            whole = (b - a) * 0x9E3779B97F4A7C15
            for w in words[a:b].tolist():
                whole = (whole * 0xD1342543DE82EF95 + w) & 0xFFFFFFFFFFFFFFFF
            yield mixed(np.array([whole], np.uint64)).view(np.int64)
        else:
            yield np.empty(0, np.int64)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit key that equal sets share, as two numbers."""
    raw = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)
