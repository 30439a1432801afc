"""BPE encoding and decoding by speculation and verification.

A greedy longest match proposes tokens for each distinct word.  A proposal is the true BPE
segmentation exactly when no merge can fire across any of its token boundaries, which is a
property of each adjacent pair alone; all pairs are tested together in numpy.  Only words with
a failing pair go through exact merging.

Defined results: a null or empty text has no ids; equal texts have equal ids; special tokens
written in a text become their special ids, as the tokenizers library does by default; very long
texts and words are encoded whole; an empty table has no rows; extra columns are carried through.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropletry.llm.tables import release

#: Characters that Unicode calls white space; Python's \s has four control characters more.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of western European languages after lower-casing, which the faster matcher knows.
LATIN = r"a-z\xdf-\xf6\xf8-\u017f"
END = "</w>"
#: Characters handled at a time, so that lists of words stay small beside the batch.
SLICE_CHARS = 1_500_000
#: Words kept between batches before the table starts afresh.
TABLE_WORDS = 250_000
#: New words encoded at a time.
NEW_WORDS = 20_000
#: Bytes of a word beyond which exact merging uses a heap.
LONG_WORD = 100
#: A rank later than every merge.
NEVER = np.int64(1 << 40)
#: Of each byte of text in ASCII and LATIN: 0 white space, 1 of a letter, 2 a digit, 3 any other.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]], KIND[65:91], KIND[97:123], KIND[128:], KIND[48:58] = 0, 1, 1, 1, 2
#: What is a word of its own behind an apostrophe.
CONTRACTIONS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in kept}
    for n, b in enumerate(b for b in range(256) if b not in chars):
        chars[b] = chr(256 + n)
    return [chars[b] for b in range(256)]


class _Hash:
    """A fixed table from non-negative int64 keys to int32 values, probed in numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            cand = left[free]
            _, first = np.unique(slot[cand], return_index=True)
            put = cand[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        mask = (1 << self.bits) - 1
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


def latin_words(raws: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of lower-cased texts in ASCII and LATIN, and how many each text has."""
    joined = b"\n".join(raws) + b"\n\n\n"
    data = np.frombuffer(joined, np.uint8)
    kind = KIND[data]
    # Words end where the kind changes, and behind each digit; an apostrophe that opens a word may take letters along.
    cut = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    at = np.flatnonzero(data[:-3] == 39)
    at = at[(at == 0) | (kind[at - 1] != 3)]
    if len(at):
        takes = np.zeros(len(at), np.int64)
        for c in CONTRACTIONS:
            takes[np.all([data[at + 1 + k] == b for k, b in enumerate(c)], axis=0)] = len(c)
        at, takes = at[takes > 0], takes[takes > 0]
        cut[at], cut[at + takes] = False, True
    ends = np.flatnonzero(cut & (kind[:-1] != 0))
    per_text = np.diff(np.searchsorted(ends, np.cumsum([0, *(len(r) + 1 for r in raws)])))
    ends = ends[kind[ends + 1] != 0]
    spaced = np.full(len(data) + len(ends), 32, np.uint8)
    kept = np.ones(len(spaced), bool)
    kept[ends + np.arange(1, len(ends) + 1)] = False
    spaced[kept] = data
    return spaced.tobytes().split(), per_text  # bytes split at the six ASCII white-space characters


class _Numbers(dict):
    """Numbers of values in the order in which they are first asked for."""

    def __missing__(self, value: bytes) -> int:
        n = self[value] = len(self)
        return n


class Codec:
    """Encoder and decoder of a tokenizers file with word-final symbols.

    Symbols are 0 to 255 for a byte inside a word and 256 to 511 for a word's last byte.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        if spec["model"].get("end_of_word_suffix") != END:
            raise ValueError("the vocabulary has no word-final symbols")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.text = np.full(size, "", object)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = t
        chars = _byte_chars()
        self.base = np.array([vocab[c] for c in chars] + [vocab[c + END] for c in chars], np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.birth = np.full(size, -1, np.int64)
        parts: dict[int, tuple[int, ...]] = {int(t): (s,) for s, t in enumerate(self.base)}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        a, b = [], []
        for rank, pair in enumerate(spec["model"]["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[x], vocab[y], vocab[x + y]
            if z in parts or max(self.birth[x], self.birth[y]) >= rank:
                raise ValueError("merges are expected to make each token once, from earlier tokens")
            parts[z] = parts[x] + parts[y]
            self.left[z], self.right[z], self.birth[z] = x, y, rank
            self.merge[x, y] = (rank, z)
            a.append(x)
            b.append(y)
        self.size = size
        self.made = np.array([z for _, z in self.merge.values()], np.int64)
        self.ranks = _Hash(np.array(a, np.int64) * size + np.array(b, np.int64), np.arange(len(a)))
        self._trie(parts)
        self._reset()
        special = "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.split = re.compile(f"({special})") if special else None
        self.plain = re.compile(rf"[\x00-\x7f{LATIN}]*").fullmatch
        self.words_plain = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\t-\r {LATIN}0-9]+").findall
        self.assigned: set[str] = set()  # characters met so far that this Python's Unicode knows
        self.path = path

    def _trie(self, parts: dict[int, tuple[int, ...]]) -> None:
        """The trie of all tokens that exact merging leaves whole when they stand alone."""
        made = np.flatnonzero(self.birth >= 0)
        made = made[np.argsort(self.birth[made])]
        whole = np.ones(self.size, bool)
        broken = self.crossed(self.left[made], self.right[made], self.birth[made])
        for t, bad in zip(made.tolist(), broken.tolist()):
            whole[t] = not bad and whole[self.left[t]] and whole[self.right[t]]
        edges: dict[int, int] = {}
        accept = [-1]
        for t, symbols in parts.items():
            if not whole[t]:
                continue
            node = 0
            for s in symbols:
                key = node * 512 + s
                node = edges.get(key, -1)
                if node < 0:
                    node = edges[key] = len(accept)
                    accept.append(-1)
            accept[node] = t
        self.edges = _Hash(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
        self.accept = np.array(accept, np.int64)

    def crossed(self, x: np.ndarray, y: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether some merge fires across the boundary of each pair of tokens.

        Walks back in time from the finished pair: of the two tokens that touch, the later made
        is undone first.  A pair that touches merges if that comes before either is absorbed by
        its own side; of equal ranks the left merge comes first.  ``before``: the rank at which
        the pair itself becomes one token.
        """
        x, y = x.copy(), y.copy()
        until_x = np.full(len(x), NEVER) if before is None else before.copy()
        until_y = until_x.copy()
        bad, left = np.zeros(len(x), bool), np.arange(len(x))
        while len(left):
            p, q = x[left], y[left]
            rank = self.ranks.get(p * self.size + q)
            fires = (rank >= 0) & (rank < until_x[left]) & (rank <= until_y[left])
            if before is not None:
                fires &= rank != before[left]
            bad[left[fires]] = True
            made_p, made_q = self.birth[p], self.birth[q]
            go = ~fires & ((made_p >= 0) | (made_q >= 0))
            left, p, q, made_p, made_q = left[go], p[go], q[go], made_p[go], made_q[go]
            undo = made_p > made_q
            until_x[left[undo]], x[left[undo]] = made_p[undo], self.right[p[undo]]
            until_y[left[~undo]], y[left[~undo]] = made_q[~undo], self.left[q[~undo]]
        return bad

    def merged(self, words: list[np.ndarray]) -> list[np.ndarray]:
        """Exact merging: always a word's pair of lowest rank, the leftmost of equals.

        Each round merges one pair in every word that still has one.
        """
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        short = []
        for n, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[n] = np.array(self._merged_long(self.base[w].tolist()), np.int64)
            else:
                short.append(n)
        if not short:
            return out
        tokens = self.base[np.concatenate([words[n] for n in short])]
        word = np.repeat(np.array(short), [len(words[n]) for n in short])
        while len(tokens):
            pair = np.full(len(tokens), NEVER)
            inner = np.flatnonzero(word[1:] == word[:-1])
            rank = self.ranks.get(tokens[inner] * self.size + tokens[inner + 1])
            pair[inner[rank >= 0]] = rank[rank >= 0]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(pair, first)
            ends = np.append(first[1:], len(tokens))
            done = lowest == NEVER
            for n, i, j in zip(word[first[done]].tolist(), first[done].tolist(), ends[done].tolist()):
                out[n] = tokens[i:j]
            sizes = ends - first
            at = np.flatnonzero((pair == np.repeat(lowest, sizes)) & (pair < NEVER))
            at = at[np.unique(word[at], return_index=True)[1]]
            tokens[at] = self.made[pair[at]]
            keep = np.repeat(~done, sizes)
            keep[at + 1] = False
            tokens, word = tokens[keep], word[keep]
        return out

    def _merged_long(self, tokens: list[int]) -> list[int]:
        """The same for long words, with a heap over a linked list."""
        import heapq

        n = len(tokens)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], tokens[i], tokens[i + 1]) for i in range(n - 1) if (m := self.merge.get((tokens[i], tokens[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, x, y = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != x or j >= n or tokens[j] != y:
                continue
            tokens[i], tokens[j], after[i] = made, -1, after[j]
            if after[j] < n:
                prior[after[j]] = i
            for p, q in ((prior[i], i), (i, after[i])):
                if 0 <= p and q < n and (m := self.merge.get((tokens[p], tokens[q]))):
                    heapq.heappush(heap, (m[0], p, m[1], tokens[p], tokens[q]))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of distinct words, one after another, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        symbols[ends - 1] += 256
        # The longest token from every position on: all walk the trie together until they leave it.
        best, reach = self.base[symbols], np.arange(1, len(symbols) + 1)
        stop = np.repeat(ends, sizes)
        at, node = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
        depth = 0
        while len(at):
            node = self.edges.get(node * 512 + symbols[at + depth]).astype(np.int64)
            depth += 1
            on = node >= 0
            at, node = at[on], node[on]
            token = self.accept[node]
            hit = token >= 0
            best[at[hit]], reach[at[hit]] = token[hit], at[hit] + depth
            on = at + depth < stop[at]
            at, node = at[on], node[on]
        # From each word's start, hop from match to match.
        used = np.zeros(len(symbols), bool)
        here, last = starts.copy(), ends
        while len(here):
            used[here] = True
            here = reach[here]
            on = here < last
            here, last = here[on], last[on]
        places = np.flatnonzero(used)
        tokens = best[places]
        word_of = np.searchsorted(ends, places, side="right")
        inner = np.flatnonzero(word_of[1:] == word_of[:-1])
        pairs, back = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
        bad_pair = self.crossed(pairs // self.size, pairs % self.size)[back]
        counts = np.bincount(word_of, minlength=len(words))
        failing = np.unique(word_of[inner[bad_pair]])
        if not len(failing):
            return tokens, counts
        exact = self.merged([symbols[starts[w] : ends[w]] for w in failing.tolist()])
        counts_new = counts.copy()
        counts_new[failing] = [len(e) for e in exact]
        out = np.empty(int(counts_new.sum()), np.int64)
        first = np.cumsum(counts_new) - counts_new
        fails = np.zeros(len(words), bool)
        fails[failing] = True
        keep = ~fails[word_of]
        rank_in = np.arange(len(tokens)) - (np.cumsum(counts) - counts)[word_of]
        out[(first[word_of] + rank_in)[keep]] = tokens[keep]
        flat = np.concatenate(exact)
        sizes = counts_new[failing]
        out[np.repeat(first[failing], sizes) + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return out, counts_new

    def _reset(self) -> None:
        self.known = _Numbers((b" " + t.encode(), n) for n, t in enumerate(self.special))  # no word has a space
        self.flat = np.array(list(self.special.values()), np.int32)
        self.count = np.ones(len(self.special), np.int64)

    def latin(self, text: str) -> bytes | None:
        """A text in ASCII and LATIN after normalisation, in UTF-8; none of any other or with special tokens."""
        if "<|" in text:
            return None
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")
        lower = text.lower()
        return lower.encode() if lower.isascii() or self.plain(lower) else None

    def words(self, text: str) -> list[str]:
        """The words of a text after normalisation."""
        if text.isascii():
            return self.words_plain(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        lower = text.replace("Σ", "σ").lower()
        if self.plain(lower):
            return self.words_plain(lower)
        new = set(text) - self.assigned
        if any(unicodedata.category(c) == "Cn" for c in new):
            return self._library_words(text)
        self.assigned |= new
        return self.general(lower)

    @functools.cached_property
    def general(self):
        """The matcher of words of any characters that this Python's Unicode assigns."""
        ranges: dict[str, list[str]] = {"L": [], "N": []}
        last, start = "", 0
        for c in range(0x110001):
            kind = unicodedata.category(chr(c)) if c < 0x110000 else ""
            kind = kind[:1] if kind[:1] in ranges else ""
            if kind != last:
                if last:
                    ranges[last].append(f"\\U{start:08x}-\\U{c - 1:08x}")
                last, start = kind, c
        letters, numbers = "".join(ranges["L"]), "".join(ranges["N"])
        return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+").findall

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        return t.normalizer, t.pre_tokenizer, {c: b for b, c in enumerate(_byte_chars())}

    def _library_words(self, text: str) -> list[str]:
        """Words of a text with characters newer than this Python, as the library cuts them."""
        normalizer, cut, byte_of = self.library
        return [bytes(byte_of[c] for c in w).decode() for w, _ in cut.pre_tokenize_str(normalizer.normalize_str(text))]

    def pieces(self, text: str) -> list[bytes]:
        """The words of a text in UTF-8; special tokens stay whole, behind a space."""
        if "<|" not in text or self.split is None:
            return [w.encode() for w in self.words(text)]
        out: list[bytes] = []
        for k, part in enumerate(self.split.split(text)):
            out += [b" " + part.encode()] if k % 2 else [w.encode() for w in self.words(part)]
        return out

    def _encode_slice(self, texts: list[str]) -> list[np.ndarray]:
        raws = [self.latin(t) for t in texts]
        fast, slow = ([n for n, r in enumerate(raws) if (r is None) == none] for none in (False, True))
        out = [np.empty(0, np.int32)] * len(texts)
        for group, cut in ((fast, lambda: latin_words([raws[n] for n in fast])), (slow, lambda: self._words_of_each([texts[n] for n in slow]))):
            if group:
                for n, ids in zip(group, self._looked_up(*cut())):
                    out[n] = ids
        return out

    def _words_of_each(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        words = [self.pieces(t) for t in texts]
        return list(itertools.chain.from_iterable(words)), np.fromiter(map(len, words), np.int64, len(words))

    def _looked_up(self, words: list[bytes], per_text: np.ndarray) -> list[np.ndarray]:
        """The ids of each text, from the table of words; new words are added."""
        if len(self.known) > TABLE_WORDS:
            self._reset()
        base = len(self.known)
        codes = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        if len(self.known) > base:
            new = list(itertools.islice(self.known, base, None))
            found = [self.encode_words(new[a : a + NEW_WORDS]) for a in range(0, len(new), NEW_WORDS)]
            self.flat = np.concatenate([self.flat, *(flat.astype(np.int32) for flat, _ in found)])
            self.count = np.concatenate([self.count, *(count for _, count in found)])
        sizes = self.count[codes]
        firsts = (np.cumsum(self.count) - self.count)[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(firsts - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.cumsum(per_text)]
        return np.split(ids, bounds[:-1])

    def encode_each(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, a slice of texts at a time."""
        part: list[str] = []
        size = 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size >= SLICE_CHARS:
                yield from self._encode_slice(part)
                part, size = [], 0
        if part:
            yield from self._encode_slice(part)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        return list(self.encode_each(texts))

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by spaces, special ones kept: what a file without a decoder defines."""
        return " ".join(self.text[ids].tolist())


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(text: Column | str, path: str) -> Column:
    """The ids (array of int) of a text column."""

    @F.pandas_udf("array<int>")
    def bpe_encode(texts: pd.Series) -> pd.Series:
        out = pd.Series(codec(path).encode(texts.tolist()), index=texts.index, dtype=object)
        release()
        return out

    return bpe_encode(text)


def decode(ids: Column | str, path: str) -> Column:
    """The text of an array of ids; null ids give an empty text."""

    @F.pandas_udf("string")
    def bpe_decode(rows: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series(["" if r is None else c.decode(np.asarray(r, np.int64)) for r in rows], index=rows.index, dtype=object)

    return bpe_decode(ids)


def with_ids(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of its text column added, or put in place of a column of that name."""
    return df.withColumn(ids, encode(F.col(text), path))
