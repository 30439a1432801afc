"""Line dedup by a deletion-neighbourhood join.

A line is its words (A-Z lower-cased, split at white space).  Two lines are near when they are equal
or, if both have at least ``Settings.edit_words`` words, when one insertion, deletion or replacement
of a word turns one into the other.  A line of at least ``least_words`` words, or of fewer that have
``least_bytes`` bytes together, goes when an earlier line (by document id, then place) of any document
is near; the earliest of all stays.

1. Equal lines meet on their hash; the earliest stands for them.
2. A pair that one edit tells apart shares the first or the second half of its words.  Lines that
   share no half with another line have no partner and emit no variants; a bounded bit map tells them.
3. The others emit the hash of every variant with one word deleted, and of themselves.  Lines meet
   that have the same variant with the word gone from the same place (a replacement), or of which one
   is a variant of the other (a deletion or insertion).  Each meeting keeps the least position only,
   so that a group of any size costs one row for each variant, not one for each pair.
4. The pairs so found are verified on their words; then texts are rebuilt from the lines that stay.

Defined results: a null text stays null, an empty one empty; a text whose lines all go becomes
empty, and its row stays; empty lines and short lines stay; rows with a null id are kept as they are
and take no part; rows that share an id are cleaned alike; very long texts and lines are taken whole;
other columns are kept, whatever their names, but ``counts`` replaces columns of its own names; an empty
table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dropletry.llm.marks import bit_map, is_marked, map_bits, marked
from dropletry.llm.shingles import mixed, slices, word_hashes
from dropletry.llm.tables import checkpointed, free_name, release


@dataclass(frozen=True)
class Settings:
    """least_words, least_bytes: of a line that may go, one or the other; edit_words: from which one edit
    is allowed; salts: parts that the copies of one line are spread over."""

    least_words: int = 2
    least_bytes: int = 24
    edit_words: int = 8
    salts: int = 8


_FACTORS = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_MASK = 0xFFFFFFFFFFFFFFFF


class Lines:
    """The lines of some texts that have words: their hashes and those of their parts.

    A sequence of words w0, w1, ... has the hash of w0 + w1 r + w2 r^2 + ... and of its length, so
    that running sums give the hash of every part and of every variant with a part left out.
    """

    def __init__(self, raws: list[bytes], s: Settings):
        words, starts, offsets = word_hashes(raws)
        data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        feeds = np.flatnonzero(data == 10)
        line = np.searchsorted(feeds, starts)  # of each word: the line feeds before it
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(line)))
        text = np.searchsorted(offsets, starts[first], side="right") - 1
        self.number = line[first] - np.searchsorted(feeds, offsets[:-1])[text]
        keep = n >= s.least_words
        few = np.flatnonzero(~keep)
        begins = np.concatenate([[0], feeds + 1])[line[first[few]]]
        keep[few] = [sum(map(len, data[a:b].tobytes().split())) >= s.least_bytes for a, b in zip(begins.tolist(), feeds[line[first[few]]].tolist())]
        self.first, self.n, self.text, self.number = first[keep], n[keep], text[keep], self.number[keep]
        self.words, self.longest = words, int(n.max()) + 1 if len(n) else 1
        self.place = np.arange(len(line)) - np.repeat(first, n)
        self.sums = self.running(0)
        self.backs = self._powers(pow(_FACTORS[0], -1, 1 << 64))

    def _powers(self, f: int) -> np.ndarray:
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, np.uint64(f))]))

    def running(self, which: int) -> np.ndarray:
        """The running sums over all words by one of the factors."""
        return np.concatenate([[np.uint64(0)], np.cumsum(self.words * self._powers(_FACTORS[which])[self.place])])

    @staticmethod
    def _key(value: np.ndarray, length: np.ndarray, salt: int = 0) -> np.ndarray:
        return mixed(value + (length.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def whole(self, which: int = 0) -> np.ndarray:
        sums = self.sums if which == 0 else self.running(which)
        return self._key(sums[self.first + self.n] - sums[self.first], self.n)

    def halves(self, edit_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(line, key) of the parts of which a pair one edit apart shares one.

        Of n words the first n // 2 or the last; against a line with one word less, (n - 1) // 2.
        """
        s, lines, keys = self.sums, [], []
        at = np.flatnonzero(self.n >= edit_words)
        first, n = self.first[at], self.n[at]
        for length, use in ((n // 2, n > 0), ((n - 1) // 2, n % 2 == 0)):
            head = s[first + length] - s[first]
            tail = (s[first + n] - s[first + n - length]) * self.backs[n - length]
            lines += [at[use], at[use]]
            keys += [self._key(head, length, 1 << 40)[use], self._key(tail, length, 1 << 41)[use]]
        return np.concatenate(lines), np.concatenate(keys)

    def variants(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, place, key) of each variant with the word at ``place`` deleted."""
        s, n, first = self.sums, self.n[lines], self.first[lines]
        of = np.repeat(np.arange(len(lines)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = first[of] + place
        value = (s[at] - s[first[of]]) + (s[(first + n)[of]] - s[at + 1]) * self.backs[1]
        return lines[of], place, self._key(value, n[of] - 1)


def _over_lines(docs: DataFrame, s: Settings, make: Callable[[np.ndarray, Lines], dict], schema: str) -> DataFrame:
    """What ``make`` gives for the lines of each slice of texts and their documents' ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, at = batch["id"].to_numpy(), 0
            for raws in slices(batch["text"].tolist()):
                lines = Lines(raws, s)
                yield pd.DataFrame(make(ids[at : at + len(raws)][lines.text], lines))
                at += len(raws)
            release()

    return docs.mapInPandas(run, schema)


def near_lines(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """All lines (id, number, a, b: hashes) and, of the distinct ones with an earlier near line, (a, b)."""
    spark = docs.sparkSession

    def describe(ids: np.ndarray, x: Lines) -> dict:
        return {"id": ids, "number": x.number, "a": x.whole(0), "b": x.whole(1)}

    def halve(ids: np.ndarray, x: Lines) -> dict:
        line, key = x.halves(s.edit_words)
        a = x.whole(0)[line]
        order = np.lexsort((a, key))
        key, a = key[order], a[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1])
        return {"half": key[new], "a": a[new]}

    lines = checkpointed(_over_lines(docs, s, describe, "id long, number int, a long, b long"))
    bits = map_bits(lines.count())
    shared = _over_lines(docs, s, halve, "half long, a long").groupBy("half").agg(F.min("a").alias("x"), F.max("a").alias("y")).where("x <> y")
    wanted = spark.sparkContext.broadcast(bit_map(shared, F.col("half"), bits))

    def emit(ids: np.ndarray, x: Lines) -> dict:
        a = x.whole(0)
        line, key = x.halves(s.edit_words)
        at = np.unique(line[marked(wanted.value, key % bits)])
        # Equal lines of a slice send one row: that of the least id, of equal ids the first.
        at = at[np.lexsort((x.number[at], ids[at]))]
        at = at[np.unique(a[at], return_index=True)[1]]
        line, place, key = x.variants(at)
        line, place, key = np.concatenate([line, at]), np.concatenate([place, np.full(len(at), -1)]), np.concatenate([key, a[at]])
        return {"key": key, "place": place.astype(np.int32), "id": ids[line], "number": x.number[line].astype(np.int32), "a": a[line]}

    rows = _over_lines(docs, s, emit, "key long, place int, id long, number int, a long").withColumn("p", F.struct("id", "number", "a"))
    # Variants that one distinct line alone has are met by no other.
    of_key, of_place = Window.partitionBy("key"), Window.partitionBy("key", "place")
    met = rows.withColumns({"x": F.min("a").over(of_key), "y": F.max("a").over(of_key)}).where("x <> y")
    met = met.withColumns({
        "self": F.min(F.when(F.col("place") < 0, F.col("p"))).over(of_key), "less": F.min(F.when(F.col("place") >= 0, F.col("p"))).over(of_key), "like": F.min("p").over(of_place),
    })
    witness = F.when(F.col("place") < 0, F.least("like", "less")).otherwise(F.least("like", "self"))
    found = met.groupBy("a").agg(F.min(F.struct("id", "number")).alias("own"), F.min(witness).alias("w"))
    pairs = checkpointed(found.where((F.col("w.a") != F.col("a")) & (F.struct("w.id", "w.number") < F.col("own"))).select("own", F.struct("w.id", "w.number").alias("other")))
    return lines, _verified(docs, pairs, s).join(lines, ["id", "number"]).select("a", "b").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """(id, number) of each pair's own line, where its words are within one edit of the other's."""
    place = F.struct(F.col("id"), F.col("number"))
    ends = pairs.select(F.col("own").alias("p")).unionByName(pairs.select(F.col("other").alias("p"))).select("p.id", "p.number")
    bits = map_bits(2 * pairs.count())
    needed = docs.sparkSession.sparkContext.broadcast(bit_map(ends, F.xxhash64("id"), bits))
    texts = docs.where(is_marked(needed, F.xxhash64("id"), bits)).select("id", F.posexplode(F.split("text", "\n")).alias("number", "line"))
    texts = texts.select("id", "number", "line").join(ends.distinct(), ["id", "number"], "left_semi").dropDuplicates(["id", "number"]).select(place.alias("p"), "line")

    @F.pandas_udf("boolean")
    def within_one(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one_edit(x, y) for x, y in zip(a, b)], index=a.index)

    both = pairs.join(texts.withColumnsRenamed({"p": "own", "line": "x"}), "own").join(texts.withColumnsRenamed({"p": "other", "line": "y"}), "other")
    return both.where(within_one("x", "y")).select("own.id", "own.number")


def line_words(line: str) -> list[bytes]:
    return [w.lower() for w in line.encode().split()]


def one_edit(a: str, b: str) -> bool:
    """Whether at most one insertion, deletion or replacement of a word turns one line into the other."""
    x, y = line_words(a), line_words(b)
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    k = 0
    while k < len(x) and x[k] == y[k]:
        k += 1
    return x[k + (len(x) == len(y)) :] == y[k + 1 :]


def dropped_lines(docs: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, number) of the lines that go; numbers count from 0."""
    s = settings or Settings()
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    lines, near = near_lines(docs, s)
    earliest = lines.groupBy("a", "b").agg(F.min(F.struct("id", "number")).alias("first"), F.count("*").alias("n"))
    judged = earliest.join(near.withColumn("near", F.lit(True)), ["a", "b"], "left").where("n > 1 or near")
    # One line may be a third of all: its copies and its judgement are dealt over the salts.
    judged = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(s.salts)).cast("int"))
    found = salted.join(judged, ["a", "b", "salt"]).where(F.col("near").isNotNull() | (F.struct("id", "number") != F.col("first")))
    return found.select("id", "number").distinct()


def dedup(df: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """``df`` with its texts less the lines that go; ``counts`` adds n_lines and n_dropped."""
    own_id, numbers = free_name(df, "_id"), free_name(df, "_gone")
    gone = dropped_lines(df, settings, key, text).groupBy("id").agg(F.collect_list("number").alias(numbers)).withColumnRenamed("id", own_id)

    @F.pandas_udf("string")
    def without(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for t, g in zip(texts, numbers):
            if t is not None and g is not None:
                g = set(g.tolist())
                t = "\n".join(line for k, line in enumerate(t.split("\n")) if k not in g)
            out.append(t)
        return pd.Series(out, index=texts.index, dtype=object)

    both = df.join(gone, df[key].cast("long") == gone[own_id], "left")
    columns = {c: F.col(f"`{c}`") for c in df.columns} | {text: without(text, numbers).alias(text)}
    if counts:
        columns |= {"n_lines": F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"), "n_dropped": F.coalesce(F.size(numbers), F.lit(0)).cast("long").alias("n_dropped")}
    return both.select(*columns.values())
