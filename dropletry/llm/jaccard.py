"""Exact Jaccard join of documents over word shingles, through a token-group matrix.

1. Documents with equal shingle sets form a class; only classes are compared.
2. Each class has a prefix: its rarest shingles, so many that two classes at the threshold must share
   one.  Frequent shingles are found by counting in every slice of every task; they only order the
   shingles, so that the result does not depend on the counts.
3. Similar classes are put in one group: those that share their rarest shingle or, when most of their
   shingles are frequent, their least frequent-shingle hash.  The token-group matrix has a row for
   each shingle of the union of a group's prefixes.
4. A class qualifies for a group when it shares a row with it and their sizes allow the threshold.
   It is compared with the leader (earliest document) of each group that it qualifies for, and links
   become components.
5. Groups that still hold classes of other components than a qualifying class are opened in blocks:
   of a block's pairs, only those of different components are compared, and only those come out that
   can reach the threshold.
6. Comparisons first use bitmaps with some bits for each shingle: a set bit that the other lacks is a
   shingle that the other lacks.  Pairs that still can reach the threshold are verified on whole sets.

A large group of near copies costs one comparison for each copy, not one for each pair.  No candidate
is dropped: what step 5 leaves out already is in one component.

Defined results: texts that are null or have no words have no shingles and link with nothing; rows
with a null id are left out; of repeated ids each row is returned; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dropletry.llm.components import components
from dropletry.llm.marks import bit_map, is_marked, map_bits
from dropletry.llm.shingles import set_key, shingle_sets
from dropletry.llm.tables import checkpointed, release


@dataclass(frozen=True)
class Settings:
    """width: words of a shingle; percent: least similarity; frequent: count from which a shingle is
    ordered by its count; table: most frequent shingles that are broadcast (they only order);
    bits: of a bitmap for each shingle, at least; members, visitors: classes of a group, and classes that
    qualify for it, that are compared in one block; salts: parts that the rows of a frequent shingle, and
    those that meet a group's leader, are spread over; slice_tokens: shingles held by a task at a time."""

    width: int = 5
    percent: int = 80
    frequent: int = 16
    table: int = 300_000
    bits: int = 4
    members: int = 512
    visitors: int = 2048
    salts: int = 32
    slice_tokens: int = 3_000_000


def least_overlap(size: np.ndarray | int, percent: int):
    """Shingles of a set of this size that it must share with any set at the threshold."""
    return -(-size * percent // 100)


def bitmap(shingles: np.ndarray, per_shingle: int) -> bytes:
    """Bits at the shingles' low bits; its size is a power of two of bytes, so that larger maps fold."""
    size = 1 << max(3, int(per_shingle * len(shingles) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[shingles & (size - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_overlap(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """At most so many shingles are common to sets with these bitmaps and sizes."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(nx - int(np.bitwise_count(a & ~b).sum()), ny - int(np.bitwise_count(b & ~a).sum()))


def _classes_and_counts(docs: DataFrame, s: Settings) -> DataFrame:
    """A row (id, size, class, check, map) for each document (the map once for equal sets of a batch); rows (token, n) for shingles that repeat in a slice."""

    def repeated(tokens: list[np.ndarray]) -> pd.DataFrame:
        flat = np.concatenate(tokens)
        flat.sort()
        at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, int)
        n = np.diff(np.append(at, len(flat)))
        return pd.DataFrame({"id": None, "size": None, "class": None, "check": None, "map": None, "token": flat[at[n > 1]], "n": n[n > 1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, held = [], 0
        for batch in batches:
            ids, keys, checks, sizes, maps, seen = [], [], [], [], [], set()
            for i, shingles in zip(batch["id"].tolist(), shingle_sets(batch["text"].tolist(), s.width)):
                key = set_key(shingles)
                ids.append(i)
                keys.append(key[0])
                checks.append(key[1])
                sizes.append(len(shingles))
                maps.append(None)
                if key not in seen:
                    seen.add(key)
                    tokens.append(shingles)
                    maps[-1] = bitmap(shingles, s.bits)
                    held += len(shingles)
                    if held > s.slice_tokens:
                        yield repeated(tokens)
                        tokens, held = [], 0
            yield pd.DataFrame({"id": ids, "size": sizes, "class": keys, "check": checks, "map": maps, "token": None, "n": None})
            release()
        if tokens:
            yield repeated(tokens)

    return docs.mapInPandas(run, "id long, size long, class long, check long, map binary, token long, n long")


def _prefixes(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], s: Settings) -> DataFrame:
    """Rows (token, class, size, group, part) for the shingles in each class's prefix, once a batch; part: 0
    but for the rows of frequent shingles, which it spreads."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot_tokens, hot_counts = shared.value

        def frame(out: list[np.ndarray], keys: list, sizes: list, groups: list, parts: list[np.ndarray]) -> pd.DataFrame:
            n = [len(p) for p in out]
            return pd.DataFrame({"token": np.concatenate(out), "class": np.repeat(keys, n), "size": np.repeat(sizes, n).astype(np.int32), "group": np.repeat(groups, n), "part": np.concatenate(parts)})

        for batch in batches:
            out, keys, sizes, groups, parts, held, done = [], [], [], [], [], 0, set()
            for shingles in shingle_sets(batch["text"].tolist(), s.width):
                if not len(shingles) or (key := set_key(shingles)) in done:
                    continue
                if held > s.slice_tokens // 4:
                    yield frame(out, keys, sizes, groups, parts)
                    out, keys, sizes, groups, parts, held = [], [], [], [], [], 0
                done.add(key)
                size = len(shingles)
                at = np.minimum(np.searchsorted(hot_tokens, shingles), max(0, len(hot_tokens) - 1))
                count = np.where(hot_tokens[at] == shingles, hot_counts[at], 0) if len(hot_tokens) else np.zeros(size, np.int64)
                order = np.lexsort((shingles, count))[: size - least_overlap(size, s.percent) + 1]
                prefix = shingles[order]
                common = shingles[count > 0]
                out.append(prefix)
                keys.append(key[0])
                sizes.append(size)
                groups.append(common[0] if 2 * len(common) >= size else prefix[0])
                parts.append(np.where(count[order] > 0, 1 + key[0] % s.salts, 0).astype(np.int32))
                held += len(prefix)
            if out:
                yield frame(out, keys, sizes, groups, parts)
            release()

    return docs.mapInPandas(run, "token long, class long, size int, group long, part int")


def _sets(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """(id, shingles) of the documents in ``wanted`` and, by the map's chance hits, a few others."""
    bits = map_bits(wanted.count())
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(wanted, F.xxhash64("id"), bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "shingles": list(shingle_sets(batch["text"].tolist(), s.width))})
            release()

    return docs.where(is_marked(shared, F.xxhash64("id"), bits)).mapInPandas(run, "id long, shingles array<long>")


def _possible(pairs: DataFrame, maps: DataFrame, s: Settings) -> DataFrame:
    """The pairs (u, v) that their bitmaps do not rule out."""

    @F.pandas_udf("boolean")
    def can_link(x: pd.Series, nx: pd.Series, y: pd.Series, ny: pd.Series) -> pd.Series:
        return pd.Series([(100 + s.percent) * most_overlap(a, na, b, nb) >= s.percent * (na + nb) for a, na, b, nb in zip(x, nx, y, ny)], index=x.index)

    a, b = maps.toDF("u", "x", "nx"), maps.toDF("v", "y", "ny")
    return pairs.join(a, "u").join(b, "v").where(can_link("x", "nx", "y", "ny")).select("u", "v")


def _links(pairs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """The pairs (u, v) whose whole sets reach the threshold."""
    sets = _sets(docs, pairs.select(F.explode(F.array("u", "v")).alias("id")), s).dropDuplicates(["id"])
    a, b = sets.toDF("u", "su"), sets.toDF("v", "sv")
    common = F.size(F.array_intersect("su", "sv"))
    return pairs.join(a, "u").join(b, "v").where(100 * common >= s.percent * (F.size("su") + F.size("sv") - common)).select("u", "v")


def open_room(visitors: list[tuple], members: list[tuple], s: Settings) -> list[tuple[int, int]]:
    """Pairs of a visitor and a member, (id, component, size, bitmap) each, of different components
    that their bitmaps do not rule out."""
    found = []
    by_width: dict[int, list[tuple]] = {}
    for m in members:
        by_width.setdefault(len(m[3]), []).append(m)
    for width, group in by_width.items():
        theirs = np.frombuffer(b"".join(m[3] for m in group), np.uint8).reshape(len(group), width)
        ids, components, sizes = (np.array([m[k] for m in group]) for k in range(3))
        for i, c, n, raw in visitors:
            bits, others = np.frombuffer(raw, np.uint8), theirs
            while len(bits) > width:
                bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
            while others.shape[1] > len(bits):
                others = others[:, : others.shape[1] // 2] | others[:, others.shape[1] // 2 :]
            most = np.minimum(n - np.bitwise_count(bits & ~others).sum(axis=1, dtype=np.int64), sizes - np.bitwise_count(others & ~bits).sum(axis=1, dtype=np.int64))
            hit = (components != c) & ((100 + s.percent) * most >= s.percent * (n + sizes))
            found += [(min(i, j), max(i, j)) for j in ids[hit].tolist()]
    return found


def _opened(rows: DataFrame, qualifying: DataFrame, maps: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """The pairs (u, v) that opening groups leaves to verify, beyond the components ``found``."""
    home = rows.select("group", "rep").distinct().join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    home = checkpointed(home.join(maps, "rep"))
    groups = home.groupBy("group").agg(F.count("*").alias("n"), F.min("component").alias("a"), F.max("component").alias("b")).where("n > 1")
    visits = qualifying.select("rep", "group").join(groups, "group").join(home.select("rep", "component"), "rep").where("a <> b or component <> a")
    visits = checkpointed(visits.select("group", "rep", "component", "n"))
    rooms = visits.groupBy("group").agg(F.count("*").alias("v"), F.first("n").alias("n"))
    rooms = rooms.select("group", F.ceil(F.col("n") / s.members).cast("int").alias("m_blocks"), F.ceil(F.col("v") / s.visitors).cast("int").alias("v_blocks"))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    come = visits.select("group", "rep", "component").join(rooms, "group").withColumn("v_block", block("v_blocks")).withColumn("m_block", every("m_blocks")).join(maps, "rep")
    stay = home.join(rooms, "group").withColumn("m_block", block("m_blocks")).withColumn("v_block", every("v_blocks"))

    def compare(visitors: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        as_rows = lambda x: list(zip(*(x.iloc[:, k].tolist() for k in range(3, 7))))
        return pd.DataFrame(open_room(as_rows(visitors), as_rows(members), s), columns=["u", "v"], dtype="int64")

    room = ["group", "m_block", "v_block"]
    columns = [*room, "rep", "component", "size", "map"]
    stay = stay.select(columns).toDF(*(f"{c}_" for c in columns))
    return come.select(columns).groupBy(*room).cogroup(stay.groupBy(*(f"{c}_" for c in room))).applyInPandas(compare, "u long, v long").distinct()


def classes(docs: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, class, component) for every document with an id; component: the smallest linked id."""
    s = settings or Settings()
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    first = checkpointed(_classes_and_counts(docs, s))
    members = first.where("id is not null").select("id", "size", "class", "check")
    # Different sets may share a class by chance: each is one of its own there.
    earliest = checkpointed(members.where("size > 0").groupBy("class", "check").agg(F.min("id").alias("rep")))
    hot = first.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= s.frequent).orderBy(F.desc("n"), "token").limit(s.table).toArrow()
    tokens, counts = hot["token"].to_numpy(), hot["n"].to_numpy()
    order = np.argsort(tokens)
    rows = _prefixes(docs, (tokens[order], counts[order]), s)
    # Shingles of one class alone match nothing.  Frequent ones are shared, so that their rows need not meet.
    of_token = Window.partitionBy("token", "part")
    shared = rows.withColumns({"a": F.min("class").over(of_token), "b": F.max("class").over(of_token)}).where("part > 0 or a <> b").drop("a", "b", "part").distinct()
    rows = checkpointed(shared.join(earliest, "class").select("token", "class", "check", "rep", "size", "group"))
    matrix = rows.groupBy("token", "group").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    fits = lambda a, b: (100 * F.col(a) >= s.percent * F.col(b))
    qualifying = rows.select("token", "rep", "size").join(matrix, "token").where(fits("most", "size") & fits("size", "least")).select("rep", "size", "group").distinct()
    qualifying = checkpointed(qualifying)
    leaders = rows.groupBy("group").agg(F.min(F.struct("rep", "size")).alias("l")).select("group", F.col("l.rep").alias("leader"), F.col("l.size").alias("leader_size"))
    # A group may hold a third of all classes: both sides are dealt over the salts.
    everywhere = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))))
    salted = qualifying.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(s.salts)).cast("int"))
    opened = salted.join(everywhere, ["group", "salt"]).where(fits("leader_size", "size") & fits("size", "leader_size") & (F.col("leader") != F.col("rep")))
    pairs = checkpointed(opened.select(F.least("rep", "leader").alias("u"), F.greatest("rep", "leader").alias("v")).distinct())
    maps = first.where("map is not null").join(rows.select("class", "check", "rep").distinct(), ["class", "check"]).dropDuplicates(["rep"]).select("rep", "map", "size")
    maps = checkpointed(maps)
    links = checkpointed(_links(checkpointed(_possible(pairs, maps, s)), docs, s))
    found = components(links)
    more = _links(checkpointed(_opened(rows, qualifying, maps, found, s)), docs, s)
    found = checkpointed(components(links.unionByName(more)))
    of_class = earliest.join(found, earliest["rep"] == found["node"], "left").select("class", "check", F.coalesce("component", "rep").alias("component"))
    return members.join(of_class, ["class", "check"], "left").select("id", "size", "class", F.coalesce("component", "id").alias("component"))


def first_of_each(docs: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the earliest of their component, or have a null id; columns as before."""
    kept = classes(docs, settings, key, text).where("id = component").select(F.col("id").alias(key)).distinct()
    return docs.join(kept, key, "left_semi").unionByName(docs.where(F.col(key).isNull())).select(docs.columns)
