"""A Merkle manifest of a dataset: one tree for each group of rows, and one over the groups' tops.

Leaves are put in order and numbered in ranges.  A task walks its range with a mountain-range stack: a
leaf is pushed, and as often as the last ``fanout`` entries are a whole run of siblings they carry into
their parent.  What stays on the stack are the peaks of the range: the nodes that its leaves complete, few
at either edge, wherever the range happens to begin.  Peaks of neighbouring ranges meet ``join`` ranges at a
time, on a stack again, until one stack holds a whole group; that one closes the short runs on its right
edge, without padding: a run of fewer nodes, even of one, is hashed as it is.  A group that lies within one
range is closed there.  The tops of the groups are the leaves of one more tree of the same kind.

Proofs come down the same way.  A stack that carries knows the siblings of all it has consumed, so each
merge turns the paths of the nodes it made into the paths of the nodes it was given, and each range those
into the paths of its leaves.  Only peaks and their paths are shuffled, never whole levels; a few numbers
for each range come to the driver.

Defined results: a null group is a group of its own, before all others; rows with a null key come first in
their group; rows that share a key stand in the order of their digests, and wholly equal rows are a leaf
each; the only row of a group is that group's top, and the only group's top is the root; an empty table has
no root and no proofs; columns that aren't asked for are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.llm.tables import checkpointed

Path = tuple[tuple[str, str], ...]
PATH = "left array<string>, right array<string>"


@dataclass(frozen=True)
class Settings:
    """fanout: children of a node; rows: leaves of a range at most, about; join: ranges that meet in a task."""

    fanout: int = 3
    rows: int = 65536
    join: int = 32


def digest(texts: list[str]) -> str:
    return sha256("".join(texts).encode()).hexdigest()


def row_digest(fields: list[str]) -> Column:
    """The digest of a row: each field as its length in bytes, a colon and its text, or a dash for null."""
    parts = []
    for name in fields:
        text = F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


class Stack:
    """The peaks of consecutive nodes of one tree; ``up`` has the siblings of every node it consumed, ``made``
    the nodes it made."""

    def __init__(self, fanout: int) -> None:
        self.fanout, self.peaks, self.up, self.made = fanout, [], {}, []

    def parent(self, run: list[tuple[int, int, str]]) -> tuple[int, int, str]:
        texts = [d for _, _, d in run]
        for k, (level, place, _) in enumerate(run):
            self.up[level, place] = ("".join(texts[:k]), "".join(texts[k + 1 :]))
        out = (run[0][0] + 1, run[0][1] // self.fanout, digest(texts))
        self.made.append(out)
        return out

    def push(self, level: int, place: int, text: str) -> None:
        n, peaks = self.fanout, self.peaks
        peaks.append((level, place, text))
        while peaks[-1][1] % n == n - 1 and len(peaks) >= n and peaks[-n][:2] == (peaks[-1][0], peaks[-1][1] - n + 1):
            peaks[-n:] = [self.parent(peaks[-n:])]

    def close(self) -> tuple[int, int, str]:
        """The top of a tree whose nodes have all been pushed, from place 0 on."""
        level, place, _ = self.peaks[-1]
        left, short, level = (place + 1) * self.fanout**level, [], 0
        while left > 1:
            run = [x for x in self.peaks if x[0] == level] + short
            short = [self.parent(run)] if run else []
            left, level = -(-left // self.fanout), level + 1
        self.peaks = short or self.peaks
        return self.peaks[0]

    def path(self, level: int, place: int, above: Callable[[int, int], Path], known: dict) -> Path:
        """The siblings of a node and of all nodes over it; ``above`` tells those of a peak."""
        if (found := known.get((level, place))) is None:
            own = self.up.get((level, place))
            found = known[level, place] = above(level, place) if own is None else (own, *self.path(level + 1, place // self.fanout, above, known))
        return found


@dataclass(frozen=True)
class Span:
    """What a range must know: the place of its first leaf in that leaf's group, the ranges in which its first
    and its last group begin, and whether its last group goes on."""

    start: int
    first: int
    last: int
    more: bool


@dataclass(frozen=True)
class Tree:
    """leaves: ranged rows (range, inside, group, leaf and what the caller carries); rounds: the open peaks of
    each merge (range, home, level, place, digest, group); tops: (range, home, group, leaf), home below 0 where
    a range closed a group, else the range in which the group begins."""

    settings: Settings
    leaves: DataFrame
    spans: dict[int, Span]
    rounds: list[DataFrame]
    tops: DataFrame


def _segments(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
    """(range, first row, end) of the stretches of equal range and group."""
    ranges, groups = rows.column("range").to_pylist(), rows.column("group").to_pylist()
    a = 0
    for b in range(1, len(ranges) + 1):
        if b == len(ranges) or ranges[b] != ranges[a] or groups[b] != groups[a]:
            yield ranges[a], a, b
            a = b


NODE = ["range", "home", "level", "place", "digest"]


def _table(rows: list[tuple], groups: list, kind: pa.DataType, names: list[str] = NODE) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in names]
    types = {"digest": pa.string(), "level": pa.int32(), "top": pa.string(), "left": pa.list_(pa.string()), "right": pa.list_(pa.string())}
    arrays = [pa.array(c, types.get(n, pa.int64())) for n, c in zip(names, columns)]
    return pa.RecordBatch.from_arrays([*arrays, *([pa.array(groups, kind)] if groups is not None else [])], names=[*names, *(["group"] if groups is not None else [])])


def _walk(spans: dict[int, Span], fanout: int, inner: bool) -> Callable:
    """Ranges of leaves in, their open peaks (level 0 or more) and closed tops (level -1) out; or, if asked, all
    nodes that they make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack, row = None, None, 0  # of the stretch that a batch may end within
        kind = None

        def flush(ended: bool) -> pa.RecordBatch:
            r, group, begin, home, offset = now
            goes_on = ended and spans[r].more
            nodes = list(stack.made)
            if home < 0 and not goes_on:
                top = stack.close()[2]
                out = [(r, -1 - begin, -1, 0, top)]
                nodes = stack.made
            else:
                out = [(r, home if home >= 0 else r, level, place, text) for level, place, text in stack.peaks]
            if inner:
                out = [(r, 0, *x) for x in nodes]
            return _table(out, [group] * len(out), kind)

        for batch in batches:
            kind = batch.schema.field("group").type
            leaves = batch.column("leaf").to_pylist()
            groups = batch.column("group").to_pylist()
            for r, a, b in _segments(batch):
                if now is None or now[0] != r or now[1] != groups[a]:
                    if now is not None:
                        yield flush(now[0] != r)
                    if now is None or now[0] != r:
                        row = 0
                    head = row == 0 and spans[r].start > 0
                    now = (r, groups[a], row, spans[r].first if head else -1, spans[r].start if head else 0)
                    stack = Stack(fanout)
                for k in range(a, b):
                    stack.push(0, now[4] + row - now[2], leaves[k])
                    row += 1
        if now is not None:
            yield flush(True)

    return run


def _merge(fanout: int, last: bool, inner: bool = False) -> Callable[[pa.Table], pa.Table]:
    """Peaks of neighbouring ranges in, the peaks of all together out; the last merge gives the top."""

    def run(rows: pa.Table) -> pa.Table:
        nodes = sorted(rows.select(NODE).to_pylist(), key=lambda x: x["place"] * fanout ** x["level"])
        stack, at = Stack(fanout), (nodes[0]["range"], nodes[0]["home"])
        for x in nodes:
            stack.push(x["level"], x["place"], x["digest"])
        out = [(*at, -1, 0, stack.close()[2])] if last else [(*at, *x) for x in stack.peaks]
        if inner:
            out = [(*at, *x) for x in stack.made]
        return pa.Table.from_batches([_table(out, [rows["group"][0].as_py()] * len(out), rows.schema.field("group").type)])

    return run


def _spans(ranged: DataFrame) -> dict[int, Span]:
    """One for each range, from the sizes of its first and its last group."""
    sizes = ranged.groupBy("range", "group").agg(F.count("*").alias("n"), F.min("inside").alias("begin"))
    ends = sizes.groupBy("range").agg(F.count("*").alias("groups"), *(f(F.struct("group", "n"), "begin").alias(n) for f, n in ((F.min_by, "first"), (F.max_by, "last"))))
    rows = {r["range"]: r for r in ends.collect()}
    spans, before = {}, None  # before: range, group and size so far of the last group
    for r in sorted(rows):
        x = rows[r]
        goes_on = before is not None and before[1] == x["first"]["group"]
        start, home = (before[2], before[3]) if goes_on else (0, r)
        if goes_on:
            spans[before[0]] = Span(spans[before[0]].start, spans[before[0]].first, spans[before[0]].last, True)
        alone = x["groups"] == 1
        spans[r] = Span(start, home, home if alone else r, False)
        before = (r, x["last"]["group"], x["last"]["n"] + (start if alone else 0), home if alone else r)
    return spans


def grow(leaves: DataFrame, order: list[str], settings: Settings) -> Tree:
    """The trees of rows (group, leaf and others), in each group by ``order``."""
    s, spark = settings, leaves.sparkSession
    rows = leaves.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 1024), -(-rows // s.rows))
    # Wholly equal rows may be many; a number of their own lets them be dealt out too.
    by = ["group", *order, "leaf", "copy"]
    ranged = leaves.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = checkpointed(ranged.withColumns({"range": F.spark_partition_id().cast("long"), "inside": inside}).drop("copy"))
    spans = _spans(ranged)
    kind = dict(leaves.dtypes)["group"]
    schema = f"range long, home long, level int, place long, digest string, group {kind}"
    walked = checkpointed(ranged.select("range", "inside", "group", "leaf").sortWithinPartitions("range", "inside").drop("inside").mapInArrow(_walk(spans, s.fanout, False), schema))
    top = lambda df: df.where("level < 0").select("range", "home", "group", F.col("digest").alias("leaf"))
    tops, rounds = top(walked), []
    if any(x.more for x in spans.values()):
        nodes, width = walked.where("level >= 0"), s.join
        while True:
            rounds.append(nodes)
            last = width >= max(spans) + 1
            nodes = checkpointed(nodes.groupBy("home", F.expr(f"range div {width}")).applyInArrow(_merge(s.fanout, last), schema))
            if last:
                break
            width *= s.join
        tops = tops.unionByName(top(nodes))
    return Tree(s, ranged, spans, rounds, tops)


def nodes(tree: Tree) -> DataFrame:
    """(group, level, place, digest) of every node over the leaves: the records of a manifest to be kept."""
    s, kind = tree.settings, dict(tree.leaves.dtypes)["group"]
    schema = f"range long, home long, level int, place long, digest string, group {kind}"
    out = tree.leaves.select("range", "inside", "group", "leaf").sortWithinPartitions("range", "inside").drop("inside").mapInArrow(_walk(tree.spans, s.fanout, True), schema)
    for k, peaks in enumerate(tree.rounds):
        out = out.unionByName(peaks.groupBy("home", F.expr(f"range div {s.join ** (k + 1)}")).applyInArrow(_merge(s.fanout, k + 1 == len(tree.rounds), True), schema))
    return out.select("group", "level", "place", "digest")


def _down(fanout: int, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The paths of the nodes that a merge was given, from those of the nodes it made."""

    def run(rows: pa.Table, made: pa.Table) -> pa.Table:
        given = sorted(rows.select(NODE).to_pylist(), key=lambda x: x["place"] * fanout ** x["level"])
        paths = {(x["level"], x["place"]): x for x in made.select(["level", "place", "left", "right", "top"]).to_pylist()}
        stack, out, known = Stack(fanout), [], {}
        for x in given:
            stack.push(x["level"], x["place"], x["digest"])
        if last:
            level, place, _ = stack.close()
            paths = {(level, place): paths[-1, 0]}
        text = next(iter(paths.values()))["top"]
        above = lambda level, place: tuple(zip(paths[level, place]["left"], paths[level, place]["right"]))
        for x in given:
            path = stack.path(x["level"], x["place"], above, known)
            out.append((x["range"], x["home"], x["level"], x["place"], [a for a, _ in path], [b for _, b in path], text))
        return pa.Table.from_batches([_table(out, None, pa.null(), ["range", "home", "level", "place", "left", "right", "top"])])

    return run


def _finish(spans: dict[int, Span], fanout: int, root: str | None, carried: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The leaves of a range with their proofs.  Without a root, the paths themselves come out."""

    def run(rows: pa.Table, paths: pa.Table) -> pa.Table:
        rows = rows.sort_by("inside")
        leaves, claims = rows["leaf"].to_pylist(), rows["claim"].to_pylist()
        tops, given = {}, {}
        for x in paths.to_pylist():
            given[x["home"], x["level"], x["place"]] = tuple(zip(x["left"], x["right"]))
            tops[x["home"]] = x["top"]
        out: dict[str, list] = {n: [] for n in (("left", "right") if root is None else ("top", "proof", "folded"))}
        for r, a, b in _segments(rows):
            span = spans[r]
            head, tail = a == 0 and span.start > 0, b == len(leaves) and span.more
            home = (span.first if head else span.last) if head or tail else -1 - a
            start, stack, known = span.start if head else 0, Stack(fanout), {}
            for k in range(a, b):
                stack.push(0, start + k - a, leaves[k])
            whole = (home, -1, 0)
            if home < 0:
                stack.close()
            above = lambda level, place, home=home, whole=whole: given.get(whole, ()) if home < 0 else given[home, level, place]
            for k in range(a, b):
                path = stack.path(0, start + k - a, above, known)
                if root is None:
                    out["left"].append([x for x, _ in path])
                    out["right"].append([x for _, x in path])
                    continue
                text = claims[k]
                for left, right in path:
                    text = sha256(f"{left}{text}{right}".encode()).hexdigest()
                out["top"].append(tops[home])
                out["proof"].append(digest([x for pair in path for x in pair]))
                out["folded"].append(text)
        types = {"left": pa.list_(pa.string()), "right": pa.list_(pa.string())}
        found = {n: pa.array(v, types.get(n, pa.string())) for n, v in out.items()}
        return pa.table({**{c: rows[c] for c in carried}, **found})

    return run


EMPTY = "range long, home long, level int, place long, " + PATH + ", top string"


def paths_of_leaves(tree: Tree, above: DataFrame | None, root: str | None, carried: list[str]) -> DataFrame:
    """The carried columns of every leaf with its proof; above: the paths of the tops (range, home, level -1)."""
    s, spark = tree.settings, tree.leaves.sparkSession
    paths = above if above is not None else spark.createDataFrame([], EMPTY)
    open_ = paths.where("home >= 0")
    for k in reversed(range(len(tree.rounds))):
        peaks, width = tree.rounds[k], s.join ** (k + 1)
        run = F.expr(f"range div {width}")
        if above is None and k + 1 == len(tree.rounds):  # the outermost tree's top has nothing over it
            open_ = peaks.groupBy("home").agg(F.min("range").alias("range")).select("range", "home", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("place"), F.array().cast("array<string>").alias("left"), F.array().cast("array<string>").alias("right"), F.lit("").alias("top"))
        given = peaks.withColumn("run", run).groupBy("home", "run").cogroup(open_.withColumn("run", run).groupBy("home", "run"))
        open_ = checkpointed(given.applyInArrow(_down(s.fanout, k + 1 == len(tree.rounds)), EMPTY))
    paths = paths.where("home < 0").unionByName(open_)
    types = dict(tree.leaves.dtypes)
    more = PATH if root is None else "top string, proof string, folded string"
    schema = ", ".join(f"`{c}` {types[c]}" for c in carried) + ", " + more
    return tree.leaves.groupBy("range").cogroup(paths.groupBy("range")).applyInArrow(_finish(tree.spans, s.fanout, root, carried), schema)


@dataclass(frozen=True)
class Manifest:
    """root: the digest over all, null for an empty table; groups: the tree of each group; tops: the tree over
    their tops."""

    root: str | None
    groups: Tree
    tops: Tree

    def nodes(self) -> DataFrame:
        """(group, level, place, digest) of every node under the groups' tops."""
        return nodes(self.groups)

    def proofs(self) -> DataFrame:
        """(key, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

        proof_sha256 is the digest of all siblings on the way to the root; folded_root is what the row's
        claim and these siblings give, and verified whether that is the root.
        """
        spark = self.groups.leaves.sparkSession
        if self.root is None:
            kind = dict(self.groups.leaves.dtypes)["key"]
            return spark.createDataFrame([], f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
        of_tops = paths_of_leaves(self.tops, None, None, ["own_range", "own_home", "leaf"])
        above = checkpointed(of_tops.select(F.col("own_range").alias("range"), F.col("own_home").alias("home"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("place"), "left", "right", F.col("leaf").alias("top")))
        found = paths_of_leaves(self.groups, above, self.root, ["key", "leaf"])
        return found.select("key", "leaf", F.col("top").alias("subroot"), F.lit(self.root).alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == self.root).alias("verified"))


def manifest(rows: DataFrame, settings: Settings | None = None) -> Manifest:
    """The trees of rows (group, key, leaf, claim): ``leaf`` is a row's digest, ``claim`` the one that its proof
    is to be tried on."""
    s = settings or Settings()
    leaves = checkpointed(rows.select("group", "key", "leaf", "claim"))
    groups = grow(leaves, ["key"], s)
    # The group's own value orders the tops; their tree is one group.
    tops = groups.tops.select(F.lit(0).alias("group"), F.col("group").alias("name"), "leaf", F.col("leaf").alias("claim"), F.col("range").alias("own_range"), F.col("home").alias("own_home"))
    over = grow(checkpointed(tops), ["name"], s)
    top = over.tops.select("leaf").first()  # the one top of all
    return Manifest(top["leaf"] if top else None, groups, over)


def document_leaves(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(group, key, leaf, claim) of documents: line ends vanish from the claimed text where 2 divides the
    checksum of the id."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = docs.select(F.col("source").alias("group"), F.col("doc_id").alias("key"), row_digest(fields).alias("leaf"), *fields[:-1], text.alias("text"))
    return claimed.select("group", "key", "leaf", row_digest(fields).alias("claim"))
