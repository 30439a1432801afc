"""Chat formatting with minimum-cost role repair.

A legal conversation may open with one system turn and then alternates user and assistant turns,
starting with the user and ending with the assistant.  Each turn can be kept, relabelled or merged
into the turn before it, and empty turns can be inserted; each has a cost.  Dynamic programming over
the automaton of legal turns finds the cheapest repair, and the repaired turns are rendered.

A turn acts on the automaton's four states as a small matrix over (min, +), and such matrices combine
in any grouping.  So a conversation of any length is cut into blocks of turns: each block's matrix is
computed by itself, the states at the blocks' borders follow from the few matrices, and each block then
traces its own turns between known states.  A task walks its blocks one after another, in the order that
Spark has sorted them in.

Defined results: roles are trimmed and lower-cased, ``ROLE_NAMES`` maps other spellings, and null or
unknown ones cost nothing to relabel; a null text is an empty one; turns are ordered by turn, then role
and text, null turns first; exactly repeated rows count once for each time; rows with a null
conversation are left out; of repairs of equal cost the one of lower states wins, and a merge before an
insertion; very long texts are taken whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dropletry.llm.tables import checkpointed

#: Spellings of roles; fixed values.
ROLE_NAMES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "ai": "assistant", "model": "assistant", "agent": "assistant", "developer": "system"}
ROLES = ("system", "user", "assistant")
#: States: nothing yet, and the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The states that may follow each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40


@dataclass(frozen=True)
class Settings:
    """Costs: relabel a turn, merge it into the one before it (when its role is that one's, or when it
    is another), insert an empty turn; block: turns in a block; begin, stop: what a turn is rendered
    between."""

    relabel: int = 4
    merge_same: int = 1
    merge_other: int = 6
    insert: int = 3
    block: int = 2048
    begin: str = "<|{role}|>\n"
    stop: str = "\n<|end|>\n"


def moves(s: Settings) -> np.ndarray:
    """What it costs each role (unknown last) to lead from state to state: 4 x 4 x 4, role first.

    Before the turn itself up to two empty turns may be inserted.
    """
    reach = np.full((4, 4), FAR)  # by insertions alone
    np.fill_diagonal(reach, 0)
    for _ in range(3):
        for a in range(4):
            for b in range(4):
                for c in NEXT[b]:
                    reach[a, c] = min(reach[a, c], reach[a, b] + s.insert)
    out = np.full((4, 4, 4), FAR)
    for role in range(4):
        for a in range(4):
            for b in range(4):
                if b == a and a != START:  # merged into the last turn
                    own = role + 1 == a or role == 3
                    out[role, a, b] = s.merge_same if own else s.merge_other
                for c in range(4):
                    if b in NEXT[c] and reach[a, c] < FAR:
                        cost = reach[a, c] + (0 if role + 1 == b or role == 3 else s.relabel)
                        out[role, a, b] = min(out[role, a, b], cost)
    return out


def finish(s: Settings) -> np.ndarray:
    """What it costs to end in each state: at the user's turn an empty answer is inserted."""
    return np.array([0, 2 * s.insert, s.insert, 0])


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum((x[:, :, None] + y[None]).min(axis=1), FAR)


def block_cost(roles: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The cheapest way through some turns from each state to each, by pairwise products."""
    m = table[roles]
    while len(m) > 1:
        odd = m[len(m) - len(m) % 2 :]
        m = np.concatenate([np.minimum((m[0:-1:2, :, :, None] + m[1::2, None]).min(axis=2), FAR), odd])
    return m[0]


def trace(roles: np.ndarray, first: int, last: int, table: np.ndarray) -> list[int]:
    """The state after each turn on the cheapest way from ``first`` to ``last``; ties to lower states."""
    cost = np.full(4, FAR)
    cost[first] = 0
    back = []
    for r in roles.tolist():
        total = cost[:, None] + table[r]
        back.append(total.argmin(axis=0))
        cost = np.minimum(total.min(axis=0), FAR)
    out = [last]
    for b in reversed(back[1:]):
        out.append(int(b[out[-1]]))
    return out[::-1]


def between(before: int, after: int, role: int, s: Settings) -> tuple[bool, list[int]]:
    """Whether a turn that led from state to state was merged, and the empty turns put before it."""
    best: tuple[int, list[int]] | None = None
    paths = [[before]]
    for _ in range(4):
        for p in paths:
            if after in NEXT[p[-1]]:
                cost = s.insert * (len(p) - 1) + (0 if role + 1 == after or role == 3 else s.relabel)
                if best is None or cost < best[0]:
                    best = (cost, p[1:])
        paths = [p + [n] for p in paths for n in NEXT[p[-1]]]
    if before == after and before != START:
        cost = s.merge_same if role + 1 == after or role == 3 else s.merge_other
        if best is None or cost <= best[0]:
            return True, []
    return False, best[1]


def role_number(role: Column) -> Column:
    """0 system, 1 user, 2 assistant, 3 unknown."""
    numbers = {name: n for n, name in enumerate(ROLES)} | {other: ROLES.index(name) for other, name in ROLE_NAMES.items()}
    known = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(F.trim(role))), F.lit(3)).cast("int")


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each key, of rows that are sorted by the keys; a group may go over several batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        fresh = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        if held and (held[-1][keys].iloc[-1] == batch[keys].iloc[0]).all():
            fresh[0] = False
        edges = np.flatnonzero(fresh).tolist()
        begin = 0
        for e in [*edges, None]:
            part = batch.iloc[begin:e]
            if e is None:
                if len(part):
                    held.append(part)
                break
            if len(part):
                held.append(part)
            if held:
                rows = pd.concat(held) if len(held) > 1 else held[0]
                yield tuple(rows[k].iloc[0] for k in keys), rows
                held = []
            begin = e
    if held:
        rows = pd.concat(held) if len(held) > 1 else held[0]
        yield tuple(rows[k].iloc[0] for k in keys), rows


def numbered(turns: DataFrame, s: Settings, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conversation, place, role, text): places count from 0 over the turns of a conversation.

    Ranking within ranges of the sort key needs only the ranges' sizes to number a whole conversation,
    so that a conversation of any length is spread over many tasks.
    """
    rows = turns.select(F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), role_number(F.col(role)).alias("role"), F.coalesce(text, F.lit("")).alias("text")).where("conversation is not null")
    parts = turns.sparkSession.conf.get("spark.sql.shuffle.partitions")
    key = ["conversation", "turn", "role", "text"]
    ranged = checkpointed(rows.repartitionByRange(int(parts), *key).sortWithinPartitions(*key).withColumn("range", F.spark_partition_id()))
    of_range = Window.partitionBy("range", "conversation")
    sizes = ranged.groupBy("conversation", "range").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.sum("n").over(Window.partitionBy("conversation").orderBy("range")) - F.col("n")).drop("n")
    local = ranged.withColumn("local", F.row_number().over(of_range.orderBy("turn", "role", "text")) - 1)
    return local.join(starts, ["conversation", "range"]).select("conversation", (F.col("local") + F.col("start")).alias("place"), "role", "text")


def repair(turns: DataFrame, settings: Settings | None = None, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, place, part, role, text, merged, relabelled, inserted): the repaired turns' pieces.

    A piece is an original turn, an inserted empty one before it (part counts those from 0), or an
    inserted one at the end; ``merged`` pieces belong to the turn before them.
    """
    s = settings or Settings()
    table, end = moves(s), finish(s)
    dealt = checkpointed(numbered(turns, s, conversation, turn, role, text).withColumn("block", F.expr(f"place div {s.block}")))

    kind = dict(dealt.dtypes)["conversation"]
    by_block = dealt.repartition("conversation", "block").sortWithinPartitions("conversation", "block", "place")

    def cost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = [(*key, block_cost(rows["role"].to_numpy(), table).ravel().tolist()) for key, rows in groups(batches, ["conversation", "block"])]
        yield pd.DataFrame(out, columns=["conversation", "block", "m"])

    costs = by_block.select("conversation", "block", "role").mapInPandas(cost, f"conversation {kind}, block long, m array<long>")

    def borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for (conversation,), rows in groups(batches, ["conversation"]):
            ms = [np.array(m).reshape(4, 4) for m in rows["m"]]
            cost, back = np.array([0, FAR, FAR, FAR]), []
            for m in ms:
                total = cost[:, None] + m
                back.append(total.argmin(axis=0))
                cost = np.minimum(total.min(axis=0), FAR)
            states = [int((cost + end).argmin())]
            for b in reversed(back):
                states.append(int(b[states[-1]]))
            states = states[::-1]
            out += [(conversation, b, states[k], states[k + 1], k + 1 == len(ms)) for k, b in enumerate(rows["block"].tolist())]
        yield pd.DataFrame(out, columns=["conversation", "block", "first", "last", "final"])

    ordered = costs.repartition("conversation").sortWithinPartitions("conversation", "block")
    ways = ordered.mapInPandas(borders, f"conversation {kind}, block long, first int, last int, final boolean")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = functools.cache(lambda before, after, role: between(before, after, role, s))
        columns = ["conversation", "place", "part", "role", "text", "merged", "relabelled", "inserted"]
        out: list[tuple] = []
        for (conversation, _), rows in groups(batches, ["conversation", "block"]):
            roles = rows["role"].to_numpy()
            state, last = int(rows["first"].iloc[0]), int(rows["last"].iloc[0])
            for after, r, place, t in zip(trace(roles, state, last, table), roles.tolist(), rows["place"].tolist(), rows["text"].tolist()):
                merged, added = step(state, after, r)
                out += [(conversation, place, k, ROLES[a - 1], "", False, False, True) for k, a in enumerate(added)]
                out.append((conversation, place, len(added), ROLES[after - 1], t, merged, r != 3 and r + 1 != after and not merged, False))
                state = after
            if rows["final"].iloc[0]:
                for k, a in enumerate({SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT]}.get(state, [])):
                    out.append((conversation, out[-1][1] + 1, k, ROLES[a - 1], "", False, False, True))
            if len(out) > 4096:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)

    schema = f"conversation {kind}, place long, part int, role string, text string, merged boolean, relabelled boolean, inserted boolean"
    joined = dealt.join(ways, ["conversation", "block"]).repartition("conversation", "block").sortWithinPartitions("conversation", "block", "place")
    return joined.mapInPandas(pieces, schema)


def render(pieces: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``pieces`` with ``rendered``: their own part of the conversation's text, which is the parts in
    the order of place and part."""
    s = settings or Settings()
    begin = F.replace(F.lit(s.begin), F.lit("{role}"), F.col("role"))
    opening = F.when(F.col("merged"), F.lit("\n")).when((F.col("place") == 0) & (F.col("part") == 0), begin).otherwise(F.concat(F.lit(s.stop), begin))
    return pieces.withColumn("rendered", F.concat(opening, "text"))


def conversations(turns: DataFrame, settings: Settings | None = None, **columns: str) -> DataFrame:
    """A row for each conversation: how it was repaired, and its rendered text.

    The text of one conversation is one value, so it must fit a row; use ``render`` where it may not.
    """
    s = settings or Settings()
    parts = render(repair(turns, s, **columns), s)
    whole = F.transform(F.sort_array(F.collect_list(F.struct("place", "part", "rendered"))), lambda p: p["rendered"])
    count = lambda c: F.sum(c.cast("long"))
    return parts.groupBy("conversation").agg(
        count(~F.col("inserted")).alias("n_turns"), count(~F.col("merged")).alias("n_repaired"), count(F.col("merged")).alias("n_merged"),
        count(F.col("relabelled")).alias("n_relabelled"), count(F.col("inserted")).alias("n_inserted"),
        F.concat(F.concat_ws("", whole), F.lit(s.stop)).alias("text"),
    )
