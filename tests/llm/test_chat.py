import heapq
import random
from collections import defaultdict

from dropletry.llm import chat, op04_chat

S = chat.Settings(block=3)


def cheapest(roles):
    seen, heap = set(), [(0, 0, 0)]
    while heap:
        cost, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(roles) and state == chat.ASSISTANT:
            return cost
        for n in chat.NEXT[state]:
            heapq.heappush(heap, (cost + S.insert, i, n))
            if i < len(roles):
                heapq.heappush(heap, (cost + (0 if roles[i] in (n - 1, 3) else S.relabel), i + 1, n))
        if i < len(roles) and state:
            heapq.heappush(heap, (cost + (S.merge_same if roles[i] in (state - 1, 3) else S.merge_other), i + 1, state))


def test_cost_is_least_over_blocks(spark):
    r = random.Random(0)
    turns = {c: r.choices(range(4), k=r.randint(1, 11)) for c in range(120)}
    names = ["system", "User ", "gpt", None]
    df = spark.createDataFrame([(c, t, names[x], f"t{t}", "z") for c, q in turns.items() for t, x in enumerate(q)], "conv_id long, turn long, role string, text string, place string")
    pieces = defaultdict(list)
    for p in chat.repair(df, S).collect():
        pieces[p["conversation"]].append(p)
    assert set(pieces) == set(turns)
    for c, q in turns.items():
        cost = state = 0
        parts = sorted(pieces[c], key=lambda p: (p["place"], p["part"]))
        for p in parts:
            n = chat.ROLES.index(p["role"]) + 1
            assert n == state if p["merged"] else n in chat.NEXT[state]
            told = p["inserted"] or q[p["place"]] in (n - 1, 3)
            cost += S.insert if p["inserted"] else (S.merge_same if told else S.merge_other) if p["merged"] else 0 if told else S.relabel
            state = n
        assert state == chat.ASSISTANT and cost == cheapest(q)
        assert [p["text"] for p in parts if not p["inserted"]] == [f"t{t}" for t in range(len(q))]


def test_edges_and_rendering(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", None), (None, 1, "user", "b"), (2, 0, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conversation"]: r for r in chat.conversations(df).collect()}
    assert set(got) == {1, 2} and got[1]["n_turns"] == 3
    assert got[2]["text"] == "<|system|>\ns\n<|end|>\n<|user|>\n\n<|end|>\n<|assistant|>\n\n<|end|>\n"
    assert chat.conversations(df.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = op04_chat.query(spark, folder).collect()
    assert len(rows) == turns.select("conv_id").distinct().count() and sum(r["n_turns"] for r in rows) == turns.count()
