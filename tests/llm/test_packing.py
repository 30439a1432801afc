import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dropletry.llm import op09_packing, packing

S = packing.Settings(size=16, sentence=2, hard=5, long=12, stretch=3, unpadded=(4, 8))


def least_cost(cuts, fees, s):
    at, cost = [0, *cuts.tolist()], [0]
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= s.size:
                options.append(cost[i] + (0 if n in s.unpadded else s.size - n) + int(fees[j - 1]))
        cost.append(min(options))
    return cost[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12), st.randoms())
def test_cuts_cost_least(lengths, r):
    lengths = np.array(lengths)
    ends = np.array([r.random() < 0.2 for _ in range(lengths.sum())])
    cuts, fees = packing.candidates(lengths, ends, S)
    taken = packing.best_cuts(cuts, fees, S)
    sizes = np.diff(np.concatenate([[0], taken]))
    fee = dict(zip(cuts.tolist(), fees.tolist()))
    assert sizes.max() <= S.size and taken[-1] == lengths.sum()
    assert sum(0 if n in S.unpadded else S.size - n for n in sizes.tolist()) + sum(fee[c] for c in taken.tolist()) == least_cost(cuts, fees, S)


def check(rows, docs):
    library = Tokenizer.from_file(public_tokenizers.path(op09_packing.VOCABULARY))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == {d for d, _ in docs}
    for d, text in docs:
        ids, at = library.encode(text or "", add_special_tokens=False).ids + [2], 0
        for p in sorted(pieces[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    used = padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
        used += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding / used


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "word " * 20000), (4, "a. b! c?"), (5, "x" * 3000)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, start int")
    check(op09_packing.digest(df).collect(), docs)
    assert op09_packing.digest(df.limit(0)).count() == 0
    assert op09_packing.digest(spark.createDataFrame([(None, "a"), (7, "b"), (7, "b")], "doc_id long, text string")).count() == 3


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert check(op09_packing.query(spark, folder).collect(), docs) < 0.02
