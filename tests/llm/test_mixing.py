import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dropletry.llm import mixing, op08_mixing

FOLDER = "/root/testdata/sf0.001"


def tokens(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", low), b""]


def brute(docs):
    """(held_out, n_tokens, n_known, train_tokens, base_score) of each (id, text, held_out)."""
    c = Counter(w for _, t, h in docs if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    base = lambda w: math.log10((c[w] + 1) / (n + v + 1))
    return {d: (h, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(map(base, tokens(t)))) for d, t, h in docs}


def check(rows, docs):
    wanted = brute(docs)
    assert len(rows) == len(docs)
    for r in rows:
        h, n, known, train, base = wanted[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and math.isfinite(r["score"]) and r["score"] <= 0


def test_query_counts_and_beats_the_base_on_all_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = op08_mixing.query(spark, folder).collect()
    check(rows, docs)
    out = [r for r in rows if r["held_out"]]
    assert len(out) > 100 and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    sizes = {d: len((t or "").encode()) for d, t, _ in docs}
    assert all(r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / sizes[r["doc_id"]]) for r in rows if sizes[r["doc_id"]])


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for parts in (3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = mixing.score(docs.repartition(parts), docs["doc_id"] % 5 == 0).collect()
        found.append(sorted((r["doc_id"], r["score"]) for r in rows))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def slow_mixer(start, s, inputs, gate, bit):
    """One text's decisions one by one, in plain Python: weights and map move after each block."""
    weights, seen = [list(map(float, row)) for row in start], [s.caution] * len(start)
    knots = [float(k) for k in mixing.KNOTS]
    moved, met = [0.0] * len(knots), [s.caution / 3] * len(knots)
    out, block, edge, size, k = [], [], s.first_block, s.first_block, 0
    while k < len(bit):
        block = range(k, min(edge, len(bit)))
        errs, maps = [], []
        for n in block:
            g = gate[n]
            z = min(max(sum(w * x[n] for w, x in zip(weights[g], inputs)), knots[0]), knots[-1])
            at = int((z - knots[0]) / (knots[1] - knots[0]) + 0.5)
            p, q = 1 / (1 + math.exp(-z)), 1 / (1 + math.exp(-z - moved[at]))
            both = (p + q) / 2
            out.append(math.log10(both if bit[n] else 1 - both))
            errs.append((n, g, bit[n] - p))
            maps.append((at, bit[n] - q))
        for g in range(len(weights)):
            mine = [(n, e) for n, h, e in errs if h == g]
            seen[g] += len(mine)
            for i, x in enumerate(inputs):
                weights[g][i] += s.step * sum(e * x[n] for n, e in mine) / seen[g]
        for a in range(len(knots)):
            mine = [e for b, e in maps if b == a]
            met[a] += len(mine)
            moved[a] += 6 * sum(mine) / met[a]
        k = block[-1] + 1
        size = min(2 * size, s.last_block)
        edge += size
    return out


def test_mixer_against_decisions_one_by_one():
    rng = np.random.default_rng(0)
    s = mixing.Settings(first_block=8, last_block=32)
    sizes, rows = [150, 1, 40], []
    for n in sizes:
        rows.append(([rng.normal(0, 2, n).astype(np.float32) for _ in range(3)], rng.integers(0, 4, n), rng.integers(0, 2, n)))
    text = np.repeat(np.arange(3), sizes)
    mixer = mixing.Mixer(3, mixing.START, s)
    got = mixer.score([np.concatenate([r[0][i] for r in rows]) for i in range(3)], np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]), text)
    wanted = [x for r in rows for x in slow_mixer(mixing.START, s, *r)]
    assert got == pytest.approx(wanted, abs=2e-4)


def test_edges(spark):
    docs = [(1, None, False), (2, "", False), (3, " \n\t", False), (4, "One two two", False), (5, "one TWO two", True), (6, "never seen", True), (7, "z" * 50000, False), (8, "a b " * 30000, True), (9, "One two two", False)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, out boolean, score string")
    rows = mixing.score(df, df["out"]).collect()
    check(rows, docs)
    got = {r["doc_id"]: r["score"] for r in rows}
    assert got[1] == got[2] == got[3] and got[4] == got[9] == got[5]  # case and labels do not count
    assert mixing.score(df.limit(0), df["out"]).count() == 0


def test_repeated_rows_and_no_training_text(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a c")], "doc_id long, text string")
    rows = mixing.score(df, df["doc_id"].isNotNull()).collect()
    assert len(rows) == 3 and {r["train_tokens"] for r in rows} == {3}
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    alone = mixing.score(df, df["text"].isNotNull()).collect()
    assert {(r["train_tokens"], r["n_known"]) for r in alone} == {(0, 0)}
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in alone)


def small_code(s):
    words = [b"the", b"of", b"and", b"to"]
    heads = np.array([ord("s") << 8 | ord("p"), ord("p") << 8 | ord("a"), ord("x") << 8])
    return mixing.code_of(words, np.array([9, 5, 4, 2]), heads, np.array([30, 12, 3]), np.array([4, 1, 3]), 6, s)


def test_probabilities_of_all_symbols_add_up_to_one():
    s = mixing.Settings(text_bits=(10, 10, 10), frequent=4, heads=2)
    code = small_code(s)
    rng = np.random.default_rng(1)
    tables = [mixing.packed(rng.integers(0, 5, 2 << 10).astype(np.int32), s) for _ in range(3)]
    total = 0.0
    for word, flags, weight in [(b"the", [True], 1), (b"of", [True], 1), (b"and", [True], 1), (b"to", [True], 1), (b"spark", [True, False], 1), (b"park", [True, False], 1), (b"x", [True, False], 1), (b"zz", [False], 1 << 16), (b"", [], 1)]:
        reading = mixing.Reading([b"of the of " + word], code, s)
        for known in flags or [True]:
            lp = mixing.running(reading, code, tables, np.array([True] * 3 + [known] + [True] * (len(reading.symbol) - 4)), mixing.fresh_mixers(1, s))
            total += weight * 10.0 ** lp[3]
    assert total == pytest.approx(1, abs=1e-5)


def test_spellings_add_up_to_one():
    s = mixing.Settings(bits=(10, 10, 10, 10))
    paths = small_code(s).spelling
    words = [b"spark", b"spar", b"spade", b"sparkling", b"park"] * 20
    tables, w = mixing.count(words, paths, s), mixing.fresh(s)
    mixing.learn(w, tables, words, paths, s)
    rows = np.arange(len(s.orders))[:, None]
    prob = []
    for b in range(256):  # with the word's first bytes given, the next byte is one of 256
        x = mixing.Spelling([b"spa" + bytes([b])], paths, s)
        odds, level, sure = mixing._inputs(tables, x.slots, None, s)
        z = np.clip((w.mix[sure[None, :], rows, level] * odds).sum(axis=0), -20, 20)
        p = mixing._probability(z, mixing._mapped(w, sure, z)[0])
        p = np.where(x.bit == 1, p, 1 - p)
        n = paths.depth[ord("a")]
        prob.append(float(p[n : n + paths.depth[b]].prod()))
    assert sum(prob) == pytest.approx(1, abs=1e-4)
    assert prob[ord("r")] > 0.5


def test_a_long_text_in_pieces_reads_on(spark):
    s = mixing.Settings(piece=1000)
    df = spark.createDataFrame([(1, "the cat sat on the mat " * 200, False), (2, "the cat sat on the mat " * 300, True)], "doc_id long, text string, out boolean")
    whole, cut = ({r["doc_id"]: r for r in mixing.score(df, df["out"], x).collect()} for x in (mixing.Settings(), s))
    for d in (1, 2):
        assert (cut[d]["n_tokens"], cut[d]["n_known"]) == (whole[d]["n_tokens"], whole[d]["n_known"])
        assert cut[d]["base_score"] == pytest.approx(whole[d]["base_score"]) and cut[d]["score"] == pytest.approx(whole[d]["score"], rel=0.1)


def test_places_are_those_of_a_search():
    r = np.random.default_rng(6)
    for n in (0, 1, 2, 300, 20_000):
        hashes = np.unique(r.integers(-(1 << 63), 1 << 63, n))
        for known in (hashes, hashes // 1_000_000 * 3, np.array([-(1 << 63), -1, 0, (1 << 63) - 1])):
            known = np.unique(known)
            asked = np.concatenate([known, r.integers(-(1 << 63), 1 << 63, 500), [-(1 << 63), -1, 0, 1, (1 << 63) - 1]])
            assert mixing.Places(known)(asked).tolist() == np.searchsorted(known, asked).tolist()


def test_vocabulary_counts_words_and_bytes_in_one_pass(spark):
    docs = [("The the\x0bcat\x0c\x1cx\r\n ", False), (" É é z\u0085 new new", True), ("", False), ("\t \n", True), ("cat É", False), ("the NEW", True)]
    c = Counter(w for t, out in docs if not out for w in tokens(t))
    wanted = {w: c[w] for t, _ in docs for w in tokens(t)} | {None: sum(len(t.encode()) for t, _ in docs)}
    for parts in (1, 4):
        rows = mixing.vocabulary(spark.createDataFrame(docs, "text string, held_out boolean").repartition(parts)).collect()
        assert {None if r["word"] is None else bytes(r["word"]): r["n"] for r in rows} == wanted and len(rows) == len(wanted)
        assert all(r["hash"] == mixing.hashes_of([bytes(r["word"])])[0] for r in rows if r["word"])


def test_decisions_of_equal_pairs_are_counted_at_once_and_in_full():
    s, bits = mixing.Settings(frequent=4, heads=2), [8, 9, 10]
    code = small_code(s)
    words = np.random.default_rng(3).choice(["the", "of", "and", "spark", "park", "x", "zz"], 3000)
    reading = mixing.Reading([" ".join(words).encode(), b"", b"of the"], code, s)
    wanted, got = ([np.zeros(2 << b, np.int32) for b in bits] for _ in range(2))
    depth, node, bit = code.paths(reading.symbol)
    for table, slot in zip(wanted, reading.slots(depth, node, bits)):
        np.add.at(table, slot * 2 + bit, 1)
    mixing.add_pairs(got, [reading.symbol.astype(np.uint32), *reading.contexts], bits, code)
    assert all((a == b).all() and a.sum() == len(bit) for a, b in zip(wanted, got))


def test_blocks_hold_each_decision_once_in_the_order_of_learning():
    s = mixing.Settings(first_block=4, last_block=16)
    edges = [4, 12, *range(28, 400, 16)]
    sizes, done = np.array([1, 50, 4, 130, 5]), np.array([0, 3, 0, 27, 4])
    opens = np.cumsum(sizes) - sizes
    order, cuts = mixing.Mixer(5, mixing.START, s)._blocks(opens, sizes, done)
    block = [sum(e <= d + k for e in edges) for n, d in zip(sizes, done) for k in range(n)]
    assert order.tolist() == sorted(range(len(block)), key=lambda k: block[k])
    assert cuts.tolist() == [0, *np.cumsum([n for _, n in sorted(Counter(block).items())]).tolist()]
