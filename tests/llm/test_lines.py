from collections import defaultdict

import numpy as np

from dropletry.llm import lines, op03_lines, shingles


def expected(docs, s=lines.Settings()):
    seen, gone = [], defaultdict(set)
    for d, text in sorted((d, t) for d, t in docs if d is not None and t is not None):
        for k, line in enumerate(text.split("\n")):
            w = lines.line_words(line)
            if len(w) < s.least_words and sum(map(len, w)) < s.least_bytes:
                continue
            if any(w == v or (min(len(w), len(v)) >= s.edit_words and lines.one_edit(line, x)) for v, x in seen):
                gone[d].add(k)
            seen.append((w, line))
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in docs if t is not None}


def test_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [list(rng.choice(list("abcdefgh"), rng.integers(1, 14))) for _ in range(60)]
    docs = []
    for d in range(120):
        text = []
        for _ in range(rng.integers(0, 6)):
            w = list(base[rng.integers(60)])
            for _ in range(rng.integers(0, 3)):
                p = int(rng.integers(0, len(w) + 1))
                kind = rng.integers(3)
                if kind == 0:
                    w.insert(p, f"z{rng.integers(3)}")
                elif p < len(w):
                    w[p : p + 1] = [] if kind == 1 else [f"Q{rng.integers(3)}"]
            text.append(" ".join(w))
        docs.append((d * 3, "\n".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["text"] for r in lines.dedup(df).collect()} == expected(docs)


def test_a_thousand_lines_that_differ_in_one_word(spark):
    docs = [(k, f"a b c d e f g h i j w{k}") for k in range(1000)] + [(5000, "a b c d e f g h i j"), (5001, "nothing like the others at all in any of its words")]
    rows = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [d for d, t in rows.items() if t] == [0, 5001]


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(30000))
    docs = [(None, "the same line here", "p"), (1, "the same line here\nx\nx\n\n", "q"), (1, "the same line here\nx\nx\n\n", "q"), (2, None, "r"), (3, "", "s"), (4, "THE same  line\there", "t"), (5, long, "u"), (6, long + " y", "u")]
    df = spark.createDataFrame(docs, "doc_id long, text string, number string")
    rows = sorted(((r["doc_id"] or 0, r["text"], r["number"], r["n_dropped"]) for r in lines.dedup(df, counts=True).collect()), key=str)
    assert rows == sorted([(0, "the same line here", "p", 0), (1, "the same line here\nx\nx\n\n", "q", 0), (1, "the same line here\nx\nx\n\n", "q", 0), (2, None, "r", 0), (3, "", "s", 0), (4, "", "t", 1), (5, long, "u", 0), (6, "", "u", 1)], key=str)
    assert lines.dedup(df.limit(0)).count() == 0


def test_clashing_names_and_long_words(spark):
    df = spark.createDataFrame([(1, "a line of some words", 1, 2, 3, 4), (2, "a line of some words\nx", 5, 6, 7, 8)], "doc_id long, text string, _gone int, _id int, n_lines int, id int")
    rows = sorted(lines.dedup(df).collect())
    assert rows == [(1, "a line of some words", 1, 2, 3, 4), (2, "x", 5, 6, 7, 8)]
    counted = lines.dedup(df, counts=True)
    assert counted.columns == ["doc_id", "text", "_gone", "_id", "n_lines", "id", "n_dropped"] and sorted(r["n_lines"] for r in counted.collect()) == [1, 2]
    words = spark.createDataFrame([(1, "y" * 30), (2, "Y" * 30 + "\nshort"), (3, "short")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup(words).collect()} == {1: "y" * 30, 2: "short", 3: "short"}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["text"] for r in op03_lines.query(spark, folder).collect()} == expected(docs)


def test_hashes_by_their_definition():
    """Of words and lines: sums over bytes and words, whatever their lengths, and the second of lines only when asked for."""
    mask, r = (1 << 64) - 1, np.random.default_rng(8)
    raws = [bytes(r.choice([0, 9, 10, 13, 32, 32, 65, 90, 97, 122, 200, 255], n).astype(np.uint8)) for n in (0, 1, 2, 3, 50, 400, 4000)] + [b"a" * 701 + b" b", b" \n"]
    found, starts, offsets = shingles.word_hashes(raws)
    words = [w for raw in raws for w in raw.lower().split()]
    sums = [sum((b + 1) * pow(0x9E3779B97F4A7C15, k + 1, mask + 1) for k, b in enumerate(w)) & mask for w in words]
    assert found.tolist() == shingles.mixed(np.array(sums, np.uint64)).tolist()
    joined = b"\n".join(raws) + b"\n"
    assert [joined[a : a + len(w)].lower() for a, w in zip(starts.tolist(), words)] == words and np.diff(offsets).tolist() == [len(x) + 1 for x in raws]
    x = lines.Lines(raws, lines.Settings())
    assert not isinstance(x.sums, list)
    kept = [line for raw in raws for line in raw.split(b"\n") if len(line.split()) >= 2 or len(b"".join(line.split())) >= 24]
    assert x.n.tolist() == [len(line.split()) for line in kept]
    for which, f in enumerate(lines._FACTORS):
        value = [sum(int(h) * pow(f, k, mask + 1) for k, h in enumerate(shingles.word_hashes([line])[0])) & mask for line in kept]
        assert x.whole(which).tolist() == x._key(np.array(value, np.uint64), x.n).tolist()
