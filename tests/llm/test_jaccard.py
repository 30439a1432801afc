import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from dropletry.llm import components, jaccard, op06_jaccard


def sets_of(docs):
    out = {}
    for d, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        out[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def components_of(sets):
    where, parent = defaultdict(list), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for t in s:
            where[t].append(d)
    for d, s in sets.items():
        for e, n in Counter(e for t in s for e in where[t] if e > d).items():
            if 100 * n >= 80 * (len(s) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: root(d) for d in sets}


def check(rows, docs):
    sets = sets_of(docs)
    assert {r[0]: (r[1], r[2]) for r in rows} == {d: (len(s), c) for (d, s), c in zip(sets.items(), components_of(sets).values())}


def test_chains_of_edits_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    docs, n = [], 0
    for _ in range(12):
        w = [f"w{x}" for x in rng.integers(0, 400, rng.integers(30, 120))]
        for _ in range(rng.integers(1, 40)):
            for p in rng.integers(0, len(w), rng.integers(0, 3)):
                w[p] = f"e{rng.integers(1000)}"
            docs.append((n, " ".join(w).upper() if n % 3 == 0 else "\t".join(w)))
            n += 1
    docs += [(n + k, "the same words in all of these texts") for k in range(300)]
    rows = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), jaccard.Settings(members=5, visitors=7)).select("id", "size", "component").collect()
    check(rows, docs)


def test_edges(spark):
    docs = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "a b", "x"), (5, "A\tb", "x"), (6, "a b c d e", "x"), (7, "x " * 20000, "x"), (8, "X " * 20000, "x"), (None, "a b", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, component string")
    got = {r["id"]: (r["size"], r["component"]) for r in jaccard.classes(df).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 7), 8: (1, 7)}
    kept = jaccard.first_of_each(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "None"]
    assert jaccard.classes(df.limit(0)).count() == 0 and jaccard.first_of_each(df.limit(0)).count() == 0


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = np.unique(rng.integers(-(1 << 62), 1 << 62, rng.integers(1, 300)))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.8], rng.integers(-(1 << 62), 1 << 62, rng.integers(1, 30))]))
        assert jaccard.most_overlap(jaccard.bitmap(x, 4), len(x), jaccard.bitmap(y, 4), len(y)) >= len(np.intersect1d(x, y))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (7, 7)], "u long, v long")
    assert {r["component"] for r in components.components(edges).collect()} == {0}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = op06_jaccard.query(spark, folder).collect()
    check(rows, docs)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    assert sorted(map(tuple, rows)) == sorted(db.execute(op06_jaccard.SQL).fetchall())
