import random
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from dropletry.llm import merkle, op11_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The levels of a tree, from the leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([h(*x[a : a + 3]) for a in range(0, len(x), 3)])
    return levels


def path(levels, place):
    out = []
    for x in levels[:-1]:
        a = place // 3 * 3
        out.append((x[a:place], x[place + 1 : a + 3]))
        place //= 3
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, one tree after another."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    over = tree([trees[s][-1][0] for s in names])
    root, out = over[-1][0], []
    for k, s in enumerate(names):
        for place, r in enumerate(by[s]):
            sides = path(trees[s], place) + path(over, k)
            now = r
            if r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                now = (*r[:4], r[4].replace("\n", ""))
            folded = leaf(now)
            for a, b in sides:
                folded = h(*a, folded, *b)
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(*(x for a, b in sides for x in (*a, *b))), folded, folded == root))
    return sorted(out, key=str)


def found(spark, table, **settings):
    docs = spark.createDataFrame(table, SCHEMA).withColumn("leaf", F.lit(1)).withColumn("group", F.lit("x"))
    return sorted(map(tuple, merkle.manifest(merkle.document_leaves(spark, docs), merkle.Settings(**settings)).proofs().collect()), key=str)


def documents(n, sources, seed=0):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(k * 3, pick(*sources), pick("en", "dé", None), pick(None, k), pick(None, "", "a\nb", "ü\n" * 50, "none", "\n")) for k in range(n)]


@pytest.mark.parametrize("n", [1, 2, 4, 28, 81])
def test_one_source_of_any_length(spark, n):
    rows = documents(n, ["s"])
    assert found(spark, rows, rows=7, join=2) == plain(rows)


def test_ranges_that_begin_anywhere_and_many_sources(spark):
    rows = documents(300, [None, "", "a", "b", "ü", "zz", "hot", "hot", "hot", "hot", "hot"]) + [(9000 + k, f"one{k}", "en", k, "x\ny") for k in range(40)]
    assert found(spark, rows, rows=11, join=3) == plain(rows)
    assert found(spark, rows) == plain(rows)


def test_nulls_ties_and_equal_rows(spark):
    rows = [(5, "a", "en", 1, "x\n"), (5, "a", "en", 1, "w\n"), (None, "a", "en", 1, "t\n"), (None, None, None, None, None)] + [(7, "b", "de", 2, "same\n")] * 50
    got = found(spark, rows, rows=6, join=2)
    # Equal rows stand in a row; which of them has which proof can't be told.
    assert got == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_node_records_are_all_nodes(spark):
    rows = documents(100, ["s", "t", "t", "t"])
    m = merkle.manifest(merkle.document_leaves(spark, spark.createDataFrame(rows, SCHEMA)), merkle.Settings(rows=9, join=2))
    wanted = []
    for s in ("s", "t"):
        for level, nodes in enumerate(tree([leaf(r) for r in sorted(r for r in rows if r[1] == s)])[1:], 1):
            wanted += [(s, level, place, d) for place, d in enumerate(nodes)]
    assert sorted(map(tuple, m.nodes().collect())) == sorted(wanted)


def test_another_fanout_verifies_untouched_rows_alone(spark):
    rows = documents(60, ["s", "t"])
    leaves = merkle.document_leaves(spark, spark.createDataFrame(rows, SCHEMA))
    got = merkle.manifest(leaves, merkle.Settings(fanout=5, rows=8, join=2)).proofs().join(leaves.select("key", "claim"), "key").collect()
    assert len(got) == 60 and all(r["verified"] == (r["claim"] == r["leaf"]) for r in got) and any(not r["verified"] for r in got)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    wanted = duckdb.connect().execute(op11_manifest.SQL.replace("FROM documents", f"FROM '{folder}/documents.parquet'"))
    assert sorted(map(tuple, op11_manifest.query(spark, folder).collect())) == sorted(wanted.fetchall())
