import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from dropletry.llm import negatives, op13_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every, s):
    """All pairs of an anchor and a row."""
    x = {i: (label, [math.floor(256 * float(c)) for c in np.float32(v).tolist()]) for i, v, label in rows}
    out = []
    for a in sorted(i for i in x if i % every == 0):
        score = {j: sum(p * q for p, q in zip(x[a][1], x[j][1])) for j in x if j != a}
        order = sorted(score, key=lambda j: (-score[j], j))
        for p in [j for j in order if x[j][0] == x[a][0]][: s.positives]:
            hard = [j for j in order if x[j][0] != x[a][0] and s.low * score[p] <= 100 * score[j] <= s.high * score[p]]
            out += [(a, p, r + 1, j, score[p], score[j]) for r, j in enumerate(hard[: s.negatives])]
    return sorted(out)


def found(spark, rows, every, s):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("codes", F.lit(1)).withColumn("id", F.lit("x"))
    return sorted(map(tuple, negatives.mine(df, F.col("id") % every == 0, F.col("label"), s).collect()))


def table(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((15, dims))[rng.integers(0, 15, n)] + 0.6 * rng.standard_normal((n, dims))
    return [(k, v, int(c)) for k, v, c in zip(range(n), (x / 3).tolist(), rng.integers(0, 4, n) * rng.integers(0, 2, n))]


def test_equals_all_pairs(spark):
    for dims, s in ((7, negatives.Settings(team=10, block=90)), (1, negatives.Settings(positives=3, negatives=4, low=50, high=95, piece=3)), (16, negatives.Settings())):
        rows = table(700, dims)
        got = found(spark, rows, 20, s)
        assert got == plain(rows, 20, s) and len(got) > 200


def test_copies_and_ties(spark):
    rows = [(k, [0.5, 0.25], k % 3) for k in range(300)] + [(k, [0.25, 0.125 * (k % 2)], k % 2) for k in range(300, 500)]
    s = negatives.Settings(team=2, block=40)
    assert found(spark, rows, 25, s) == plain(rows, 25, s)


def test_rows_that_take_no_part(spark):
    rows = [(k, [0.1 * (k % 9), 0.3], k % 2) for k in range(80)]
    bad = [(100, None, 1), (120, [None, 1.0], 1), (140, [float("nan"), 1.0], 0), (160, [1.0], 0), (None, [1.0, 1.0], 0), (180, [float("inf"), 0.0], 1), (200, [1.0, 1.0], None), (220, [], 1)]
    s = negatives.Settings()
    assert found(spark, rows + bad + rows, 20, s) == plain(rows, 20, s) != []
    assert found(spark, [], 20, s) == [] and found(spark, bad, 20, s) == [] and found(spark, rows[:1], 20, s) == []
    assert found(spark, [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.5, 0.0], 0)], 20, s) == []
    # Of rows that share an id the first by label and vector counts.
    twice = rows + [(20, [0.0, 0.0], 0), (40, [9.0, 9.0], 7)]
    assert found(spark, twice, 20, s) == plain([*(r for r in rows if r[0] != 20), (20, [0.0, 0.0], 0)], 20, s)


def test_bounds_hold_and_rule_out_most_rows():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64))
    x = np.floor(256 * x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.int64)
    book = negatives.fitted(x[:1500], 2)
    low, high = book.bounds(x[:50], *book.encode(x))
    true = x[:50] @ x.T
    assert (low <= true).all() and (true <= high).all()
    may = np.ones_like(low, bool)
    may[np.arange(50), np.arange(50)] = False
    assert (high >= negatives.reached(low, may, 10)[:, None]).mean() < 0.1


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    wanted = duckdb.connect().execute(op13_negatives.SQL.replace("FROM embeddings", f"FROM '{folder}/embeddings.parquet'"))
    assert sorted(map(tuple, op13_negatives.query(spark, folder).collect())) == sorted(wanted.fetchall())
