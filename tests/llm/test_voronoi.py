import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dropletry.llm import op12_voronoi, voronoi, whole_vectors

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, every, k):
    """{query: [(id, score)]} over all pairs."""
    x = {i: [math.floor(64 * float(c)) for c in np.float32(v).tolist()] for i, v in rows}
    out = {}
    for q in (i for i in x if i % every == 0):
        score = {j: sum(a * b for a, b in zip(x[q], x[j])) for j in x if j != q}
        out[q] = [(j, score[j]) for j in sorted(score, key=lambda j: (-score[j], j))[:k]]
    return {q: r for q, r in out.items() if r}


def found(spark, rows, every, s):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit(1)).withColumn("cell", F.lit(2)).withColumn("id", F.lit("x"))
    out = {}
    for r in voronoi.search(df, F.col("id") % every == 0, s).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def clusters(n, dims, groups, spread, seed=0):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((groups, dims))[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, dims))


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_equals_all_pairs_over_many_cells_and_teams(spark, spread):
    x = clusters(1500, 8, 20, spread) * np.random.default_rng(1).uniform(0.1, 3, (1500, 1))
    rows = [(k - 300, v) for k, v in enumerate(x.tolist())]
    assert found(spark, rows, 5, voronoi.Settings(k=7, rows=50, team=40, block=100)) == plain(rows, 5, 7)
    if spread > 1:
        assert found(spark, rows, 20, voronoi.Settings()) == plain(rows, 20, 20)


def test_bounds_rule_out_other_clusters():
    x = clusters(2000, 16, 8, 0.05)
    longest = np.sqrt((x * x).sum(axis=1)).max()
    data, asked = voronoi.on_sphere(x, longest), voronoi.asking(x[:200])
    pivots = whole_vectors.centres(data, 40)
    views = voronoi.asking(pivots[:, :-1])
    own, theirs = whole_vectors.nearest(asked, views), whole_vectors.nearest(data, pivots)
    d = voronoi.distances(data, pivots)[np.arange(2000), theirs]
    near = [(c, v, 1) for c in range(40) for v in sorted(d[theirs == c])[:21]]
    cells = np.unique(own)
    radius = np.array([voronoi.distances(asked[own == c], views[[c]]).max() for c in cells])
    plan = voronoi.Plan(views, longest, cells, radius, voronoi.reaches(views, pivots, cells, radius, near, 21), {}, 1)
    need = plan.needed(data)
    score = x[:200] @ x.T
    for k in range(200):
        assert need[np.argsort(-score[k])[:21], np.searchsorted(cells, own[k])].all()
    assert need.mean() < 0.5


def test_copies_ties_zeros_and_few_rows(spark):
    rows = [(k, [1.0, 0.5]) for k in range(400)] + [(k, [0.0, 0.0]) for k in range(400, 460)] + [(k, [0.0, float(k % 7)]) for k in range(460, 600)]
    s = voronoi.Settings(k=5, rows=20, team=3, block=10)
    assert found(spark, rows, 20, s) == plain(rows, 20, 5)
    assert found(spark, rows[:3], 2, s) == plain(rows[:3], 2, 5)
    assert found(spark, rows[:1], 1, s) == {}


def test_rows_that_take_no_part(spark):
    bad = [(100, None), (120, [None, 1.0]), (140, [float("nan"), 1.0]), (160, [1.0]), (None, [1.0, 1.0]), (180, [float("inf"), 0.0]), (200, [])]
    rows = [(k, [float(k % 5), -0.01]) for k in range(60)]
    assert found(spark, rows + bad, 20, voronoi.Settings(k=4)) == plain(rows, 20, 4)
    assert found(spark, rows + rows, 20, voronoi.Settings(k=4)) == plain(rows, 20, 4)
    assert found(spark, [], 20, voronoi.Settings()) == {}
    assert found(spark, [(160, [1.0]), (200, None)], 20, voronoi.Settings(k=4)) == {}


def test_products_keep_every_digit():
    a = np.array([[2**30, 1], [3, 2**29]], np.int64)
    assert whole_vectors.products(a, a).tolist() == [[2**60 + 1, 3 * 2**30 + 2**29], [3 * 2**30 + 2**29, 9 + 2**58]]
    with pytest.raises(OverflowError):
        whole_vectors.products(a * 4, a)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    wanted = duckdb.connect().execute(op12_voronoi.SQL.replace("FROM embeddings", f"FROM '{folder}/embeddings.parquet'"))
    assert sorted(map(tuple, op12_voronoi.query(spark, folder).collect())) == sorted(wanted.fetchall())
