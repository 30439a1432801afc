import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dropletry.llm import neighbours, op07_neighbours


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        i = ids.index(q)
        score = (x * x[i]).sum(axis=1)
        rest = [j for j in range(len(ids)) if j != i]
        out[q] = [ids[j] for j in sorted(rest, key=lambda j: (-score[j], ids[j]))[:k]]
    return out


def test_one_partition_is_exact_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    x[40:] = x[0]
    bad = [(100, None), (101, [0.0] * 8), (102, [None] + [1.0] * 7), (103, [float("nan")] * 8), (104, [1.0]), (None, [1.0] * 8), (105, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    rows = neighbours.search(df, F.col("id") % 20 == 0).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == exact(list(range(60)), x.astype(np.float64), [0, 20, 40], 20)
    assert neighbours.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_more_ties_than_neighbours(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(400)] + [(1000, [1.0, 0.0])], "vec_id long, embedding array<float>")
    rows = neighbours.search(df, F.col("id") == 1000, neighbours.Settings(fewest=1)).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in rows] == [(i, 1.0) for i in range(20)]


def test_two_levels_of_partitions(spark):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((60, 16))[rng.integers(0, 60, 6000)] + 0.3 * rng.standard_normal((6000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    s = neighbours.Settings(rows=100, most=8, sample=600, block=100)
    routers = neighbours.index(neighbours.usable(df, "vec_id", "embedding").select("vector"), s)
    assert routers.parts == 4 and len(routers.second) == 8 and np.exp(routers(x[:9].astype(float))).sum(axis=1) == pytest.approx(1)
    rows = neighbours.search(df, F.col("id") % 100 == 0, s).collect()
    wanted = exact(list(range(6000)), x.astype(np.float64), range(0, 6000, 100), 20)
    hit = sum(r["vec_id"] in wanted[r["query_id"]] for r in rows)
    assert len(rows) == 1200 and hit / 1200 > 0.9


def test_recall_over_partitions(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    s = neighbours.Settings(rows=400, sample=2048, block=200)
    rows = neighbours.search(df, F.col("id") % 100 == 0, s).collect()
    wanted = exact(list(range(6000)), x.astype(np.float64), range(0, 6000, 100), 20)
    hit = sum(r["vec_id"] in wanted[r["query_id"]] for r in rows)
    assert len(rows) == 1200 and hit / 1200 > 0.9


@pytest.mark.parametrize("clusters", [0, 300])
def test_recall_of_the_default_settings(spark, clusters):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40_000, 64))
    if clusters:
        x = rng.standard_normal((clusters, 64))[rng.integers(0, clusters, len(x))] + 0.3 * x
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float64()))}))
    rows = neighbours.search(df, F.col("id") % 400 == 0).collect()
    score = x[::400] @ x.T
    score[np.arange(100), np.arange(0, 40_000, 400)] = -np.inf
    wanted = np.argpartition(-score, 19, axis=1)[:, :20]
    hit = sum(r["vec_id"] in wanted[r["query_id"] // 400] for r in rows)
    assert len(rows) == 2000 and hit / 2000 >= 0.9, hit


def test_balanced_parts():
    x = np.random.default_rng(0).standard_normal((777, 8))
    sizes = np.bincount(neighbours.balanced_parts(neighbours.neighbour_graph(x, 8), 8))
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2


def test_query(spark):
    """The registered query, whose partitions are learnt on small tables too, against brute force."""
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toArrow()
    ids, x = table["vec_id"].to_pylist(), np.array(table["embedding"].to_pylist(), np.float64)
    assert neighbours.index(neighbours.usable(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding").select("vector"), neighbours.Settings()).first.w2.shape[1] == 8
    rows = op07_neighbours.query(spark, folder).collect()
    queries = [i for i in ids if i % 20 == 0]
    wanted = exact(ids, x, queries, 20)
    assert len(rows) == 20 * len(queries)
    assert sum(r["vec_id"] in wanted[r["query_id"]] for r in rows) >= 0.9 * len(rows)
    for r in rows:
        assert r["score"] == pytest.approx((x[ids.index(r["query_id"])] * x[ids.index(r["vec_id"])]).sum(), abs=1e-12) and r["query_id"] != r["vec_id"]
