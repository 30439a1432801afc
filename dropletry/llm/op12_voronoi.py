"""op12: the 20 largest integer inner products of every twentieth vector, exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.llm import voronoi
from dropletry.llm.tables import table

#: The same over all pairs of a query and a row.
SQL = """WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM x q JOIN x c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


def query(spark: SparkSession, folder: str) -> DataFrame:
    return voronoi.search(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)
