"""op6: the components of documents whose five-word shingles have a Jaccard similarity of 0.8 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.llm import jaccard
from dropletry.llm.tables import table

#: The same by counting common shingles of all pairs that have one.
SQL = r"""WITH RECURSIVE cut AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
  shingles AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM cut),
  sizes AS MATERIALIZED (SELECT doc_id, count(shingle) AS n_shingles FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY 1),
  common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS MATERIALIZED (SELECT u, v FROM common JOIN sizes x ON u = x.doc_id JOIN sizes y ON v = y.doc_id WHERE 100 * n >= 80 * (x.n_shingles + y.n_shingles - n)),
  reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON reach.other = links.u)
SELECT doc_id, n_shingles, component_id FROM sizes JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.classes(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))
