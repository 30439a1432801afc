"""op11: a Merkle manifest of all documents by source, with a proof for each row, tried on tampered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.llm import merkle
from dropletry.llm.tables import table

_FIELDS = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR"]


def _row(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in [*_FIELDS, text]) + ")"


#: The same level by level.  The checksum is worked out bit by bit.
SQL = f"""WITH RECURSIVE
  docs AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, range(9 * strlen(doc_id::VARCHAR))), lambda c, k: CASE WHEN k % 9 = 0
      THEN xor(c, ascii(substr(doc_id::VARCHAR, k // 9 + 1, 1))::BIGINT) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) & 1 = 1 AS tampered FROM documents),
  leaves AS MATERIALIZED (SELECT doc_id, source, {_row("text")} AS leaf, CASE WHEN tampered THEN {_row("replace(text, chr(10), '')")} ELSE {_row("text")} END AS claim FROM docs),
  placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM leaves),
  inner_nodes(source, level, place, digest, n) AS (SELECT source, 0, place, leaf, n FROM placed UNION ALL
    SELECT source, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM inner_nodes WHERE n > 1 GROUP BY source, level, place // 3, n),
  subroots AS MATERIALIZED (SELECT source, digest AS subroot, level AS height, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM inner_nodes WHERE n = 1),
  outer_nodes(level, place, digest, n) AS (SELECT 0, place, subroot, n FROM subroots UNION ALL
    SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM outer_nodes WHERE n > 1 GROUP BY level, place // 3, n),
  nodes AS MATERIALIZED (SELECT FALSE AS over, source, level, place, digest, n FROM inner_nodes UNION ALL SELECT TRUE, NULL, level, place, digest, n FROM outer_nodes),
  steps AS (SELECT d.doc_id, d.leaf, d.claim, s.subroot, s.height, s.place AS spot, d.source, unnest(range(s.height + (SELECT max(level) FROM outer_nodes))) AS step, d.place FROM placed d JOIN subroots s ON d.source IS NOT DISTINCT FROM s.source),
  ways AS (SELECT *, step >= height AS over, CASE WHEN step >= height THEN step - height ELSE step END AS level, CASE WHEN step >= height THEN spot // (3 ** (step - height))::BIGINT ELSE place // (3 ** step)::BIGINT END AS own FROM steps),
  sides AS (SELECT w.doc_id, w.leaf, w.claim, w.place, w.source, w.step, coalesce(string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place < w.own), '') AS lefts, coalesce(string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place > w.own), '') AS rights
    FROM ways w LEFT JOIN nodes x ON x.over = w.over AND x.level = w.level AND (w.over OR x.source IS NOT DISTINCT FROM w.source) AND x.place // 3 = w.own // 3 AND x.place <> w.own GROUP BY ALL),
  proofs AS (SELECT source, place, string_agg(lefts || rights, '' ORDER BY step) AS siblings, list(lefts ORDER BY step) AS lefts, list(rights ORDER BY step) AS rights FROM sides GROUP BY 1, 2),
  folds(source, place, digest, lefts, rights) AS (SELECT d.source, d.place, d.claim, coalesce(p.lefts, []), coalesce(p.rights, []) FROM placed d LEFT JOIN proofs p ON d.source IS NOT DISTINCT FROM p.source AND d.place = p.place UNION ALL
    SELECT source, place, sha256(lefts[1] || digest || rights[1]), lefts[2:], rights[2:] FROM folds WHERE len(lefts) > 0),
  root AS (SELECT digest AS root FROM outer_nodes WHERE n = 1)
SELECT d.doc_id, d.leaf, s.subroot, root.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.digest AS folded_root, f.digest = root.root AS verified
FROM placed d JOIN subroots s ON d.source IS NOT DISTINCT FROM s.source CROSS JOIN root JOIN folds f ON d.source IS NOT DISTINCT FROM f.source AND d.place = f.place AND len(f.lefts) = 0
  LEFT JOIN proofs p ON d.source IS NOT DISTINCT FROM p.source AND d.place = p.place"""


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = merkle.manifest(merkle.document_leaves(spark, table(spark, folder, "documents"))).proofs()
    return found.withColumnRenamed("key", "doc_id").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", F.col("verified"))
