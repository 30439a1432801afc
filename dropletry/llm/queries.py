"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dropletry.llm import (
    op01_bpe,
    op02_toxicity,
    op03_lines,
    op04_chat,
    op05_tiff,
    op06_jaccard,
    op07_neighbours,
    op08_mixing,
    op09_packing,
    op10_extraction,
    op11_manifest,
    op12_voronoi,
    op13_negatives,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op01_bpe.query,
    "op2_toxicity": op02_toxicity.query,
    "op3_lines": op03_lines.query,
    "op4_chat": op04_chat.query,
    "op5_tiff": op05_tiff.query,
    "op6_jaccard": op06_jaccard.query,
    "op7_neighbours": op07_neighbours.query,
    "op8_mixing": op08_mixing.query,
    "op9_packing": op09_packing.query,
    "op10_extraction": op10_extraction.query,
    "op11_manifest": op11_manifest.query,
    "op12_voronoi": op12_voronoi.query,
    "op13_negatives": op13_negatives.query,
}
ORACLE_SQL: dict[str, str] = {
    "op6_jaccard": op06_jaccard.SQL,
    "op11_manifest": op11_manifest.SQL,
    "op12_voronoi": op12_voronoi.SQL,
    "op13_negatives": op13_negatives.SQL,
}
