"""Queries on intervals, counts and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropletry.functions.phred import string_hash
from dropletry.operators import clusters, expression, intervals
from dropletry.plans.adapters import table


def spans(s: SparkSession, f: str) -> DataFrame:
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long")
    return table(s, f, "orders").select(F.col("o_orderpriority").alias("chrom"), (day * 400 + F.col("o_orderkey") % 400).alias("beg"), (day * 400 + F.col("o_orderkey") % 400 + F.col("o_custkey") % 20).alias("end"))


def merge_intervals(s: SparkSession, f: str) -> DataFrame:
    return intervals.merge_overlaps(spans(s, f))


def interval_total_length(s: SparkSession, f: str) -> DataFrame:
    return intervals.total_length(intervals.merge_overlaps(spans(s, f)))


def targets(s: SparkSession, f: str) -> DataFrame:
    chrom = F.when(F.col("s_suppkey") % 3 == 0, "R").when(F.col("s_suppkey") % 3 == 1, "A").otherwise("N")
    return table(s, f, "supplier").select(chrom.alias("chrom"), "s_suppkey", (F.col("s_suppkey") * 20).alias("b_beg"), (F.col("s_suppkey") * 20 + F.col("s_nationkey")).alias("b_end"))


def range_join_points(s: SparkSession, f: str) -> DataFrame:
    points = table(s, f, "lineitem").select(F.col("l_returnflag").alias("chrom"), "l_orderkey", F.col("l_partkey").alias("a_beg"), F.col("l_partkey").alias("a_end"))
    return intervals.range_join(points, targets(s, f), 32).groupBy("s_suppkey").agg(F.count("*").alias("n"), F.sum("l_orderkey").cast("long").alias("orders"))


def range_join_contains(s: SparkSession, f: str) -> DataFrame:
    a = table(s, f, "orders").select(F.lit("1").alias("chrom"), "o_orderkey", (F.col("o_custkey") * 10).alias("a_beg"), (F.col("o_custkey") * 10 + F.col("o_orderkey") % 7).alias("a_end"))
    b = table(s, f, "customer").select(F.lit("1").alias("chrom"), "c_custkey", (F.col("c_custkey") * 10 - 2).alias("b_beg"), (F.col("c_custkey") * 10 - 2 + F.col("c_nationkey")).alias("b_end"))
    return intervals.range_join(a, b, 32, contained=True).select("o_orderkey", "c_custkey")


def segments(s: SparkSession, f: str) -> DataFrame:
    beg = F.col("l_partkey") * 10
    return table(s, f, "lineitem").select(
        F.col("l_suppkey").alias("cell_id"), F.col("l_orderkey").alias("umi"), F.col("l_returnflag").alias("chrom"), F.col("l_linestatus").alias("strand"),
        beg.alias("a_beg"), (beg + F.col("l_linenumber") * 3).alias("a_end"),
    )


def genes(s: SparkSession, f: str) -> DataFrame:
    chrom = F.when(F.col("p_partkey") % 3 == 0, "R").when(F.col("p_partkey") % 3 == 1, "A").otherwise("N")
    return table(s, f, "part").select(
        F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("element"), chrom.alias("chrom"), F.when(F.col("p_size") % 2 == 0, "O").otherwise("F").alias("strand"),
        (F.col("p_partkey") * 10).alias("b_beg"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("b_end"),
    )


def dge_counts(s: SparkSession, f: str) -> DataFrame:
    return expression.element_counts(segments(s, f), genes(s, f), 64)


def dge_unique_gene(s: SparkSession, f: str) -> DataFrame:
    rows = expression.one_gene_per_locus(segments(s, f), genes(s, f), 64, 1000)
    return rows.groupBy("cell_id", "element").agg(F.count("*").alias("n"))


def range_join_stranded(s: SparkSession, f: str) -> DataFrame:
    hits = intervals.range_join(segments(s, f), genes(s, f), 64, ["chrom", "strand"])
    return hits.groupBy("element", "strand").agg(F.count("*").alias("n"), F.sum("umi").cast("long").alias("umis"))


def region_parse(s: SparkSession, f: str) -> DataFrame:
    text = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("chr"), "s_nationkey", F.lit(":"), "s_suppkey", F.lit("-"), F.col("s_suppkey") + 10))
    text = text.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("chr"), "s_nationkey", F.lit(":"), "s_suppkey", F.lit(":7:-"))).otherwise(F.concat(F.lit("chr"), "s_nationkey"))
    return table(s, f, "supplier").select("s_suppkey", intervals.parse_region(text).alias("r")).select("s_suppkey", "r.*")


def hash_chunks(s: SparkSession, f: str) -> DataFrame:
    rows = table(s, f, "customer").select(string_hash(F.col("c_name")).alias("hash"), expression.chunk_of(F.col("c_name")).alias("chunk"))
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.min("hash").alias("least"))


def barcode_prefix_hist(s: SparkSession, f: str) -> DataFrame:
    return expression.prefix_histogram(table(s, f, "documents").select(F.col("text").alias("barcode")), 6)


def hits(s: SparkSession, f: str) -> DataFrame:
    rows = table(s, f, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), (F.col("l_suppkey") % 10).alias("cell_id"), (F.col("l_partkey") % 50).alias("tx"), (F.col("l_orderkey") % 100).alias("umi"), (F.col("l_linenumber") % 3).alias("nm")
    )
    return expression.least_mismatches(rows, 1)


def tx_fractional_counts(s: SparkSession, f: str) -> DataFrame:
    return expression.transcript_counts(hits(s, f)).withColumn("n_share", F.round("n_share", 6))


def multinom_em_step(s: SparkSession, f: str) -> DataFrame:
    counts = table(s, f, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), (F.col("l_partkey") % 40).alias("gene")).agg(F.count("*").alias("n"))
    w = table(s, f, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.array(*(F.when(F.col("s_suppkey") % 2 == j, 0.8).otherwise(0.2) for j in range(2))).alias("w"))
    return expression.mixture_step(counts, w, 2).select("cell_id", F.round(F.col("w")[0], 6).alias("w0"), F.round(F.col("w")[1], 6).alias("w1"))


def simulated_mux(s: SparkSession, f: str) -> DataFrame:
    rows = table(s, f, "orders").select(F.col("o_custkey").cast("string").alias("barcode"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("umi"))
    partners = table(s, f, "customer").select(F.col("c_custkey").cast("string").alias("barcode"), (F.col("c_custkey") + 1).cast("string").alias("partner"))
    return expression.multiplexed(rows, partners).groupBy("merged").agg(F.count("*").alias("n"))


def variant_classify(s: SparkSession, f: str) -> DataFrame:
    ref = F.expr("substring('ACGTACGTAC', cast(p_partkey % 7 % 4 + 1 as int), cast(p_partkey % 7 % 3 + 1 as int))")
    alt = F.expr("CASE WHEN p_partkey % 11 = 10 THEN '<DEL>' ELSE substring('ACGTACGTAC', cast(p_partkey % 11 % 4 + 1 as int), cast(p_partkey % 11 % 3 + 1 as int)) END")
    rows = table(s, f, "part").groupBy(ref.alias("ref"), alt.alias("alt")).agg(F.count("*").alias("n"))
    return rows.select("ref", "alt", "n", expression.variant_class(F.col("ref"), F.col("alt")).alias("class"), expression.is_transition(F.col("ref"), F.col("alt")).alias("ts"))


def louvain_pass(s: SparkSession, f: str) -> DataFrame:
    line, order = table(s, f, "lineitem"), table(s, f, "orders")
    rows = line.join(order, line.l_orderkey == order.o_orderkey).join(table(s, f, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, f, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = rows.where("c_nationkey <> s_nationkey").groupBy(F.least("c_nationkey", "s_nationkey").alias("src"), F.greatest("c_nationkey", "s_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("w"))
    start = table(s, f, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") % 6).alias("community"))
    return clusters.louvain_round(edges, start).withColumn("gain", F.round("gain", 6))


QUERIES = {
    "merge_intervals": merge_intervals, "interval_total_length": interval_total_length, "range_join_points": range_join_points, "range_join_contains": range_join_contains,
    "range_join_stranded": range_join_stranded, "region_parse": region_parse, "dge_counts": dge_counts, "dge_unique_gene": dge_unique_gene, "hash_chunks": hash_chunks,
    "barcode_prefix_hist": barcode_prefix_hist, "tx_fractional_counts": tx_fractional_counts, "multinom_em_step": multinom_em_step, "simulated_mux": simulated_mux,
    "variant_classify": variant_classify, "louvain_pass": louvain_pass,
}

# ---- The same in SQL ----
_SPANS = "iv AS (SELECT DISTINCT o_orderpriority AS chrom, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 400 + o_orderkey % 400 AS beg, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 400 + o_orderkey % 400 + o_custkey % 20 AS \"end\" FROM orders)"
_MERGED = _SPANS + """, m AS (SELECT *, CASE WHEN beg <= max("end") OVER (PARTITION BY chrom ORDER BY beg, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM iv),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY beg, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m),
  merged AS (SELECT chrom, min(beg) AS beg, max("end") AS "end" FROM g GROUP BY chrom, island)"""
_CHROM = "CASE {0} % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'N' END"
_TARGETS = f"t AS (SELECT {_CHROM.format('s_suppkey')} AS chrom, s_suppkey, s_suppkey * 20 AS b_beg, s_suppkey * 20 + s_nationkey AS b_end FROM supplier)"
_SEGMENTS = f"""seg AS (SELECT l_suppkey AS cell_id, l_orderkey AS umi, l_returnflag AS chrom, l_linestatus AS strand, l_partkey * 10 AS a_beg, l_partkey * 10 + l_linenumber * 3 AS a_end FROM lineitem),
  gene AS (SELECT p_brand || '-' || p_partkey AS element, {_CHROM.format('p_partkey')} AS chrom, CASE WHEN p_size % 2 = 0 THEN 'O' ELSE 'F' END AS strand, p_partkey * 10 AS b_beg, p_partkey * 10 + p_size AS b_end FROM part),
  hit AS (SELECT * FROM seg JOIN gene USING (chrom, strand) WHERE a_beg <= b_end AND b_beg <= a_end)"""
_HASH = "list_reduce(list_prepend({1}::BIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 101 + c) % 4294967296)"
ORACLE_SQL = {
    "merge_intervals": f"WITH {_MERGED} SELECT * FROM merged",
    "interval_total_length": f'WITH {_MERGED} SELECT chrom, CAST(sum("end" - beg + 1) AS BIGINT) AS bases FROM merged GROUP BY 1',
    "range_join_points": f"WITH {_TARGETS} SELECT s_suppkey, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS orders FROM lineitem JOIN t ON l_returnflag = chrom AND l_partkey BETWEEN b_beg AND b_end GROUP BY 1",
    "range_join_contains": "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON c_custkey * 10 - 2 <= o_custkey * 10 AND o_custkey * 10 + o_orderkey % 7 <= c_custkey * 10 - 2 + c_nationkey",
    "range_join_stranded": f"WITH {_SEGMENTS} SELECT element, strand, count(*) AS n, CAST(sum(umi) AS BIGINT) AS umis FROM hit GROUP BY 1, 2",
    "region_parse": "SELECT s_suppkey, 'chr' || s_nationkey AS chrom, CASE WHEN s_suppkey % 3 = 2 THEN 1 ELSE s_suppkey END AS beg, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey + 10 WHEN 1 THEN s_suppkey + 6 END AS \"end\", CASE WHEN s_suppkey % 3 = 1 THEN '-' END AS strand FROM supplier",
    "dge_counts": f"WITH {_SEGMENTS} SELECT element, cell_id, count(DISTINCT umi) AS n_umi FROM hit GROUP BY 1, 2",
    "dge_unique_gene": f"WITH {_SEGMENTS}, o AS (SELECT cell_id, umi, chrom, (a_beg + a_end) // 500 AS bin, min(element) AS element FROM hit GROUP BY 1, 2, 3, 4) SELECT cell_id, element, count(*) AS n FROM o GROUP BY 1, 2",
    "hash_chunks": f"WITH h AS (SELECT {_HASH.format('c_name', 0x811C9DC5)} AS h FROM customer) SELECT h % 100 AS chunk, count(*) AS n, min(h) AS least FROM h GROUP BY 1",
    "barcode_prefix_hist": "WITH c AS (SELECT substr(text, 1, 6) AS p, count(*) AS n_seen FROM documents GROUP BY 1), h AS (SELECT n_seen, count(*) AS n_prefix FROM c GROUP BY 1) SELECT n_seen, n_prefix, CAST(sum(n_prefix) OVER (ORDER BY n_seen DESC) AS BIGINT) AS n_at_least FROM h",
    "tx_fractional_counts": "WITH r AS (SELECT l_orderkey AS read_id, l_suppkey % 10 AS cell_id, l_partkey % 50 AS tx, l_orderkey % 100 AS umi, l_linenumber % 3 AS nm, min(l_linenumber % 3) OVER (PARTITION BY l_orderkey) AS m FROM lineitem), k AS (SELECT *, count(*) OVER (PARTITION BY read_id) AS n_hit FROM r WHERE nm = m AND m <= 1), u AS (SELECT cell_id, tx, umi, count(*) AS n_read, min(n_hit) AS n_hit FROM k GROUP BY 1, 2, 3) SELECT cell_id, tx, count(*) AS n_umi, CAST(sum(n_read) AS BIGINT) AS n_read, round(sum(1e0 / n_hit), 6) AS n_share FROM u GROUP BY 1, 2",
    "multinom_em_step": "WITH c AS (SELECT l_suppkey AS cell_id, l_partkey % 40 AS gene, count(*) AS n FROM lineitem GROUP BY 1, 2), w AS (SELECT s_suppkey AS cell_id, CASE WHEN s_suppkey % 2 = 0 THEN 0.8e0 ELSE 0.2e0 END AS w0, CASE WHEN s_suppkey % 2 = 1 THEN 0.8e0 ELSE 0.2e0 END AS w1 FROM supplier), p AS (SELECT gene, sum(n * w0) + 0.5e0 AS p0, sum(n * w1) + 0.5e0 AS p1 FROM c JOIN w USING (cell_id) GROUP BY 1), t AS (SELECT sum(p0) AS t0, sum(p1) AS t1 FROM p), pi AS (SELECT avg(w0) AS i0, avg(w1) AS i1 FROM w), x AS (SELECT cell_id, sum(n * ln(p0 / t0)) + ln(max(i0)) AS x0, sum(n * ln(p1 / t1)) + ln(max(i1)) AS x1 FROM c JOIN p USING (gene) CROSS JOIN t CROSS JOIN pi GROUP BY 1), e AS (SELECT cell_id, exp(x0 - greatest(x0, x1)) AS e0, exp(x1 - greatest(x0, x1)) AS e1 FROM x) SELECT cell_id, round(e0 / (e0 + e1), 6) AS w0, round(e1 / (e0 + e1), 6) AS w1 FROM e",
    "simulated_mux": f"SELECT CASE WHEN {_HASH.format("('u' || o_orderkey)", 0)} % 65535 < 32767 THEN o_custkey || '.' || (o_custkey + 1) ELSE (o_custkey + 1) || '.' || o_custkey END AS merged, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "variant_classify": "WITH v AS (SELECT substr('ACGTACGTAC', p_partkey % 7 % 4 + 1, p_partkey % 7 % 3 + 1) AS ref, CASE WHEN p_partkey % 11 = 10 THEN '<DEL>' ELSE substr('ACGTACGTAC', p_partkey % 11 % 4 + 1, p_partkey % 11 % 3 + 1) END AS alt FROM part) SELECT ref, alt, count(*) AS n, CASE WHEN alt[1] = '<' THEN 'SV' WHEN ref = alt THEN 'REF' WHEN len(ref) = len(alt) AND len(ref) = 1 THEN 'SNP' WHEN len(ref) = len(alt) THEN 'MNP' WHEN len(ref) < len(alt) AND starts_with(alt, ref) THEN 'INS' WHEN len(ref) > len(alt) AND starts_with(ref, alt) THEN 'DEL' ELSE 'COMPLEX' END AS class, (ref || alt) IN ('AG', 'GA', 'CT', 'TC') AS ts FROM v GROUP BY 1, 2",
    "louvain_pass": "WITH e AS (SELECT least(c_nationkey, s_nationkey) AS src, greatest(c_nationkey, s_nationkey) AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2), b AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e), d AS (SELECT src AS node, sum(w) AS degree FROM b GROUP BY 1), c AS (SELECT n_nationkey AS node, n_nationkey % 6 AS community FROM nation), m AS (SELECT sum(w) AS m2 FROM b), t AS (SELECT community, sum(degree) AS total FROM d JOIN c USING (node) GROUP BY 1), o AS (SELECT node, community, sum(w_in) AS w_in FROM (SELECT src AS node, community, w AS w_in FROM b JOIN c ON dst = node UNION ALL SELECT node, community, 0e0 FROM c) GROUP BY 1, 2), s AS (SELECT o.node, o.community, c.community AS own, w_in - degree * (total - CASE WHEN o.community = c.community THEN degree ELSE 0e0 END) / m2 AS gain FROM o JOIN c ON o.node = c.node JOIN d ON o.node = d.node JOIN t ON o.community = t.community CROSS JOIN m) SELECT node, community, round(gain, 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, CASE WHEN community <> own THEN 1 ELSE 0 END, community) AS r FROM s) WHERE r = 1",
}
