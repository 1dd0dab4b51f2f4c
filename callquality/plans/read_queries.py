"""Queries of flank search and read measurement: parts stand in for loci, line items for reads that meet them.

The bases of a locus come from digests of its key, so every locus has flanks of its own; every seventh has its left flank
twice in its window, every eleventh an N in the right one. Reads span their locus or end inside it, some with a base off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callquality.operators import reads
from callquality.plans.driver_queries import query, table

_DNA = "translate(md5(concat('{}', CAST(p_partkey AS VARCHAR(20)))), '0123456789abcdef', 'ACGTACGTACGTACGT')"
#: name -> expression, each step on the one before; the same text in Spark and in the SQL to compare with.
_LOCUS = {"locus_id": "CAST(p_partkey AS VARCHAR(20))", "k": "CAST(p_partkey AS BIGINT)", "lf": _DNA.format("l"), "rf": _DNA.format("r"), "motif": "CASE p_partkey % 4 WHEN 0 THEN 'CAG' WHEN 1 THEN 'AT' WHEN 2 THEN 'AAAG' ELSE 'A' END"}
_WINDOW = {
    "locus_id": "locus_id", "k": "k", "lf": "lf", "motif": "motif", "chrom": "CAST(k % 3 AS VARCHAR(20))", "rf": "CASE WHEN k % 11 = 0 THEN concat('ACN', substr(rf, 4, 29)) ELSE rf END",
    '"start"': "1000 * k + 32", '"end"': "1000 * k + 32 + length(motif) * (5 + k % 6)", "window_start": "1000 * k",
}
_WHOLE = "concat(lf, repeat(motif, CAST(5 + k % 6 AS INT)), rf, CASE WHEN k % 7 = 0 THEN substr(lf, 13, 20) ELSE 'C' END)"
#: A read: 25 bases beside the repeat where it is whole; kind 3 has a base off, outside the part that must be exact.
_READ = {
    "locus_id": "locus_id", "name": "concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)))", "flag": "CAST(l_linenumber % 2 * 16 AS INT)", "chrom": "chrom",
    "mapq": "CAST(l_quantity AS INT)", '"start"': "CASE WHEN l_orderkey % 4 = 2 THEN \"end\" - length(motif) * n ELSE \"start\" - 25 END",
    "seq": """CASE l_orderkey % 4 WHEN 0 THEN concat(substr(lf, 8, 25), repeat(motif, n), substr(rf, 1, 25)) WHEN 1 THEN concat(substr(lf, 8, 25), repeat(motif, n), substr(rf, 1, CAST(l_linenumber AS INT)))
      WHEN 2 THEN concat(repeat(motif, n), substr(rf, 1, 25)) ELSE concat(substr(lf, 8, 8), translate(substr(lf, 16, 1), 'ACGT', 'CGTA'), substr(lf, 17, 16), repeat(motif, n), substr(rf, 1, 25)) END""",
}
_COUNT = "CAST(5 + k % 6 + l_linenumber - 3 AS INT)"


def _steps(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {name}".replace('"', "`").replace("VARCHAR(20)", "STRING") for name, e in columns.items()]


def _listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {name}" for name, e in columns.items())


_SQL = f"""WITH a AS (SELECT {_listed(_LOCUS)} FROM part), w AS (SELECT {_listed(_WINDOW)} FROM a), loci AS (SELECT *, {_WHOLE} AS window_seq, substr(lf, 13, 20) AS left20, substr(rf, 1, 20) AS right20 FROM w),
  told AS (SELECT *, NOT contains(left20 || right20, 'N') AND len(list_filter(range(0, length(window_seq) - 19), lambda i: hamming(substr(window_seq, i + 1, 20), left20) <= 1)) = 1
    AND len(list_filter(range(0, length(window_seq) - 19), lambda i: hamming(substr(window_seq, i + 1, 20), right20) <= 1)) = 1 AS fine FROM loci)"""
_READS = f"""{_SQL}, n AS (SELECT *, {_COUNT} AS n FROM lineitem JOIN loci ON l_partkey = k), r0 AS (SELECT {_listed(_READ)} FROM n), r AS (SELECT *, concat(repeat('I', CAST(length(seq) // 2 AS INT)), repeat('5', CAST(length(seq) - length(seq) // 2 AS INT))) AS qual FROM r0),
  j AS (SELECT r.*, motif, left20, right20, told."start" AS ls, told."end" AS le, r."start" AS rs, length(seq) AS size FROM r JOIN told USING (locus_id) WHERE fine AND r."start" < le + 20 AND r."start" + length(seq) > ls - 20),
  p AS (SELECT *, list_filter(range(0, size - 19), lambda i: hamming(substr(seq, i + 1, 20), left20) <= 1 AND substr(seq, i + 16, 5) = substr(left20, 16, 5) AND abs(rs + i - ls + 20) <= 10) AS a,
    list_filter(range(0, size - 19), lambda i: hamming(substr(seq, i + 1, 20), right20) <= 1 AND substr(seq, i + 1, 5) = substr(right20, 1, 5) AND abs(rs + i - le) <= 10) AS b, greatest(8, 2 * length(motif)) AS least FROM j),
  s AS (SELECT *, CASE WHEN len(a) = 1 AND len(b) = 1 THEN 'spanning' WHEN len(a) = 1 THEN 'left' ELSE 'right' END AS kind FROM p WHERE len(a) <= 1 AND len(b) <= 1 AND len(a) + len(b) > 0),
  c AS (SELECT *, CASE WHEN kind = 'right' THEN list_max(list_filter(range(0, least(20, b[1]) + 1), lambda x: right(left20, x) = substr(seq, 1, x))) ELSE a[1] + 20 END AS low,
    CASE WHEN kind = 'left' THEN size - list_max(list_filter(range(0, least(20, size - a[1] - 20) + 1), lambda x: right(seq, x) = substr(right20, 1, x))) ELSE b[1] END AS high FROM s),
  m AS (SELECT *, CASE kind WHEN 'spanning' THEN low <= high WHEN 'left' THEN high - low >= least AND contains(repeat(motif, 30), substr(seq, high - least + 1, least)) AND rs + size < le + 20
    ELSE high - low >= least AND contains(repeat(motif, 30), substr(seq, low + 1, least)) AND rs > ls - 20 END AS good FROM c),
  measured AS (SELECT locus_id, kind, CAST(high - low AS INT) AS length, mapq, CASE WHEN high > low THEN CAST(round_even(list_sum(list_transform(range(low, high), lambda i: ascii(substr(qual, i + 1, 1)) - 33)) / (high - low), 0) AS INT) ELSE -1 END AS quality,
    CASE WHEN flag = 16 THEN '-' ELSE '+' END AS strand, name FROM m WHERE good)"""  # fmt: skip


def _loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_steps(_LOCUS)).selectExpr(*_steps(_WINDOW)).selectExpr("*", f"{_WHOLE} AS window_seq")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "lineitem").join(_loci(spark, sf_dir), F.col("l_partkey") == F.col("k")).selectExpr("*", f"{_COUNT} AS n").selectExpr(*_steps(_READ))
    half = "CAST(length(seq) DIV 2 AS INT)"
    return met.drop("locus_id").selectExpr("*", f"concat(repeat('I', {half}), repeat('5', length(seq) - {half})) AS qual", "concat(length(seq), 'M') AS cigar")


@query(f"""{_SQL} SELECT locus_id, left20 AS left_flank, right20 AS right_flank, fine AS has_unique_flanks FROM told""")
def unique_flanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.flank_table(_loci(spark, sf_dir))
    return found.select("locus_id", "left_flank", "right_flank", "has_unique_flanks")


@query(f"""{_READS} SELECT * FROM measured""")
def measured_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.measure_reads(_reads(spark, sf_dir), _loci(spark, sf_dir))


@query(f"""{_READS}, met AS (SELECT loci.locus_id, count(*) AS n_reads_overlapping, count(*) FILTER (r.mapq < 20) AS n_reads_mapq_below_20 FROM loci JOIN r ON r.locus_id = loci.locus_id AND r."start" < loci."end" + 20 AND r."start" + length(seq) > loci."start" - 20 GROUP BY ALL),
  packed AS (SELECT locus_id, string_agg(concat_ws(':', kind, length, mapq, quality, strand), ',' ORDER BY name, concat_ws(':', kind, length, mapq, quality, strand)) AS measured_reads FROM measured GROUP BY ALL)
  SELECT locus_id, coalesce(n_reads_overlapping, 0) AS n_reads_overlapping, coalesce(n_reads_mapq_below_20, 0) AS n_reads_mapq_below_20, coalesce(measured_reads, '') AS measured_reads FROM loci LEFT JOIN met USING (locus_id) LEFT JOIN packed USING (locus_id)""")  # fmt: skip
def read_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    loci, found = _loci(spark, sf_dir), _reads(spark, sf_dir)
    return reads.locus_summary(loci, found, reads.measure_reads(found, loci))
