"""Queries of sources and sinks: documents that are written and streamed back, published versions, pruned scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callquality.operators.shared import shared_folder
from callquality.plans.driver_queries import WITH, calls, query, rounded, table
from callquality.sources import documents, io, merges, snapshots


@query(f"""{WITH}, a AS (SELECT person_id, floor(called)::BIGINT AS a, floor(truth)::BIGINT AS b, motif_size FROM calls)
  SELECT person_id AS sample_id, 2 * count(*) AS n, sum(a + b)::DOUBLE AS called, sum(3 + CASE WHEN a = b THEN 3 ELSE 0 END)::DOUBLE AS spanning, sum(2 * abs(a - b))::DOUBLE AS gaps, max(10 * motif_size)::DOUBLE AS longest, sum(2 * motif_size)::DOUBLE AS depth FROM a GROUP BY ALL""")  # fmt: skip
def document_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as nested documents, one a person, and their elements read back as a stream of loci."""
    a, b, m = F.floor("called").cast("int"), F.floor("truth").cast("int"), F.col("motif_size").cast("int")
    metric = lambda k, size: F.struct(F.lit(k).alias("AlleleNumber"), size.alias("AlleleSize"), m.cast("double").alias("Depth"))
    variant = F.struct(
        F.lit("CAG").alias("RepeatUnit"), F.concat(F.lit("chr1:100-"), 100 + 10 * m).alias("ReferenceRegion"), F.concat(a, F.lit("/"), b).alias("Genotype"), F.concat(F.lit("("), a, F.lit(", 3)")).alias("CountsOfSpanningReads"),
        F.struct(F.array(metric(1, a), metric(2, b)).alias("Alleles")).alias("AlleleQualityMetrics"),
    )
    locus = F.to_json(F.struct(F.col("rk").alias("LocusId"), F.lit(30.0).alias("Coverage"), F.lit(150.0).alias("ReadLength"), F.create_map("rk", variant).alias("Variants")))
    df = calls(spark, sf_dir)
    body = df.select("person_id", F.lit(1).alias("place"), F.concat(F.lit('"'), "rk", F.lit('": '), locus, F.lit(",")).alias("value"))
    people = df.select("person_id").distinct()
    head = people.select("person_id", F.lit(0).alias("place"), F.concat(F.lit('{"SampleParameters": {"SampleId": "'), "person_id", F.lit('"}, "LocusResults": {')).alias("value"))
    tail = people.select("person_id", F.lit(2).alias("place"), F.lit('"none": {"LocusId": "none"}}}').alias("value"))
    path = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    lines = head.unionByName(body).unionByName(tail).repartition("person_id").sortWithinPartitions("person_id", "place")
    lines.select("person_id", "value").write.partitionBy("person_id").option("compression", "gzip").text(path)
    rows = io.allele_rows(io.variant_rows(documents.stream_call_documents(spark, f"{path}/*/*.gz")))
    return rows.groupBy(F.col("sample_id").cast("long").alias("sample_id")).agg(
        F.count("*").alias("n"), F.sum("called").alias("called"), F.sum("spanning_at_called").cast("double").alias("spanning"), F.sum("het_gap").alias("gaps"), F.max("ref_size_bp").alias("longest"), F.sum("depth").alias("depth"),
    )


_MONTHS = "SELECT strftime(o_orderdate, '%Y-%m') AS month, month(o_orderdate) AS m, o_orderkey, o_totalprice FROM orders"


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.month("o_orderdate").alias("m"), "o_orderkey", "o_totalprice")


def _two_versions(spark: SparkSession, sf_dir: str) -> str:
    """A root with two versions: the second rebuilds May, lacks July and has December, which the first lacks."""
    root, rows = f"{shared_folder(spark)}/months-{uuid.uuid4().hex}", _months(spark, sf_dir)
    for number in (1, 2):
        own = rows.filter(F.col("m") != (12 if number == 1 else 7)).withColumn("total", F.col("o_totalprice") * F.when((F.col("m") == 5) & (F.lit(number) == 2), 2).otherwise(1))
        sources = own.groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum("total"), 2).alias("sum"))
        snapshots.publish(spark, root, sources, "month", ["n", "sum"], lambda changed, own=own: own.join(changed.select("month"), "month", "left_semi").select("month", "o_orderkey", "total"), note=f"orders of version {number}")
    return root


@query(f"""WITH o AS ({_MONTHS}), v AS (SELECT 1 AS version, month, o_totalprice AS total FROM o WHERE m <> 12 UNION ALL SELECT 2, month, o_totalprice * CASE WHEN m = 5 THEN 2 ELSE 1 END FROM o WHERE m <> 7)
  SELECT version, month, count(*) AS n, round(sum(total), 2) AS total FROM v GROUP BY ALL""")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of two published versions."""
    root = _two_versions(spark, sf_dir)
    both = [snapshots.read_snapshot(spark, root, n).withColumn("version", F.lit(n)) for n in (1, 2)]
    return both[0].unionByName(both[1]).groupBy("version", "month").agg(F.count("*").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query(f"""WITH o AS ({_MONTHS}), k AS (SELECT DISTINCT month, m FROM o) SELECT month, 'kept' AS fate FROM k WHERE m NOT IN (5, 7, 12) UNION ALL SELECT month, CASE m WHEN 5 THEN 'rebuilt' WHEN 7 THEN 'removed' ELSE 'new' END FROM k WHERE m IN (5, 7, 12)""")
def snapshot_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second version did with each part."""
    root = _two_versions(spark, sf_dir)
    old, new = (snapshots.read_manifest(spark, root, n).select(F.col("part_key").alias("month"), F.col("run").alias(f"run_{n}")) for n in (1, 2))
    fate = F.when(F.col("run_1").isNull(), "new").when(F.col("run_2").isNull(), "removed").when(F.col("run_1") == F.col("run_2"), "kept").otherwise("rebuilt")
    return old.join(new, "month", "full").select("month", fate.alias("fate"))


@query("""WITH o AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS population, o_orderpriority AS branch, o_custkey % 50 AS individual, o_totalprice FROM orders)
  SELECT population, branch, individual, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o WHERE population = 'a' AND branch <> '5-LOW' AND individual % 10 = 3 AND o_totalprice > 1000 GROUP BY ALL""")  # fmt: skip
def pruned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by population, branch and individual; the scan is cut to one population and the individuals of a list."""
    o = table(spark, sf_dir, "orders")
    path = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    individual = (F.col("o_custkey") % 50).alias("individual")
    parts = o.select(F.when(F.col("o_orderkey") % 3 == 0, "a").otherwise("b").alias("population"), F.col("o_orderpriority").alias("branch"), individual, "o_totalprice", "o_orderstatus")
    io.write_parts(parts.repartition("population", "branch", "individual"), path, "population", "branch", "individual")
    wanted = o.select(individual).distinct().filter("individual % 10 = 3")
    found = io.read_population(spark, path, parts.schema, "a", wanted, ["o_totalprice"]).filter("branch <> '5-LOW' AND o_totalprice > 1000")
    return found.groupBy("population", "branch", "individual").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_RUN = "SELECT person_id % 6 AS source, locus_id, rk, CASE WHEN locus_id % 2 = 0 THEN 1 ELSE 3 END AS unit, locus_id % 5 = 0 AND locus_id % 7 <> 0 AND locus_id % 11 <> 0 AS wanted"


@query(f"""{WITH}, a AS ({_RUN}, called, CASE WHEN locus_id % 4 = 0 THEN 'quick' ELSE 'full' END AS branch FROM calls WHERE locus_id % 7 <> 0), b AS ({_RUN}, called + (chrom % 2)::INT AS called, CASE WHEN locus_id % 3 = 0 THEN 'quick' ELSE 'full' END AS branch FROM calls WHERE locus_id % 11 <> 0),
  ea AS (SELECT source, locus_id, any_value(branch) AS branch, any_value(unit) AS unit, bool_or(wanted) AS wanted FROM a GROUP BY ALL), eb AS (SELECT source, locus_id, any_value(branch) AS branch, any_value(unit) AS unit, bool_or(wanted) AS wanted FROM b GROUP BY ALL),
  e AS (SELECT source, locus_id, ea.branch AS here, eb.branch AS there, coalesce(ea.unit, eb.unit) = 1 AS one, coalesce(ea.wanted, false) OR coalesce(eb.wanted, false) AS wanted FROM ea FULL JOIN eb USING (source, locus_id)),
  k AS (SELECT *, CASE WHEN one AND there = 'quick' AND here IS DISTINCT FROM 'quick' THEN CASE WHEN wanted THEN 'replaced' WHEN here IS NOT NULL THEN 'replaced_reference' ELSE 'added' END WHEN one AND here = 'full' AND there IS NULL THEN 'dropped' WHEN one AND here = 'quick' AND there = 'full' THEN 'quick_here' WHEN NOT one AND here <> there THEN 'other_branch' ELSE 'kept' END AS fate FROM e),
  m AS (SELECT a.source, a.called FROM a JOIN k USING (source, locus_id) WHERE fate IN ('kept', 'quick_here', 'other_branch') UNION ALL SELECT b.source, b.called FROM b JOIN k USING (source, locus_id) WHERE fate IN ('replaced', 'replaced_reference', 'added')),
  f AS (SELECT a.source, a.called <> b.called AS off FROM a JOIN b USING (source, rk) WHERE a.branch = 'quick' AND b.branch = 'quick' AND a.unit = 1)
  SELECT source, 'called' AS what, count(*) AS n, round(sum(called), 4) AS total FROM m GROUP BY ALL UNION ALL SELECT source, 'rows here', count(*), 0 FROM a GROUP BY ALL UNION ALL SELECT source, 'rows merged', count(*), 0 FROM m GROUP BY ALL UNION ALL SELECT source, 'entities ' || fate, count(*), 0 FROM k GROUP BY ALL
  UNION ALL SELECT source, 'compared', count(*), 0 FROM f GROUP BY ALL UNION ALL SELECT source, x.what, count(*), 0 FROM f, (VALUES ('differing'), ('differing called')) x(what) WHERE off GROUP BY ALL""")  # fmt: skip
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of six sources, merged, compared and published by source."""
    df = calls(spark, sf_dir)
    locus = F.col("locus_id")
    base = df.select((F.col("person_id") % 6).alias("source"), "locus_id", "rk", F.when(locus % 2 == 0, 1).otherwise(3).alias("unit"), ((locus % 5 == 0) & (locus % 7 != 0) & (locus % 11 != 0)).alias("wanted"), "called", "chrom", F.xxhash64("rk").alias("pos"))
    run = lambda d, part, called: d.select("source", "locus_id", "rk", "unit", "wanted", called.alias("called"), F.when(locus % part == 0, "quick").otherwise("full").alias("branch"), "pos")
    here, there = run(base.filter(locus % 7 != 0), 4, F.col("called")), run(base.filter(locus % 11 != 0), 3, F.col("called") + F.col("chrom") % 2)
    rows, summary = merges.merge_runs(spark, f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}", here, there, "source", "locus_id", ["rk"], "pos", "branch", "unit", "wanted")
    total = rows.groupBy("source").agg(F.lit("called").alias("what"), F.count("*").alias("n"), F.round(F.sum("called"), 4).alias("total"))
    return total.unionByName(summary.select("source", "what", "n", F.lit(0.0).alias("total")))
