"""Queries of whole jobs, parsing and the remaining operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callquality.functions import exprs as E
from callquality.functions import motifs as M
from callquality.functions import parse as P
from callquality.operators import categories, compare, evaluation, intervals, jobs, joins, metrics, reads, sampling, splits
from callquality.plans.driver_queries import _CATEGORY, _SPANS, _UNIT, _WINDOWS, WITH, _spans, _windows, calls, query, r6, rounded, table
from callquality.sources import io, models

def n_rows():
    return F.count("*").alias("n")


def _total(c, name: str):
    return F.sum(c).cast("long").alias(name)


# Jobs

_QUOTA = "CASE WHEN called * motif_size < 0 THEN 0 WHEN called * motif_size < 20 THEN 1 WHEN called * motif_size < 40 THEN 2 WHEN called * motif_size < 60 THEN 3 WHEN called * motif_size < 100 THEN 4 WHEN called * motif_size < 150 THEN 5 WHEN called * motif_size < 300 THEN 6 ELSE 7 END"


def _reasons():
    return {"small": F.col("called") < 3, "large_truth": F.col("truth") > 50, "partition": F.col("chrom") >= 22}


_KEPT = "SELECT * FROM calls WHERE regime <> 'R' AND dir_code IS NOT NULL AND NOT (called < 3) AND NOT (truth > 50) AND NOT (chrom >= 22)"


def _assembled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = calls(spark, sf_dir)
    return jobs.assembled(df, _reasons(), 40, ["rk"], ["person_id", "regime"], "motif_size", "called", F.col("dir_code").isNotNull(), F.col("regime") != "R")


@query(f"""{WITH}, k AS ({_KEPT}), c AS (SELECT rk, person_id, regime, CAST(motif_size = 1 AS INT) * 8 + {_QUOTA} AS cell FROM k),
  r AS (SELECT *, row_number() OVER (PARTITION BY person_id, regime ORDER BY md5('0|' || rk)) <= 40 AS chosen FROM c), cells AS (SELECT person_id, regime, cell, count(*) AS n, count_if(chosen) AS have FROM r GROUP BY ALL),
  lv AS (SELECT person_id, regime, CASE WHEN sum(n) <= 40 THEN max(n) END AS level FROM cells GROUP BY ALL),
  tried AS (SELECT person_id, regime, l.range AS level FROM cells, range(41) l GROUP BY ALL HAVING sum(least(n, l.range)) <= 40), lv2 AS (SELECT person_id, regime, max(level) AS level FROM tried GROUP BY ALL),
  need AS (SELECT cells.person_id, cells.regime, cell, least(n, coalesce(lv.level, lv2.level)) - have AS need FROM cells JOIN lv USING (person_id, regime) JOIN lv2 USING (person_id, regime)),
  t AS (SELECT r.*, row_number() OVER (PARTITION BY person_id, regime, cell ORDER BY md5('0-top-up|' || rk)) AS k FROM r WHERE NOT chosen)
  SELECT rk, true AS representative FROM r WHERE chosen UNION ALL SELECT rk, false FROM t JOIN need USING (person_id, regime, cell) WHERE k <= need""")  # fmt: skip
def assembled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir)[0].select("rk", "representative")


@query(f"""{WITH}, m AS (SELECT CASE WHEN called < 3 THEN 'small' WHEN truth > 50 THEN 'large_truth' WHEN chrom >= 22 THEN 'partition' END AS reason FROM calls WHERE regime <> 'R' AND dir_code IS NOT NULL)
  SELECT n.place, n.reason, count(m.reason) AS n FROM (VALUES ('small', 0), ('large_truth', 1), ('partition', 2)) n(reason, place) LEFT JOIN m USING (reason) GROUP BY ALL""")  # fmt: skip
def assembly_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir)[1]


@query(f"{WITH} SELECT CAST(motif_size = 1 AS INT) * 8 + {_QUOTA} AS cell, ({_UNIT.format(x='motif_size')}) * 8 + {_QUOTA} AS fine_cell, count(*) AS n FROM calls GROUP BY ALL")
def quota_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy(jobs.quota_cell("motif_size", "called").alias("cell"), jobs.quota_cell("motif_size", "called", True).alias("fine_cell")).agg(n_rows())


_VARIANTS = "(VALUES ('raw'), ('gated'), ('longer units'), ('short sizes')) n(variant)"
_FIXED_BY = "CASE WHEN variant <> 'raw' AND (variant <> 'longer units' OR motif_size > 1) AND (variant <> 'short sizes' OR size < 120) AND p_ok < 0.5 AND lcf > 0 THEN round_even(called / lcf, 0) ELSE called END"


@query(f"""{WITH}, x AS (SELECT *, {_FIXED_BY} AS value FROM calls, {_VARIANTS}),
  v AS (SELECT variant, rk, locus_id, truth, value, row_number() OVER (PARTITION BY variant, locus_id ORDER BY value NULLS LAST, rk) AS kc, row_number() OVER (PARTITION BY variant, locus_id ORDER BY truth NULLS LAST, rk) AS kt FROM x),
  m AS (SELECT t.variant, t.locus_id, t.truth, c.value AS e FROM v t JOIN v c ON t.variant = c.variant AND t.locus_id = c.locus_id AND t.kt = c.kc),
  f AS (SELECT *, e = 25 AS is_ref, bool_and(e = 25) OVER (PARTITION BY variant, locus_id) AS all_ref FROM m) SELECT variant, {_CATEGORY} AS category, count(*) AS n FROM f GROUP BY ALL""")  # fmt: skip
def categories_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, lcf = F.col("p_ok"), F.col("lcf")
    variants = {"raw": (None, None), "gated": (lcf, p), "longer units": (lcf, F.when(F.col("motif_size") > 1, p)), "short sizes": (lcf, F.when(F.col("size") < 120, p))}
    made = jobs.all_categories(calls(spark, sf_dir, dealt=True).withColumn("reference", F.lit(25.0)), variants, ["locus_id"], ["rk"], "called", "truth", "reference")
    return made.groupBy("variant", "category").agg(n_rows())


@query(f"""{WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY md5('7|' || rk)) AS k FROM calls) SELECT regime, count(*) AS n, round(avg(abs(truth - called)), 6) AS mae_raw,
  round(avg(abs(truth - CASE WHEN p_ok < 0.5 THEN corrected ELSE called END)), 6) AS mae_gated, count_if(p_ok < 0.5) AS n_gated,
  count_if(p_ok < 0.5 AND abs(truth - corrected) < abs(truth - called) - 1e-9) AS helped, count_if(p_ok < 0.5 AND abs(truth - corrected) > abs(truth - called) + 1e-9) AS hurt
  FROM r WHERE k <= 30 AND NOT (dir_code = 2 AND chrom = 3) GROUP BY regime""")  # fmt: skip
def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumn("contradicted", (F.col("dir_code") == 2) & (F.col("chrom") == 3))
    return rounded(jobs.evaluation_run(df, ["called", "truth", "p_ok", "lcf"], "sample_id", 30, ["rk"], contradicted="contradicted", seed=7))


_TRUTH = "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_partkey % 13 = 0 THEN 'n/a' ELSE CAST(l_suppkey % 3 AS VARCHAR) END AS ref, CAST(l_partkey % 3 AS VARCHAR) AS short, CAST(l_partkey % 2 AS VARCHAR) AS long, CAST(l_tax AS VARCHAR) AS pure FROM lineitem"


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as truths, and each row's place in the table: its file and its row there."""
    part = F.col("l_partkey")
    ref = F.when(part % 13 == 0, "n/a").otherwise((F.col("l_suppkey") % 3).cast("string"))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), ref.alias("ref"), (part % 3).cast("string").alias("short"), (part % 2).cast("string").alias("long"), F.col("l_tax").cast("string").alias("pure"), *place)


@query(f"""WITH t AS ({_TRUTH}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS k FROM t WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))
  SELECT id, try_cast(ref AS DOUBLE) AS reference, coalesce(try_cast(short AS DOUBLE) = try_cast(ref AS DOUBLE) AND try_cast(long AS DOUBLE) = try_cast(ref AS DOUBLE), false) AS is_reference, try_cast(pure AS DOUBLE) AS purity FROM r WHERE k = 1""")  # fmt: skip
def reference_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    # lines repeat in an order: of those, the first in the table
    return jobs.reference_table(_truth(spark, sf_dir), ids, "id", ["line", "file", "row"], "ref", "short", "long", "pure")


@query(f"""WITH t AS ({_TRUTH}) SELECT CASE WHEN ref = 'n/a' THEN NULL ELSE NOT (short = ref AND long = ref) END AS variant, count(*) AS n FROM t GROUP BY ALL""")
def variant_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir).groupBy(jobs.is_variant("ref", "short", "long").alias("variant")).agg(n_rows())


@query("SELECT p_type, 10 * l_quantity - 5 * l_linenumber > 36 OR 2 * length(p_type) > 18 AS skipped, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def skipped_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_type", jobs.skipped_for_read_length(5 * F.col("l_linenumber"), 10 * F.col("l_quantity"), "p_type", 18).alias("skipped")).agg(n_rows())


@query(f"""{WITH}, a AS (SELECT rk, locus_id, dir_code, called FROM calls WHERE motif_size > 1), b AS (SELECT rk, locus_id, dir_code, called + chrom % 2 AS called FROM calls), c AS (SELECT DISTINCT locus_id FROM calls WHERE chrom % 5 = 0),
  m AS (SELECT a.* FROM a ANTI JOIN c USING (locus_id) UNION ALL SELECT b.* FROM b SEMI JOIN c USING (locus_id)), j AS (SELECT a.called <> m.called AS x, a.dir_code <> m.dir_code AS y, a.locus_id <> m.locus_id AS z FROM a JOIN m USING (rk)),
  s AS (SELECT count(*) AS compared, count_if(x) AS x, count_if(y) AS y, count_if(z) AS z, count_if(x OR y OR z) AS anyone FROM j)
  SELECT field, compared, CASE field WHEN 'called' THEN x WHEN 'dir_code' THEN y WHEN 'locus_id' THEN z ELSE anyone END AS differing FROM s, (VALUES ('called'), ('dir_code'), ('locus_id'), ('any')) f(field)""")  # fmt: skip
def merge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumn("pos", F.xxhash64("rk"))
    current = df.filter("motif_size > 1").select("rk", "locus_id", "dir_code", "called", "pos")
    other = df.select("rk", "locus_id", "dir_code", (F.col("called") + F.col("chrom") % 2).alias("called"), "pos")
    return jobs.merged_source(current, other, df.filter("chrom % 5 = 0"), "locus_id", ["rk"])[1]


@query(f"""{WITH}, x AS (SELECT regime, CASE {" ".join(f"WHEN round_even(called - truth, 0) <= {e} THEN {k}" for k, e in enumerate(E.DIFFERENCE_EDGES))} ELSE {len(E.DIFFERENCE_EDGES)} END AS bin, unnest(['ok', 'too_long']) AS class, unnest([p_ok, p_too_long]) AS p FROM calls)
  SELECT regime, bin, class, count(*) AS n, round(avg(p), 6) AS mean, round(quantile_cont(p, 0.25), 6) AS low, round(quantile_cont(p, 0.5), 6) AS middle, round(quantile_cont(p, 0.75), 6) AS high FROM x GROUP BY ALL""")  # fmt: skip
def error_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.error_profile(calls(spark, sf_dir), ["regime"], "called", "truth", {"ok": "p_ok", "too_long": "p_too_long"}))


@query(f"""{WITH}, g AS (SELECT {_UNIT.format(x="motif_size")} AS category, person_id, avg(abs(truth - called)) AS prev, avg(abs(truth - fixed)) AS new FROM calls GROUP BY ALL)
  SELECT category, count(*) AS n_groups, round(avg(prev), 6) AS prev_mean, round(avg(new), 6) AS new_mean, round(avg(new - prev), 6) AS mean_delta FROM g GROUP BY ALL""")  # fmt: skip
def comparison_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumn("raw", F.abs(F.col("truth") - F.col("called")))
    prev, new = df.withColumn("new", F.col("raw")), df.withColumn("new", F.abs(F.col("truth") - F.col("fixed")))
    made = jobs.paired_by_category(prev, new, "person_id", F.col("raw"), F.col("new"), "motif_size", replicates=20)
    return rounded(made.select("category", "n_groups", "prev_mean", "new_mean", "mean_delta"))


@query(f"""{WITH}, s AS (SELECT regime, 'c' || chrom AS feature, round(avg(called), 6) AS score FROM calls WHERE regime <> 'R' OR chrom > 3 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY score DESC, feature) AS place FROM s)
  SELECT k.regime, k.feature, k.score, k.place, r.place AS reference_place FROM k LEFT JOIN k r ON r.regime = 'R' AND r.feature = k.feature WHERE k.place <= 10""")  # fmt: skip
def importance_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).filter("regime <> 'R' OR chrom > 3").groupBy("regime", F.concat(F.lit("c"), "chrom").alias("feature")).agg(r6(F.avg("called")).alias("score"))
    return jobs.importance_ranking(df, "regime", "feature", "score", "R", 10)


@query("""WITH a AS (SELECT p_brand AS name, count(*) AS k FROM part WHERE p_size < 30 AND p_brand <> 'Brand#11' GROUP BY ALL), b AS (SELECT p_brand AS name, count_if(p_size < 28) AS k FROM part WHERE p_brand <> 'Brand#22' GROUP BY ALL)
  SELECT name, 'added' AS change FROM b ANTI JOIN a USING (name) UNION ALL SELECT name, 'dropped' FROM a ANTI JOIN b USING (name) UNION ALL SELECT name, 'counted' FROM a JOIN b USING (name) WHERE a.k <> b.k""")  # fmt: skip
def ranking_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("name", F.col("p_brand"))
    ranking = part.filter("p_size < 30 AND name <> 'Brand#11'").groupBy("name").agg(F.count("*").alias("k"))
    contract = part.filter("name <> 'Brand#22'").groupBy("name").agg(F.count_if(F.col("p_size") < 28).alias("k"))
    return jobs.ranking_gap(ranking, contract, "name", ("k", "k"))


# Packed strings

_Q = "CAST(l_quantity AS INT)"


@query(f"""WITH g AS (SELECT l_linenumber AS line, {_Q} AS a, l_suppkey % 40 AS b, l_partkey % 11 = 0 AS bad FROM lineitem)
  SELECT line, count(*) AS n, count_if(bad) AS unreadable, CAST(sum(CASE WHEN NOT bad THEN a END) AS BIGINT) AS first, CAST(sum(CASE WHEN NOT bad AND line > 2 THEN b END) AS BIGINT) AS second FROM g GROUP BY ALL""")  # fmt: skip
def parsed_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("l_partkey") % 11 == 0, "x").when(F.col("l_linenumber") > 2, (F.col("l_suppkey") % 40).cast("string"))
    df = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), P.parse_genotype(F.concat_ws("/", F.col("l_quantity").cast("int"), second)).alias("g"))
    return df.groupBy("line").agg(n_rows(), F.count_if(F.col("g").isNull()).alias("unreadable"), _total(F.get("g", F.lit(0)), "first"), _total(F.get("g", F.lit(1)), "second"))


@query(f"""WITH g AS (SELECT {_Q} AS a, l_linenumber AS line, l_partkey % 7 = 0 AS bad FROM lineitem), e AS (SELECT unnest([0, 1, 2]) AS part, CASE WHEN line <= 5 THEN unnest([a, CASE WHEN NOT bad THEN line END, NULL]) END AS lo, CASE WHEN line <= 5 THEN unnest([a + line, CASE WHEN NOT bad THEN line + 9 END, NULL]) END AS hi FROM g)
  SELECT part, count(*) AS n, count(lo) AS known, CAST(sum(lo) AS BIGINT) AS low, CAST(sum(hi) AS BIGINT) AS high FROM e GROUP BY ALL""")  # fmt: skip
def parsed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, line = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    second = F.when(F.col("l_partkey") % 7 == 0, "9-").otherwise(F.concat_ws("-", line, line + 9))
    text = F.when(line <= 5, F.concat_ws("/", F.concat_ws("-", a, a + line), second))
    df = table(spark, sf_dir, "lineitem").select(F.posexplode(P.parse_intervals(text, F.lit(3))).alias("part", "x"))
    return df.groupBy("part").agg(n_rows(), F.count("x.lo").alias("known"), _total("x.lo", "low"), _total("x.hi", "high"))


@query("""WITH r AS (SELECT l_suppkey % 24 AS chrom, l_orderkey AS s, l_orderkey + l_linenumber AS e, l_linenumber = 4 AS bad FROM lineitem)
  SELECT CASE WHEN NOT bad THEN 'chr' || chrom END AS chrom, count(*) AS n, CAST(sum(CASE WHEN NOT bad THEN e - s END) AS BIGINT) AS width FROM r GROUP BY ALL""")  # fmt: skip
def parsed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("l_linenumber") == 4, "").otherwise((F.col("l_orderkey") + F.col("l_linenumber")).cast("string"))
    text = F.concat(F.lit("chr"), F.col("l_suppkey") % 24, F.lit(":"), "l_orderkey", F.lit("-"), end)
    df = table(spark, sf_dir, "lineitem").select(P.parse_region(text).alias("r"))
    return df.groupBy("r.chrom").agg(n_rows(), _total(F.col("r.end") - F.col("r.start"), "width"))


_VALUES = f"SELECT l_orderkey AS id, list({_Q} ORDER BY l_linenumber, {_Q}) AS v FROM lineitem GROUP BY ALL"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's quantities as one array, in order of their lines."""
    pairs = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"))))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(pairs, lambda x: x["q"]).alias("v"))


@query(f"WITH v AS ({_VALUES}), r AS (SELECT id, unnest(CASE WHEN len(v) = 3 THEN [0, 1] ELSE range(len(v)) END) AS rank FROM v) SELECT CAST(rank AS INT) AS rank, count(*) AS n FROM r GROUP BY ALL")
def call_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    called = F.when(F.size("v") != 3, F.col("v"))
    return _values(spark, sf_dir).select(F.explode(P.call_ranks(called)).alias("rank")).groupBy("rank").agg(n_rows())


@query(f"""WITH v AS ({_VALUES}), e AS (SELECT id, v, unnest(range(len(v))) AS i FROM v), o AS (SELECT e.id, e.i, e.v, o.i AS j, e.v[o.i + 1] AS x, row_number() OVER (PARTITION BY e.id, e.i ORDER BY abs(e.v[o.i + 1] - e.v[e.i + 1]), o.i) AS k FROM e JOIN e o ON o.id = e.id AND o.i <> e.i)
  SELECT e.id, CAST(e.i AS INT) AS rank, o.x AS sister FROM e LEFT JOIN o ON o.id = e.id AND o.i = e.i AND o.k = 1""")  # fmt: skip
def sister_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _values(spark, sf_dir).select("id", "v", F.explode(P.call_ranks(F.col("v"))).alias("rank"))
    return ranked.select("id", "rank", P.sister_value(F.col("v"), F.col("rank")).alias("sister"))


_COUNTS = f"SELECT l_orderkey AS id, {_Q} % 4 AS size, count(*) AS n FROM lineitem GROUP BY ALL"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), (F.col("l_quantity").cast("int") % 4).alias("size")).agg(F.count("*").cast("int").alias("n"))
    return each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("size", "n"))).alias("counts"))


@query(f"WITH c AS ({_COUNTS}), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n < 2, n DESC, size) AS k FROM c) SELECT id, size, CAST(n AS INT) AS n FROM k WHERE k = 1")
def counts_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("id", P.counts_mode(F.col("counts")).alias("m")).select("id", "m.size", "m.n")


@query(f"""WITH c AS ({_COUNTS}), t AS (SELECT id, sum(n) AS total, coalesce(sum(n) FILTER (size = 1), 0) AS one, coalesce(sum(n) FILTER (size > 1), 0) AS above FROM c GROUP BY ALL)
  SELECT id, round(one / total, 6) AS support, round(CASE WHEN above = 0 THEN 0 ELSE above / (above + one) END, 6) AS share FROM t""")  # fmt: skip
def support_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("counts")
    one, above = P.counts_at(c, F.lit(1)), P.counts_above(c, F.lit(1))
    return rounded(_counts(spark, sf_dir).select("id", P.support_fraction(one, P.counts_total(c)).alias("support"), P.flanking_share(above, one).alias("share")))


@query(f"""WITH v AS (SELECT l_orderkey AS id, l_linenumber AS number, {_Q} % 5 AS size FROM lineitem), w AS (SELECT id, number, min(size) AS size FROM v WHERE number <> 2 GROUP BY ALL), k AS (SELECT id, count(*) AS m FROM w GROUP BY ALL),
  a AS (SELECT o.o_orderkey AS id, r.range AS rank, CAST(o.o_custkey % 5 AS INT) AS value, coalesce(k.m, 0) AS m FROM orders o CROSS JOIN range(3) r LEFT JOIN k ON k.id = o.o_orderkey),
  b AS (SELECT a.*, n.size AS numbered, (SELECT min(number) FROM w WHERE w.id = a.id AND w.size = a.value) AS sized FROM a LEFT JOIN w n ON n.id = a.id AND n.number = a.rank + 1)
  SELECT rank::INT AS rank, count(*) AS n, count_if(numbered IS NOT NULL) AS own, CAST(sum(CASE WHEN numbered IS NULL THEN sized WHEN numbered <> value AND m > rank THEN coalesce(sized, rank + 1) ELSE rank + 1 END) AS BIGINT) AS number FROM b GROUP BY ALL""")  # fmt: skip
def metrics_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "lineitem").filter("l_linenumber <> 2").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("AlleleNumber")).agg(F.min(F.col("l_quantity").cast("int") % 5).alias("AlleleSize"))
    listed = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("AlleleNumber", "AlleleSize"))).alias("a"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).cast("int").alias("value"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("rank"))
    a = F.coalesce("a", F.array().cast("array<struct<AlleleNumber:int,AlleleSize:int>>"))
    df = asked.join(listed, "id", "left").withColumns({"entry": P.metrics_for(a, F.col("rank"), F.col("value")), "own": P.has_own_metrics(a, F.col("rank"))})
    return df.groupBy("rank").agg(n_rows(), F.count_if("own").alias("own"), _total("entry.AlleleNumber", "number"))


_UNITS = "SELECT p_partkey AS id, substr('ACGTGCA', CAST(p_partkey % 5 AS INT) + 1, CAST(p_size % 3 AS INT) + 1) AS u, CAST(p_size AS INT) AS s FROM part"
_SEQS = f"SELECT id, u, substr(repeat(u, 30), CAST(id % 4 AS INT) + 1, 12 + s % 9) || CASE WHEN id % 3 = 0 THEN 'N' WHEN id % 3 = 1 THEN u ELSE '' END AS seq FROM ({_UNITS})"


def _seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("p_partkey"), F.col("p_size").cast("int")
    u = table(spark, sf_dir, "part").select(i.alias("id"), F.substring(F.lit("ACGTGCA"), (i % 5).cast("int") + 1, s % 3 + 1).alias("u"), s.alias("s"))
    tail = F.when(F.col("id") % 3 == 0, "N").when(F.col("id") % 3 == 1, F.col("u")).otherwise("")
    return u.select("id", "u", F.concat(F.substring(F.repeat("u", F.lit(30)), (F.col("id") % 4).cast("int") + 1, 12 + F.col("s") % 9), tail).alias("seq"))


@query(f"""WITH q AS ({_SEQS}), r AS (SELECT id, seq, unnest(list_transform(range(len(u)), lambda i: substr(u, i + 1) || substr(u, 1, i))) AS r FROM q), t AS (SELECT id, seq, substr(repeat(r, 40), 1, len(seq)) AS t FROM r),
  m AS (SELECT id, seq, t = seq AS same, len(list_filter(range(1, len(seq) + 1), lambda i: seq[i] = t[i] AND seq[i] <> 'N')) AS k FROM t) SELECT id, bool_or(same) AS is_run, round(max(k) / any_value(len(seq)), 6) AS purity FROM m GROUP BY id""")  # fmt: skip
def tiling_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_seqs(spark, sf_dir).select("id", M.is_motif_run(F.col("seq"), F.col("u")).alias("is_run"), M.purity(F.col("seq"), F.col("u")).alias("purity")))


# Labels, samples, splits


@query("SELECT least(floor(l_quantity / 10), 3) * 10 AS bin, round(ceil(5 * l_discount / 0.1) * 0.1 / 5, 6) AS share, count(*) AS n FROM lineitem GROUP BY ALL")
def width_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(E.width_bin("l_quantity", 10, 3).cast("double").alias("bin"), r6(E.share_bin(F.col("l_discount"), F.lit(0.1))).alias("share")).agg(n_rows())


_BRANCHED = "SELECT *, CASE WHEN regime = 'N' THEN 'quick' ELSE 'full' END AS branch, CASE WHEN motif_size < 3 THEN NULL ELSE motif_size - 3 END AS spanning FROM calls"


@query(f"""{WITH}, b AS ({_BRANCHED}) SELECT CASE WHEN branch = 'quick' THEN 'quick' WHEN coalesce(spanning, 0) >= 1 THEN 'full_spanning' ELSE 'full_nonspanning' END AS route, CASE dir_code WHEN 0 THEN '{E.DIRECTIONS[0]}' WHEN 1 THEN '{E.DIRECTIONS[1]}' ELSE '{E.DIRECTIONS[2]}' END AS direction,
  count(*) AS n, round(sum(ln(called) - ln(truth)), 4) AS log_ratio, round(sum(motif_size * round_even(called, 0)), 6) AS size FROM b GROUP BY ALL""")  # fmt: skip
def all_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).select("called", "truth", "motif_size", F.when(F.col("regime") == "N", "quick").otherwise("full").alias("branch"), F.when(F.col("motif_size") >= 3, F.col("motif_size") - 3).alias("spanning"))
    made = E.with_labels(df, unit="motif_size").groupBy(F.col("regime").alias("route"), "direction").agg(n_rows(), F.round(F.sum("log_ratio"), 4).alias("log_ratio"), r6(F.sum("size")).alias("size"))
    return made


@query(f"{WITH} SELECT rk FROM calls WHERE coalesce(CASE WHEN chrom > 2 THEN p_ok > 0.3 END, true)")
def kept_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumn("usable", F.when(F.col("chrom") > 2, F.col("p_ok") > 0.3))
    return categories.keep_where(categories.keep_where(df, "usable"), "no such column").select("rk")


@query(f"""{WITH}, c AS (SELECT *, CAST(floor(called / 20) AS INT) AS cell FROM calls WHERE chrom % 2 = 0), cells AS (SELECT cell, count(*) AS n FROM c GROUP BY ALL), d AS (SELECT *, CAST(floor(called / 20) AS INT) AS cell FROM calls WHERE chrom % 2 = 1),
  dells AS (SELECT cell, count(*) AS n FROM d GROUP BY ALL), lc AS (SELECT max(l.range) AS level FROM range(1001) l WHERE (SELECT sum(least(n, l.range)) FROM cells) <= 1000), ld AS (SELECT max(l.range) AS level FROM range(501) l WHERE (SELECT sum(least(n, l.range)) FROM dells) <= 500)
  SELECT rk FROM (SELECT rk, row_number() OVER (PARTITION BY cell ORDER BY md5('0|' || rk)) AS k FROM c), lc WHERE k <= level UNION ALL SELECT rk FROM (SELECT rk, row_number() OVER (PARTITION BY cell ORDER BY md5('0|' || rk)) AS k FROM d), ld WHERE k <= level""")  # fmt: skip
def two_pool_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumn("cell", F.floor(F.col("called") / 20).cast("int"))
    return sampling.two_pool_sample(df, F.col("chrom") % 2 == 0, ["cell"], (1000, 500), ["rk"]).select("rk")


@query(f"""{WITH}, r AS (SELECT rk, regime, row_number() OVER (PARTITION BY regime ORDER BY md5('0|' || rk)) AS k FROM calls WHERE p_ok >= 0.2) SELECT rk FROM r WHERE k <= 400""")
def representative_of_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumns({"in_pool": F.col("p_ok") >= 0.2, "cell": F.floor(F.col("called") / 20)})
    return sampling.cap_per_class(df, 400, ["cell"], ["rk"], ["regime"], representative="in_pool").filter("representative").select("rk")


@query(f"{WITH} SELECT rk, role, round(least(1, 30 / called), 6) AS fraction FROM calls, (VALUES ('copy'), ('control')) r(role)")
def copies_and_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.copies_and_controls(calls(spark, sf_dir), 30, "called").select("rk", "role", "fraction"))


@query("SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment || '|' || c_nationkey ELSE c_mktsegment END AS fold_group, count(*) AS n FROM customer GROUP BY ALL")
def fold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(splits.fold_group("c_mktsegment", "c_nationkey", ["BUILDING", "MACHINERY"]).alias("fold_group")).agg(n_rows())


@query("SELECT c_custkey, c_acctbal > 0 AND c_nationkey % 4 <> 0 AND c_custkey % 3 <> 2 AND c_custkey % 3 = 0 AS equal_ok, c_acctbal > 0 AND c_nationkey % 4 <> 0 AND c_custkey % 3 <> 2 AND c_mktsegment = 'BUILDING' AND c_custkey % 3 + 5 < CASE WHEN c_nationkey > 9 THEN 'inf'::DOUBLE ELSE c_nationkey END AS heir_ok FROM customer")
def eligible_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    entities = c.select("c_custkey", (F.col("c_acctbal") > 0).alias("confident"), F.when(F.col("c_mktsegment") == "BUILDING", "AD").alias("inheritance"), F.when(nation <= 9, nation.cast("double")).alias("pathogenic_min"))
    truth = c.filter(key % 3 != 2).select("c_custkey", F.lit(5).alias("short"), (key % 3 + 5).alias("long"))
    return categories.eligible_entities(entities, truth, c.filter(nation % 4 == 0), "c_custkey").select("c_custkey", "equal_ok", "heir_ok")


# Joins and tables


@query("SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def unique_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = joins.first_per_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("c_custkey")), ["c_custkey"], "o_orderkey")
    return joins.unique_left_join(first, table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment"), ["c_custkey"]).select("o_orderkey", "o_totalprice", "c_mktsegment")


@query("SELECT s_suppkey, n_name, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def complete_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    own = joins.many_to_one_join(s, n.withColumnRenamed("n_nationkey", "s_nationkey"), ["s_nationkey"]).select("s_suppkey", "n_name", "n_regionkey")
    return joins.complete_left_join(s.select("s_suppkey"), own, ["s_suppkey"])


@query(f"{WITH} SELECT a.rk, a.called AS \"left\", b.fixed AS \"right\" FROM calls a JOIN calls b USING (rk) WHERE a.p_ok > 0.2 AND b.chrom > 4")
def paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir)
    a = df.select("rk", F.col("called").alias("v"), (F.col("p_ok") > 0.2).alias("ok"))
    return joins.paired_rows(a, df.select("rk", F.col("fixed").alias("v"), (F.col("chrom") > 4).alias("ok")), ["rk"], "v", "ok")


@query(f"""WITH s AS ({_SPANS}), w AS ({_WINDOWS}) SELECT chrom, count(*) AS n FROM w WHERE wid % 3 = 0 AND EXISTS (SELECT 1 FROM s WHERE s.chrom = w.chrom AND w."start" < s."end" AND s."start" < w."end") GROUP BY ALL""")
def overlapping_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark).filter("wid % 3 = 0").withColumn("key", F.col("chrom") * 10_000 + F.col("wid"))
    return intervals.count_overlaps(w, _spans(spark, sf_dir).select("chrom", "start", "end"), "key").filter("n_overlaps > 0").groupBy("chrom").agg(n_rows())


@query("SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS phone FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_phone FROM supplier".replace("s_phone", "CAST(s_nationkey AS VARCHAR)"))
def aligned_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return joins.aligned_union(c, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").cast("string").alias("phone"), F.col("s_acctbal").alias("balance")))


@query(f"{WITH} SELECT variant, regime, tol, count(*) AS n, round(avg(abs(truth - CASE variant WHEN 'raw' THEN called WHEN 'fixed' THEN fixed ELSE corrected END)), 6) AS mae FROM calls, (VALUES ('raw'), ('fixed'), ('corrected')) v(variant) GROUP BY ALL")
def errors_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.variant_rows(calls(spark, sf_dir), "x", {"raw": F.col("called"), "fixed": F.col("fixed"), "corrected": F.col("corrected")})
    return rounded(rows.groupBy(F.col("x")["variant"].alias("variant"), "regime", "tol").agg(n_rows(), F.avg(F.abs(F.col("truth") - F.col("x")["value"])).alias("mae")))


@query("SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderkey % 7 = 0 AND o_orderpriority < '3')")
def stale_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return io.stale_parts(o.select("o_orderpriority").distinct(), o.filter("o_orderkey % 7 = 0 AND o_orderpriority < '3'"), ["o_orderpriority"])


@query("SELECT name, change FROM (SELECT DISTINCT p_type AS name, 'added' AS change FROM part WHERE p_size > 25 AND p_type NOT IN (SELECT p_type FROM part WHERE p_size < 10) UNION ALL SELECT DISTINCT p_type, 'dropped' FROM part WHERE p_size < 10 AND p_type NOT IN (SELECT p_type FROM part WHERE p_size > 25))".replace("p_type", "(p_type || p_brand)"))
def feature_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("name", F.concat("p_type", "p_brand"))
    return compare.feature_changes(part.filter("p_size < 10"), part.filter("p_size > 25"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE md5(o_orderstatus) = md5('F')")
def results_of_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    o = table(spark, sf_dir, "orders").withColumn("model_fingerprint", F.md5("o_orderstatus"))
    return compare.results_of(o, hashlib.md5(b"F").hexdigest()).select("o_orderkey", "o_totalprice")


@query(f"{WITH} SELECT row_set, regime, count(*) AS n FROM calls, (VALUES ('all'), ('not contradicted')) s(row_set) WHERE row_set = 'all' OR NOT coalesce(CASE WHEN chrom <> 5 THEN p_ok < 0.2 END, false) GROUP BY ALL")
def row_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = compare.row_sets(calls(spark, sf_dir).withColumn("bad", F.when(F.col("chrom") != 5, F.col("p_ok") < 0.2)), "bad")
    return joins.aligned_union(*[df.select(F.lit(name).alias("row_set"), "regime") for name, df in sets.items()]).groupBy("row_set", "regime").agg(n_rows())


@query(f"{WITH} SELECT regime, count(*) AS n, round(avg(abs(truth - called)), 6) AS mae_raw FROM calls GROUP BY ALL")
def same_rows_of_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda df: df.groupBy("regime").agg(n_rows(), F.avg(F.abs(F.col("truth") - F.col("called"))).alias("mae_raw"))
    a, b = of(calls(spark, sf_dir)), of(calls(spark, sf_dir).withColumn("p_ok", 1 - F.col("p_ok")))
    compare.require_same_rows(a, b, ["regime"])
    return rounded(b)


# Order, regions, rates


@query(f"""WITH s AS ({_SPANS}), n AS (SELECT *, CASE WHEN "start" - lag("end") OVER (PARTITION BY chrom ORDER BY "start", "end", id) < 100 THEN 0 ELSE 1 END AS new FROM s)
  SELECT id, chrom FROM n WHERE new = 1""")  # fmt: skip
def firsts_of_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.first_of_island(_spans(spark, sf_dir), gap=100, key="id").select("id", "chrom")


@query(f"""WITH s AS ({_SPANS}), x AS (SELECT id AS a, lag(id) OVER w AS b, "start" - lag("end") OVER w AS d FROM s WINDOW w AS (PARTITION BY chrom ORDER BY "start", "end", id)) SELECT a, b FROM x WHERE b IS NOT NULL AND d < 100""")
def near_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.proximity_edges(_spans(spark, sf_dir), "id", gap=100)


@query("SELECT o_custkey, max_by(name, (dated, name)) AS latest FROM (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'model' || o_orderkey ELSE 'model-' || strftime(o_orderdate, '%Y-%m-%d') || '-' || o_orderkey END AS name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS dated FROM orders) GROUP BY ALL")
def latest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(key % 3 == 0, F.concat(F.lit("model"), key)).otherwise(F.concat_ws("-", F.lit("model"), day, key)).alias("name"))
    return o.groupBy("o_custkey").agg(joins.latest_by_name(o, "name").alias("latest"))


@query(f"""WITH s AS ({_SPANS}) SELECT id, greatest(0, "start" - 5000000) AS "start", "end" + 5000000 AS "end" FROM s""")
def padded_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.padded_regions(_spans(spark, sf_dir), 5_000_000).select("id", "start", "end")


_MATES = "SELECT l_orderkey AS name, l_orderkey % 7 AS chrom, (l_orderkey * 37) % 9000000 + 400 * l_linenumber AS \"start\" FROM lineitem WHERE l_linenumber <= 2"


@query(f"""WITH m AS ({_MATES}), w AS ({_WINDOWS}), i AS (SELECT w.chrom * 10000 + w.wid AS win, m.name, count(*) AS here FROM m JOIN w ON w.chrom = m.chrom AND w."start" <= m."start" AND m."start" < w."end" GROUP BY ALL),
  t AS (SELECT name, count(*) AS mates FROM m GROUP BY ALL) SELECT win, name FROM i JOIN t USING (name) WHERE here = 2 AND mates = 2""")  # fmt: skip
def pairs_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey")
    mates = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select(key.alias("name"), (key % 7).alias("chrom"), (key * 37 % 9_000_000 + 400 * F.col("l_linenumber")).alias("start"))
    windows = _windows(spark).withColumn("win", F.col("chrom") * 10_000 + F.col("wid"))
    return intervals.pairs_within(windows, mates, "win", "name")


@query("""WITH u AS (SELECT n_nationkey AS bin, 1 + n_nationkey / 10 AS rate FROM nation), r AS (SELECT c_nationkey AS bin, avg(c_acctbal) AS rate FROM customer WHERE c_nationkey < 20 GROUP BY ALL), s AS (SELECT s_nationkey AS bin, avg(s_acctbal) AS rate FROM supplier WHERE s_nationkey > 3 GROUP BY ALL)
  SELECT u.bin, round(CASE WHEN s.rate > 0 AND r.rate IS NOT NULL THEN u.rate * r.rate / s.rate ELSE u.rate END, 6) AS rate FROM u LEFT JOIN r USING (bin) LEFT JOIN s USING (bin)""")  # fmt: skip
def corrected_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("bin"), (1 + F.col("n_nationkey") / 10).alias("rate"))
    real = table(spark, sf_dir, "customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("bin")).agg(F.avg("c_acctbal").alias("rate"))
    made = table(spark, sf_dir, "supplier").filter("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("bin")).agg(F.avg("s_acctbal").alias("rate"))
    return rounded(metrics.corrected_rates(used, real, made, ["bin"]))


_FOLDED = f"{WITH}, e AS (SELECT locus_id, sample_id, round(avg(p_ok), 6) AS p_ok, max(abs(called - 25)) AS c, max(abs(truth - 25)) AS t FROM calls GROUP BY ALL)"


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumns({"c": F.abs(F.col("called") - 25), "t": F.abs(F.col("truth") - 25)})
    return metrics.entity_fold(df, ["locus_id", "sample_id"], "p_ok", "c", "t", F.col("motif_size") > 0).withColumn("p_ok", r6("p_ok"))


@query(f"{_FOLDED} SELECT sample_id, round(avg(CASE WHEN p_ok < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share_below_half FROM e GROUP BY ALL")
def early_warning_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.early_warning(_folded(spark, sf_dir), "sample_id", {"all": F.lit(True)})[0].select("sample_id", "share_below_half"))


# Mark run, read profile, metric sink, model documents

#: Every call gives four reads of its person at its entity, near the truth or, for a third of the people, far from it.
_MARKED = f"""{WITH}, rows AS (SELECT person_id, locus_id % 200 AS locus_id, rk, dir_code, CAST(20 AS DOUBLE) AS truth, 3 AS unit FROM calls),
  m AS (SELECT person_id, locus_id % 200 AS locus_id, CAST((20 + CASE WHEN person_id % 3 = 0 AND locus_id % 2 = 0 THEN 6 ELSE 0 END) * 3 + k AS BIGINT) AS length, 45 + motif_size AS mapq FROM calls, (SELECT CAST(range AS INT) AS k FROM range(4)) x),
  w AS (SELECT DISTINCT person_id, locus_id FROM rows WHERE dir_code <> 0), j AS (SELECT w.person_id, w.locus_id, floor(length / 3) AS v FROM w JOIN m USING (person_id, locus_id)),
  c AS (SELECT person_id, locus_id, max(n) AS cluster FROM (SELECT person_id, locus_id, v + d AS center, count(*) AS n FROM j, (VALUES (-1), (0), (1)) z(d) WHERE abs(v - 20) >= 2 GROUP BY ALL) GROUP BY ALL),
  a AS (SELECT w.*, count(v) AS n FROM w LEFT JOIN j USING (person_id, locus_id) GROUP BY ALL),
  judged AS (SELECT a.person_id, a.locus_id, CASE WHEN n < 10 THEN 'too_few_reads' WHEN coalesce(cluster, 0) >= 4 AND cluster >= 0.25 * n THEN 'contradicted_by_spanning' ELSE 'not_contradicted' END AS verdict FROM a LEFT JOIN c USING (person_id, locus_id))"""


def _marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = calls(spark, sf_dir).withColumn("locus_id", F.col("locus_id") % 200)
    rows = df.select("person_id", "locus_id", "rk", "dir_code", F.lit(20.0).alias("truth"), F.lit(3).alias("unit"))
    far = F.when((F.col("person_id") % 3 == 0) & (F.col("locus_id") % 2 == 0), 6).otherwise(0)
    made = df.select("person_id", "locus_id", F.lit("spanning").alias("kind"), ((20 + far) * 3).alias("at"), (45 + F.col("motif_size")).cast("int").alias("mapq"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    made = made.withColumns({"length": (F.col("at") + F.col("k")).cast("long"), "quality": F.lit(30), "strand": F.lit("+")}).drop("at", "k")
    return jobs.marked_by_reads(rows, made)


@query(f"{_MARKED} SELECT rk, coalesce(verdict = 'contradicted_by_spanning', false) AS truth_contradicted FROM rows LEFT JOIN judged USING (person_id, locus_id)")
def marked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir)[0].select("rk", "truth_contradicted")


@query(f"{_MARKED} SELECT person_id, verdict, count(*) AS n FROM judged GROUP BY ALL")
def mark_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir)[2]


_MATED = "SELECT l_orderkey AS name, CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + 1 + CASE WHEN l_partkey % 5 > 0 THEN 2 ELSE 0 END + CASE WHEN l_suppkey % 2 = 0 THEN 16 ELSE 0 END + CASE WHEN l_partkey % 11 = 0 THEN 1024 ELSE 0 END AS flag, CASE WHEN l_suppkey % 3 = 0 THEN 'ACGTACGT' ELSE repeat('ACGTG', 12) END AS seq, CAST((l_partkey * 7) % 2000 AS BIGINT) - 250 AS tlen, CASE WHEN l_suppkey % 3 = 0 THEN 'FFFF####' ELSE repeat(CASE WHEN l_partkey % 4 = 0 THEN '+' ELSE '5' END, 25) || repeat('F', 35) END AS qual FROM lineitem"
_PROFILED = f"WITH r AS ({_MATED}), k AS (SELECT *, length(seq) AS len FROM r WHERE flag & 3844 = 0 AND flag & 1 <> 0), m AS (SELECT len AS mode FROM k GROUP BY len ORDER BY count(*) DESC, len LIMIT 1)"


def _mated(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    flag = F.when(line % 2 == 1, 64).otherwise(128) + 1 + F.when(part % 5 > 0, 2).otherwise(0) + F.when(supp % 2 == 0, 16).otherwise(0) + F.when(part % 11 == 0, 1024).otherwise(0)
    short = supp % 3 == 0
    qual = F.when(short, "FFFF####").otherwise(F.concat(F.when(part % 4 == 0, "+" * 25).otherwise("5" * 25), F.lit("F" * 35)))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), flag.alias("flag"), F.when(short, "ACGTACGT").otherwise("ACGTG" * 12).alias("seq"), (part * 7 % 2000 - 250).cast("long").alias("tlen"), qual.alias("qual"))


@query(f"{_PROFILED} SELECT abs(tlen) AS fragment, count(*) AS n FROM k, m WHERE flag & 66 = 66 AND abs(tlen) BETWEEN greatest(mode, 1) AND 1500 GROUP BY ALL")
def fragment_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.fragment_lengths(_mated(spark, sf_dir))


@query(f"""{_PROFILED}, s AS (SELECT flag & 64 <> 0 AS first_mate, CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS q, len FROM k, m WHERE len = mode),
  c AS (SELECT first_mate, least(i // 30, 4) AS cycle_bin, ascii(q[i + 1]) - 33 AS v FROM s, (SELECT CAST(range AS INT) AS i FROM range(60)) x WHERE i < len)
  SELECT first_mate, cycle_bin, count(*) AS n, round(avg(CASE WHEN v < 20 THEN 1.0 ELSE 0.0 END), 6) AS low_share, round(avg(v), 6) AS mean_quality FROM c GROUP BY ALL""")  # fmt: skip
def cycle_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reads.cycle_qualities(_mated(spark, sf_dir)))


@query(f"""{WITH}, g AS (SELECT regime, count(*) AS n, avg(abs(truth - called)) AS mae_raw, count_if(dir_code = 0) AS fine FROM calls GROUP BY regime)
  SELECT 'errors' AS part, regime AS item, metric, round(value, 6) AS value FROM (SELECT regime, unnest(['n', 'mae_raw', 'fine']) AS metric, unnest([CAST(n AS DOUBLE), mae_raw, CAST(fine AS DOUBLE)]) AS value FROM g)""")  # fmt: skip
def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calls(spark, sf_dir).groupBy("regime").agg(n_rows(), F.avg(F.abs(F.col("truth") - F.col("called"))).alias("mae_raw"), F.count_if(F.col("dir_code") == 0).alias("fine"))
    return rounded(evaluation.long_metrics(found, "errors", ["regime"]))


_STUMPS = """WITH s AS (SELECT l_returnflag AS regime, CASE WHEN l_suppkey % 4 = 0 THEN 'size' ELSE 'direction' END AS head, l_linenumber - 1 AS iter, CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE l_suppkey % 4 - 1 END AS class, max(l_quantity) AS cut, min(l_discount) AS low, max(l_tax) AS high FROM lineitem GROUP BY ALL),
  b AS (SELECT DISTINCT regime, head, class FROM s)"""


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stump a (regime, head, line, class), with thresholds and leaves from the lines."""
    of = F.col("l_suppkey") % 4
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("regime"), F.when(of == 0, "size").otherwise("direction").alias("head"), (F.col("l_linenumber") - 1).cast("int").alias("iter"), F.when(of == 0, 0).otherwise(of - 1).cast("int").alias("class"))
    s = s.agg(F.max("l_quantity").cast("double").alias("cut"), F.min("l_discount").cast("double").alias("low"), F.max("l_tax").cast("double").alias("high"))
    none = lambda kind: F.lit(None).cast(kind)
    split = F.struct(F.lit(0).alias("node_id"), F.lit(False).alias("is_leaf"), none("double").alias("value"), F.lit(1).alias("feature"), F.col("cut").alias("threshold"), F.lit(True).alias("missing_left"), F.lit(1).alias("left"), F.lit(2).alias("right"))
    leaf = lambda k, v: F.struct(F.lit(k).alias("node_id"), F.lit(True).alias("is_leaf"), F.col(v).alias("value"), none("int").alias("feature"), none("double").alias("threshold"), none("boolean").alias("missing_left"), none("int").alias("left"), none("int").alias("right"))
    grown = s.select("regime", "head", "iter", "class", F.explode(F.array(split, leaf(1, "low"), leaf(2, "high"))).alias("_n")).select("regime", "head", "iter", "class", "_n.*")
    base = s.select("regime", "head", F.lit(-1).alias("iter"), "class", F.lit(0).alias("node_id"), F.lit(True).alias("is_leaf"), (F.col("class") + 0.5).cast("double").alias("value")).distinct()
    knots = s.filter("head = 'direction' AND class < 2").select("regime", "class", F.col("iter").alias("i"), (F.col("iter") / 10).alias("x"), F.col("high").alias("y"))
    return grown.unionByName(base, allowMissingColumns=True), knots


@query(f"""{_STUMPS} SELECT regime, head, iter, class, n.k AS node_id, n.k > 0 AS is_leaf, CASE n.k WHEN 1 THEN low WHEN 2 THEN high END AS value, CASE WHEN n.k = 0 THEN 1 END AS feature, CASE WHEN n.k = 0 THEN cut END AS threshold, CASE WHEN n.k = 0 THEN 1 END AS missing_left,
    CASE WHEN n.k = 0 THEN 1 END AS "left", CASE WHEN n.k = 0 THEN 2 END AS "right" FROM s, (VALUES (0), (1), (2)) n(k) UNION ALL SELECT regime, head, -1, class, 0, true, class + 0.5, NULL, NULL, NULL, NULL, NULL FROM b""")  # fmt: skip
def model_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a model after its documents were written and read."""
    return models.model_tables(models.model_documents(*_model(spark, sf_dir)))[0].withColumn("missing_left", F.col("missing_left").cast("int"))


@query(f"{_STUMPS} SELECT regime, class, iter AS i, iter / 10 AS x, high AS y FROM s WHERE head = 'direction' AND class < 2")
def model_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.model_tables(models.model_documents(*_model(spark, sf_dir)))[1]
