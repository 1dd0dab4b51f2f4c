"""More queries over the driver's tables: keys, names, units, weights, populations, merges, rates, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callquality.functions import exprs as E
from callquality.functions import motifs as M
from callquality.functions import parse as P
from callquality.operators import categories, compare, intervals, joins, metrics, sampling, splits
from callquality.plans.driver_queries import WITH, _spans, _windows, _SPANS, _WINDOWS, calls, query, r6, rounded, table
from callquality.sources import io


@query("SELECT o_custkey, count(*) AS n FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey GROUP BY ALL")
def semi_filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.only_keys_of(table(spark, sf_dir, "orders"), keys, ["o_custkey"]).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_nationkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) o ON o_custkey = c_custkey")
def entities_without_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.without_keys_of(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), found, ["c_custkey"])


@query("SELECT o_orderkey, any_value(o_custkey) AS o_custkey, any_value(o_totalprice) AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderstatus = 'F' GROUP BY ALL")
def consistent_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    fields = ("o_orderkey", "o_custkey", "o_totalprice")
    return joins.consistent_union([o.filter("o_orderkey % 3 <> 0").select(*fields), o.filter("o_orderstatus = 'F'").select(*fields)], ["o_orderkey"])


@query(f"""{WITH}, v AS (SELECT *, CASE WHEN dir_code <> 0 THEN p_ok END AS a, called - tol AS lo, called + motif_size AS hi, CASE WHEN motif_size < 7 THEN tol + motif_size END AS w FROM calls)
  SELECT motif_size, count(*) AS n, round(sum(CASE WHEN w IS NULL THEN 0 ELSE (hi - called - (called - lo)) / (w + 1) END), 6) AS asymmetry, round(sum(CASE WHEN w IS NULL THEN 0 ELSE w / (called + 1) END), 6) AS over_value FROM v GROUP BY ALL""")  # fmt: skip
def interval_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumns({"ci_start": (F.col("called") - F.col("tol")).cast("string"), "ci_end": F.col("called") + F.col("motif_size"), "ci_width": F.when(F.col("motif_size") < 7, F.col("tol") + F.col("motif_size"))})
    made = df.withColumns(E.interval_features())
    return rounded(made.groupBy("motif_size").agg(F.count("*").alias("n"), F.sum("ci_asymmetry").alias("asymmetry"), F.sum("ci_over_value").alias("over_value")))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'chrM' ELSE 'chr' || (l_suppkey % 25) END || '-' || l_orderkey || '-' || (l_orderkey + 5) || '-CAG' AS key FROM lineitem)
  SELECT CASE WHEN t IN ('1','2','3','4','5','6','7','8','9','10','11','12','13','14','15','16','17','18','19','20','21','22','X','Y') THEN t END AS chrom, count(*) AS n, CAST(sum(CAST(split_part(key, '-', 3) AS BIGINT)) AS BIGINT) AS ends
  FROM (SELECT *, regexp_replace(split_part(key, '-', 1), '^chr', '') AS t FROM k) GROUP BY ALL""")  # fmt: skip
def key_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    chrom = F.when(F.col("l_linenumber") == 7, "chrM").otherwise(F.concat(F.lit("chr"), F.col("l_suppkey") % 25))
    keys = l.select(F.concat_ws("-", chrom, "l_orderkey", F.col("l_orderkey") + 5, F.lit("CAG")).alias("key"))
    return keys.groupBy(E.valid_partition("key").alias("chrom")).agg(F.count("*").alias("n"), F.sum(E.key_parts("key")["end"]).alias("ends"))


@query("""WITH n AS (SELECT 's' || (c_custkey % 40) || CASE c_custkey % 3 WHEN 0 THEN '_20x' WHEN 1 THEN '_spiked_' || (c_custkey % 7) ELSE '' END AS name FROM customer)
  SELECT regexp_replace(regexp_replace(name, '_spiked_[0-9]+$', ''), '_[0-9]+x$', '') AS family, regexp_matches(name, '_spiked_[0-9]+$') AS derived, count(*) AS n FROM n GROUP BY ALL""")  # fmt: skip
def name_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    suffix = F.when(k % 3 == 0, "_20x").when(k % 3 == 1, F.concat(F.lit("_spiked_"), k % 7)).otherwise("")
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), k % 40, suffix).alias("name"))
    return names.groupBy(E.family_of("name").alias("family"), E.is_derived("name").alias("derived")).agg(F.count("*").alias("n"))


_MOTIFS = "SELECT p_partkey, translate(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 3), '0123456789abcdef', 'ACGTACGTACGTACGN') AS m, translate(substr(md5(CAST(p_partkey + 1 AS VARCHAR)), 1, 3), '0123456789abcdef', 'ACGTACGTACGTACGT') AS r FROM part"


def _motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    letters = lambda x, to: F.translate(F.substring(F.md5(x.cast("string")), 1, 3), "0123456789abcdef", to)
    return table(spark, sf_dir, "part").select("p_partkey", letters(k, "ACGTACGTACGTACGN").alias("m"), letters(k + 1, "ACGTACGTACGTACGT").alias("r"))


@query(f"""WITH m AS ({_MOTIFS}), c AS (SELECT p_partkey, m, r, unnest([m, reverse(translate(m, 'ACGTN', 'TGCAN'))]) AS s, unnest([0, 1]) AS turned FROM m),
  t AS (SELECT *, substr(r, i::INT) || substr(r, 1, i::INT - 1) AS x FROM c, range(1, 4) g(i)), d AS (SELECT p_partkey, turned, (SELECT count(*) FROM range(1, 4) h(j) WHERE substr(s, j::INT, 1) <> substr(x, j::INT, 1) AND substr(s, j::INT, 1) <> 'N' AND substr(x, j::INT, 1) <> 'N') AS d FROM t),
  b AS (SELECT p_partkey, min(d) FILTER (turned = 0) AS there, min(d) FILTER (turned = 1) AS back FROM d GROUP BY ALL)
  SELECT p_partkey, CAST(there AS INT) AS distance, there = 0 OR back = 0 AS matches, back < there AS turned FROM b""")  # fmt: skip
def motif_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, r = F.col("m"), F.col("r")
    return _motifs(spark, sf_dir).select("p_partkey", M.motif_distance(m, r).alias("distance"), M.motifs_match(m, r).alias("matches"), (M.motif_distance(M.reverse_complement(m), r) < M.motif_distance(m, r)).alias("turned"))


@query(f"""WITH m AS ({_MOTIFS}), g AS (SELECT p_partkey, m, (length(m) - length(replace(replace(m, 'G', ''), 'C', '')) + (length(m) - length(replace(m, 'N', ''))) / 2) / length(m) AS share FROM m)
  SELECT CASE WHEN share = 0 THEN '0' WHEN share <= 0.34 THEN '<=1/3' WHEN share <= 0.67 THEN '<=2/3' ELSE '>2/3' END AS gc, count(*) AS n FROM g GROUP BY ALL""")  # fmt: skip
def gc_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _motifs(spark, sf_dir).groupBy(M.gc_bin(F.col("m")).alias("gc")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderkey, (o_orderkey % 40 + 1) AS m, (o_custkey % 7) AS i, (o_orderkey % 5) AS d FROM orders) SELECT o_orderkey, CAST(m + d + 3 AS INT) AS span FROM c""")
def reference_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cigar = F.concat(F.lit("5S"), k % 40 + 1, F.lit("M"), F.col("o_custkey") % 7, F.lit("I"), k % 5, F.lit("D3=2H"))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.reference_span(cigar).alias("span"))


@query(f"""{WITH}, c AS (SELECT *, CAST(floor(called / 20) AS BIGINT) AS cell FROM calls), s AS (SELECT * FROM c WHERE p_ok < 0.3), r AS (SELECT p.cell, p.n / s.n AS w FROM (SELECT cell, count(*) AS n FROM c GROUP BY ALL) p JOIN (SELECT cell, count(*) AS n FROM s GROUP BY ALL) s USING (cell))
  SELECT cell, count(*) AS n, round(sum(w), 6) AS weight FROM s JOIN r USING (cell) GROUP BY ALL""")  # fmt: skip
def inverse_rate_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumn("cell", F.floor(F.col("called") / 20))
    made = sampling.inverse_rate_weights(df.filter("p_ok < 0.3"), df, ["cell"])
    return rounded(made.groupBy("cell").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")))


@query(f"""{WITH}, r AS (SELECT rk, regime, row_number() OVER (PARTITION BY regime ORDER BY md5(concat_ws('|', '0', rk))) AS k FROM calls) SELECT regime, k <= 3000 AS representative, count(*) AS n FROM r WHERE k <= 3000 GROUP BY ALL""")
def representative_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumn("cell", F.floor(F.col("called") / 20))
    made = sampling.cap_per_class(df, 3000, ["cell"], ["rk"], ["regime"])
    return made.filter("representative").groupBy("regime", "representative").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT CASE WHEN person_id < 5 AND chrom >= 20 THEN 'both_new' WHEN person_id < 5 THEN 'new_groups' WHEN chrom >= 20 THEN 'new_entities' ELSE 'train' END AS cell, count(*) AS n, round(avg(abs(truth - fixed)), 6) AS mae FROM calls GROUP BY ALL")
def evaluation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = splits.evaluation_cells(calls(spark, sf_dir), F.col("person_id") < 5, F.col("chrom") >= 20)
    return rounded(df.groupBy("cell").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("truth") - F.col("fixed"))).alias("mae")))


@query("""WITH e AS (SELECT o_custkey AS g, o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT o_custkey AS g, o_orderkey AS id, -o_totalprice AS v FROM orders WHERE o_orderstatus = 'P')
  SELECT g, id, v FROM e ANTI JOIN (SELECT DISTINCT g FROM n) k USING (g) UNION ALL SELECT g, id, v FROM n""")  # fmt: skip
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    new = o.filter("o_orderstatus = 'P'").withColumn("v", -F.col("v")).drop("o_orderstatus")
    return joins.upsert_groups(o.filter("o_orderstatus <> 'P'").drop("o_orderstatus"), new, ["g"])


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS flagged FROM customer")
def replaced_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return io.marked(table(spark, sf_dir, "customer").select("c_custkey", F.lit(None).cast("boolean").alias("flagged")), ids, "c_custkey", "flagged")


@query("SELECT '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS entry FROM nation")
def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return n.select(io.catalog_json(n, "key", "name").alias("entry"))


@query("SELECT o_custkey, string_agg(o_orderkey || '=' || CAST(o_totalprice AS BIGINT), ',' ORDER BY o_orderkey) AS packed FROM orders GROUP BY ALL".replace("CAST(o_totalprice AS BIGINT)", "CAST(floor(o_totalprice) AS BIGINT)"))
def keyed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("whole", F.floor("o_totalprice"))
    packed = io.keyed_values(o, "o_custkey", "o_orderkey", "whole")
    entries = F.transform(F.map_entries("values"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return packed.select("o_custkey", F.array_join(entries, ",").alias("packed"))


@query("""SELECT s_nationkey AS person, array_to_string(list_sort(list('s' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0'))), ',') AS sources FROM supplier GROUP BY ALL""")
def sources_by_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("source"), "s_nationkey")
    return io.sources_by_person(s, F.col("s_nationkey")).select("person", F.array_join("sources", ",").alias("sources"))


@query("SELECT event_type, hour(ts) AS h, CAST(count(*) AS BIGINT) AS events, round(sum(abs(value)), 4) AS exposure, round(count(*) / nullif(sum(abs(value)), 0), 6) AS rate FROM events GROUP BY ALL")
def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.hour("ts").alias("h"), F.lit(1).alias("one"), F.abs("value").alias("size"))
    made = metrics.rate_table(e, ["event_type", "h"], "one", "size")
    return made.select("event_type", F.col("h").cast("long").alias("h"), "events", F.round("exposure", 4).alias("exposure"), r6("rate").alias("rate"))


@query(f"""{WITH}, b AS (SELECT floor(called / 5) AS x, count_if(dir_code <> 0) / count(*) AS rate, count(*)::DOUBLE AS w FROM calls GROUP BY ALL) SELECT round(coalesce(exp(sum(w * x * ln(rate)) / sum(w * x * x)), 1), 6) AS base FROM b WHERE rate > 0""")
def origin_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = calls(spark, sf_dir).groupBy(F.floor(F.col("called") / 5).cast("double").alias("x")).agg((F.count_if(F.col("dir_code") != 0) / F.count("*")).alias("rate"), F.count("*").cast("double").alias("w"))
    return rounded(metrics.origin_log_slope(b, "x", "rate", "w"))


@query(f"""{WITH}, v AS (SELECT unnest([p_ok, p_too_long, p_too_short, lcf]) AS v, unnest([0, 1, 2, 3]) AS pl FROM calls) SELECT CAST(least(CAST(floor(pl / 2) AS INT), 1) * 2 AS INT) AS place, count(*) AS n, round(avg((v < 0.2)::INT), 6) AS share FROM v GROUP BY ALL""")
def low_values_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumn("values", F.array("p_ok", "p_too_long", "p_too_short", "lcf"))
    made = metrics.low_share_by_place(df, "values", 0.2, 2, 1)
    return rounded(made.withColumn("place", F.col("place").cast("int")))


@query(f"""{WITH}, t AS (SELECT regime, unnest([0.1, 0.5, 0.9])::DOUBLE AS below, p_ok, abs(truth - fixed) AS e FROM calls) SELECT regime, below, count(*) AS n, round(avg(e), 6) AS mae FROM t WHERE p_ok < below GROUP BY ALL""")
def nested_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = metrics.nested_thresholds(calls(spark, sf_dir), "p_ok", [0.1, 0.5, 0.9])
    return rounded(df.groupBy("regime", "below").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("truth") - F.col("fixed"))).alias("mae")))


@query(f"{WITH} SELECT sample_id, max_by(rk, (price, rk)) AS largest, min_by(rk, (price, rk)) AS smallest FROM calls GROUP BY ALL")
def extreme_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir)
    first = joins.first_per_key(df, ["sample_id"], F.col("price").desc(), F.col("rk").desc()).select("sample_id", F.col("rk").alias("largest"))
    return first.join(df.groupBy("sample_id").agg(F.min_by("rk", F.struct("price", "rk")).alias("smallest")), "sample_id")


@query(f"""{WITH}, k AS (SELECT DISTINCT CASE WHEN chrom = 22 THEN 'X' WHEN chrom = 23 THEN 'Y' WHEN chrom = 0 THEN 'M' ELSE CAST(chrom AS VARCHAR) END AS c FROM calls)
  SELECT c, row_number() OVER (ORDER BY CASE c WHEN 'X' THEN 23 WHEN 'Y' THEN 24 WHEN 'M' THEN 25 ELSE TRY_CAST(c AS INT) END) AS place FROM k""")  # fmt: skip
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    c = F.col("chrom")
    keys = calls(spark, sf_dir).select(F.when(c == 22, "X").when(c == 23, "Y").when(c == 0, "M").otherwise(c.cast("string")).alias("c")).distinct()
    return keys.withColumn("place", F.row_number().over(W.orderBy(joins.natural_order(F.col("c")))))


@query(f"""{WITH}, s AS (SELECT regime, sample_id, sum(abs(truth - fixed)) / count(*) AS a, sum(abs(truth - corrected)) / count(*) AS b FROM calls GROUP BY ALL), w AS (SELECT regime, CASE WHEN count(*) < 10 THEN 'few' WHEN avg(b - a) < 0 THEN 'new' ELSE 'prev' END AS w FROM s GROUP BY ALL)
  SELECT count_if(w = 'new') AS new, count_if(w = 'prev') AS prev FROM w""")  # fmt: skip
def run_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, off = calls(spark, sf_dir), lambda c: F.abs(F.col("truth") - F.col(c))
    prev, new = (compare.group_sums(df, ["regime"], "sample_id", off("called"), off(c)) for c in ("fixed", "corrected"))
    return compare.verdict(compare.paired_comparison(prev, new, ["regime"], "sample_id", replicates=200)).select("new", "prev")


@query(f"""{WITH} SELECT locus_id, min(dir_code) AS low, max(dir_code) AS high FROM calls GROUP BY ALL HAVING min(dir_code) <> max(dir_code) ORDER BY locus_id LIMIT 5""")
def mixed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.mixed_groups(calls(spark, sf_dir), "locus_id", "dir_code").select("locus_id", "low", "high")


@query(f"""WITH s AS ({_SPANS}), w AS ({_WINDOWS}), o AS (SELECT s.id, w.wid FROM s JOIN w ON w.chrom = s.chrom AND w."start" < s."end" AND s."start" < w."end")
  SELECT s.id, array_to_string(list_sort(list(CAST(o.wid AS VARCHAR)) FILTER (o.wid IS NOT NULL)), ',') AS names, min(o.wid) AS lowest, max(o.wid) AS highest FROM s LEFT JOIN o USING (id) GROUP BY ALL""")  # fmt: skip
def overlap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark).withColumn("name", F.col("wid").cast("string"))
    return intervals.overlap_summary(_spans(spark, sf_dir), w, "id", "name", "wid", "wid").select("id", "names", "lowest", "highest")


@query(f"{WITH} SELECT dir_code <> 0 AS off, count(DISTINCT locus_id) AS entities FROM calls WHERE dir_code <> 0 GROUP BY ALL")
def entities_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = categories.entities_off(calls(spark, sf_dir), ["locus_id"])
    return found.agg(F.lit(True).alias("off"), F.count("*").alias("entities"))
