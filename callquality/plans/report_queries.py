"""Queries of whole reports: early warning with sexes and subsets, parity of two extractions, summaries kept over batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callquality.operators import joins, metrics, recipes, summaries
from callquality.operators.shared import shared_folder
from callquality.plans.driver_queries import WITH, calls, query, r6, rounded, table
from callquality.streaming import streams

_ENTITIES = f"""{WITH}, e AS (SELECT locus_id, sample_id, round(avg(p_ok), 6) AS p_ok, max(abs(called - 25)) <= 1 AS reference_call, max(abs(called - 25)) <= 1 AND max(abs(truth - 25)) > 2 AS miss, bool_and(motif_size > 1 AND sample_id % 3 = 0) AS single, locus_id % 12 = 0 AS on_sex FROM calls GROUP BY ALL),
  x AS (SELECT sample_id, CASE WHEN avg(CASE WHEN on_sex THEN single::INT END) > 0.5 THEN 'male' ELSE 'female' END AS sex FROM e GROUP BY ALL), r AS (SELECT e.*, sex FROM e JOIN x USING (sample_id) WHERE reference_call),
  u AS (SELECT sample_id, count(*) FILTER (a.miss) AS pos, count(*) FILTER (NOT a.miss) AS neg FROM r a GROUP BY ALL),
  w AS (SELECT a.sample_id, sum(CASE WHEN a.p_ok < b.p_ok THEN 1.0 WHEN a.p_ok = b.p_ok THEN 0.5 ELSE 0 END) AS wins FROM r a JOIN r b ON a.sample_id = b.sample_id AND a.miss AND NOT b.miss GROUP BY ALL),
  g AS (SELECT e.sample_id, any_value(sex) AS sex, count(*) FILTER (reference_call) AS n_reference_calls, count(*) FILTER (miss) AS n_misses, avg((p_ok < 0.5)::INT) AS share_below_half FROM e JOIN x USING (sample_id) GROUP BY ALL),
  report AS (SELECT g.*, wins / (pos * neg) AS auc FROM g LEFT JOIN u USING (sample_id) LEFT JOIN w USING (sample_id))"""  # fmt: skip


def _report(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = calls(spark, sf_dir).withColumns({"c": F.abs(F.col("called") - 25), "t": F.abs(F.col("truth") - 25)})
    told = metrics.entity_fold(df, ["locus_id", "sample_id"], "p_ok", "c", "t", (F.col("motif_size") > 1) & (F.col("sample_id") % 3 == 0)).withColumn("p_ok", r6("p_ok"))
    return metrics.early_warning_report(told, "sample_id", F.col("locus_id") % 12 == 0, (0.05, 0.1, 0.5))


@query(f"{_ENTITIES} SELECT sample_id, sex, n_reference_calls, n_misses, round(auc, 6) AS auc, round(share_below_half, 6) AS share_below_half FROM report")
def early_warning_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_report(spark, sf_dir)[0])


@query(f"""{_ENTITIES}, s AS (SELECT 'all' AS subset, * FROM r UNION ALL SELECT 'off_sex_chromosomes', * FROM r WHERE NOT on_sex UNION ALL SELECT sex, * FROM r),
  t AS (SELECT subset, p_ok, count(*) AS n, count(*) FILTER (miss) AS pos FROM s GROUP BY ALL),
  k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY subset ORDER BY p_ok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(n) OVER (PARTITION BY subset) AS n_all, sum(pos) OVER (PARTITION BY subset) AS n_pos FROM t),
  v AS (SELECT k.*, rate, floor(rate * n_all) AS places FROM k, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.5::DOUBLE)) z(rate))
  SELECT subset, rate, round(CASE WHEN max(places) > 0 AND max(n_pos) > 0 THEN sum(greatest(0, least(1, (places - above) / n)) * pos) / max(n_pos) END, 6) AS recall FROM v GROUP BY ALL""")  # fmt: skip
def early_warning_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_report(spark, sf_dir)[1])


@query(f"{_ENTITIES} SELECT count(*) AS n_groups, count(auc) AS n_with_auc, round(avg(auc), 6) AS auc, round(avg(share_below_half), 6) AS share_below_half FROM report")
def early_warning_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_report(spark, sf_dir)[2])


_PARITY = """WITH o AS (SELECT o_custkey % 40 AS person, o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS price, CASE WHEN o_custkey % 40 = 39 THEN 'x' END AS extra FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)),
  n AS (SELECT person, id, CASE WHEN person % 3 = 0 AND id % 50 = 0 THEN 'Z' ELSE status END AS status, CASE WHEN person % 4 = 1 AND id % 60 = 1 THEN 0 ELSE price END AS price FROM o WHERE person % 5 <> 2 OR id % 100 <> 7),
  d AS (SELECT o.person, o.id, 'row' AS field, 'present' AS "left", NULL AS "right" FROM o ANTI JOIN n USING (id) UNION ALL SELECT o.person, o.id, 'extra', 'x', NULL FROM o JOIN n USING (id) WHERE o.person = 39
    UNION ALL SELECT o.person, o.id, 'status', o.status, n.status FROM o JOIN n USING (id) WHERE o.status <> n.status UNION ALL SELECT o.person, o.id, 'price', 'a', 'b' FROM o JOIN n USING (id) WHERE o.price IS DISTINCT FROM n.price)"""  # fmt: skip


def _parity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key, person = F.col("o_orderkey"), F.col("o_custkey") % 40
    price = F.when(key % 9 != 0, F.col("o_totalprice").cast("double"))
    o = table(spark, sf_dir, "orders").select(person.alias("person"), key.alias("id"), F.col("o_orderstatus").alias("status"), price.alias("price"), F.when(person == 39, "x").alias("extra"))
    n = o.filter("person % 5 <> 2 OR id % 100 <> 7").withColumn("status", F.when((F.col("person") % 3 == 0) & (F.col("id") % 50 == 0), "Z").otherwise(F.col("status"))).drop("extra")
    n = n.withColumn("price", F.when((F.col("person") % 4 == 1) & (F.col("id") % 60 == 1), 0.0).otherwise(F.coalesce("price", F.lit(float("nan")))))
    return joins.parity(o, n, ["id"], "person", "id", table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("id")))


@query(f"""{_PARITY} SELECT person, id, field, CASE WHEN field <> 'price' THEN "left" END AS "left", CASE WHEN field <> 'price' THEN "right" END AS "right" FROM d""")
def parity_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices are texts of doubles, which engines write differently: only that they differ is compared."""
    said = F.col("field") != "price"
    return _parity(spark, sf_dir)[0].withColumns({"left": F.when(said, F.col("left")), "right": F.when(said, F.col("right"))})


@query(f"""{_PARITY}, f AS (SELECT person, count(DISTINCT id) AS n_differing FROM d GROUP BY ALL), a AS (SELECT person, count(*) AS n_left FROM o GROUP BY ALL), b AS (SELECT person, count(*) AS n_right FROM n GROUP BY ALL)
  SELECT person, n_left, coalesce(n_right, 0) AS n_right, coalesce(n_differing, 0) AS n_differing, coalesce(n_differing, 0) > 0 AS failed FROM a LEFT JOIN b USING (person) LEFT JOIN f USING (person)""")  # fmt: skip
def parity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parity(spark, sf_dir)[1]


@query("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS total, true AS users_near, true AS medians_near FROM events GROUP BY ALL")
def kept_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in four batches; sums are compared, sketches against exact counts within their bounds (four standard
    errors; twice the rank bound)."""
    base = f"{shared_folder(spark)}/arriving-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "value")
    events.repartition(4).write.parquet(f"{base}/in")
    summary = summaries.Summary({"n": "1", "total": "user_id"}, {"users": "user_id"}, {"values": "value"})
    arriving = streams.arriving(spark, f"{base}/in", events.schema.simpleString()[7:-1].replace(":", " "), files_per_batch=1)
    streams.keep_summary(arriving, f"{base}/kept", f"{base}/checkpoint", ["event_type"], summary).awaitTermination()
    told = summaries.told(streams.kept_summary(spark, f"{base}/kept"), summary, (0.5,)).withColumn("median", F.get("values", F.lit(0)))
    exact = table(spark, sf_dir, "events").join(F.broadcast(told.select("event_type", "median")), "event_type").groupBy("event_type").agg(
        F.count_distinct("user_id").alias("exact"), F.avg((F.col("value") < F.col("median")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("median")).cast("double")).alias("up_to")
    )
    bound = 2 * summaries.rank_bound()
    users = F.abs(F.col("users") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.0325 * F.col("exact"))
    return told.join(exact, "event_type").select("event_type", "n", "total", users.alias("users_near"), ((F.col("below") <= 0.5 + bound) & (F.col("up_to") >= 0.5 - bound)).alias("medians_near"))


_POOL = "SELECT regime, rk, dir_code, CAST(floor(called / 10) AS BIGINT) AS cell, CASE WHEN called >= 20 THEN CAST(floor(called / 15) AS BIGINT) END AS size_bin, person_id % 5 = 0 AS calibration, motif_size <= 3 AS representative, person_id % 2 = 0 AS variant FROM calls"
_LEVELS = "{name}_n AS (SELECT regime, cell, count(*) AS n FROM {pool} GROUP BY ALL), {name}_level AS (SELECT regime, max(v) AS level FROM (SELECT regime, v, sum(least(n, v)) AS s FROM {name}_n, (SELECT range AS v FROM range({cap} + 1)) z GROUP BY ALL) WHERE s <= {cap} GROUP BY ALL), {name} AS (SELECT p.* EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY regime, cell ORDER BY md5(concat_ws('|', '0', rk))) AS k FROM {pool}) p JOIN {name}_level USING (regime) WHERE k <= level)"
_WEIGHED = "{name}_w AS (SELECT s.*, CASE WHEN size_bin IS NULL OR dir_code = 0 THEN 1.0 ELSE coalesce((count_if(dir_code = 1) OVER w + count_if(dir_code = 2) OVER w) / 2 / CASE WHEN count_if(dir_code = 1) OVER w > 0 AND count_if(dir_code = 2) OVER w > 0 THEN CASE dir_code WHEN 1 THEN count_if(dir_code = 1) OVER w ELSE count_if(dir_code = 2) OVER w END END, 1.0) END AS weight FROM {name} s WINDOW w AS (PARTITION BY regime, size_bin))"


@query(f"""{WITH}, p AS ({_POOL}), t AS (SELECT * FROM p WHERE variant AND NOT calibration), o AS (SELECT * FROM p WHERE NOT variant AND NOT calibration), {_LEVELS.format(name="size", pool="t", cap=3000)}, {_LEVELS.format(name="plain", pool="o", cap=900)},
  direction AS (SELECT * FROM size UNION ALL SELECT * FROM plain), held AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY md5(concat_ws('|', '2', rk))) AS k FROM p WHERE calibration AND representative) WHERE k <= 600),
  {_WEIGHED.format(name="direction")}, {_WEIGHED.format(name="held")}
  SELECT 'direction' AS head, regime, rk, round(weight, 6) AS weight FROM direction_w UNION ALL SELECT 'calibration', regime, rk, round(weight, 6) FROM held_w UNION ALL SELECT 'size', regime, rk, 1.0::DOUBLE FROM size""")  # fmt: skip
def recipe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the heads of every regime: another population's for size, some without a variant, wrong classes balanced."""
    person, called = F.col("person_id"), F.col("called")
    pool = calls(spark, sf_dir).select(
        "regime", "rk", "dir_code", F.floor(called / 10).alias("cell"), F.when(called >= 20, F.floor(called / 15)).alias("size_bin"), (person % 5 == 0).alias("calibration"),
        (F.col("motif_size") <= 3).alias("representative"), (person % 2 == 0).alias("variant"),
    )
    found = recipes.recipe_rows(pool, recipes.Recipe(3000, ["cell"], 900, "size_bin"), ["rk"], pool.filter("variant"))
    return rounded(found.select("head", "regime", "rk", "weight"))
