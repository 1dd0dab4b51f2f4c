"""Queries of fits: sums and splits of boosted trees, and scores of a fitted model that went through its document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callquality.functions.exprs import UNIT_CATEGORY_EDGES
from callquality.operators import boosting, jobs, scoring
from callquality.plans.driver_queries import ROUTED, WITH, calls, query, r6, rounded, routed_model
from callquality.sources.models import model_documents, model_tables

FEATURES = ("called", "motif_size", "p_ok", "gappy")
_FITTED = f"""{WITH}, x AS (SELECT *, CASE WHEN chrom % 5 > 0 THEN lcf END AS gappy, ln(called / truth) AS t FROM calls), m AS (SELECT count(*) AS n, count_if(dir_code = 0) / count(*) AS s0, count_if(dir_code = 1) / count(*) AS s1, count_if(dir_code = 2) / count(*) AS s2 FROM x),
  e AS (SELECT c.class, CASE c.class WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS share FROM m, (VALUES (0), (1), (2)) c(class)),
  f AS (SELECT class, share, rk, dir_code, unnest([{{'feature': 0, 'v': called}}, {{'feature': 1, 'v': motif_size::DOUBLE}}, {{'feature': 2, 'v': p_ok}}, {{'feature': 3, 'v': gappy}}], recursive := true) FROM x, e),
  s AS (SELECT class, feature, v, sum(round_even((share - (dir_code = class)::INT) * 16777216, 0))::DOUBLE AS g, sum(round_even(share * (1 - share) * 16777216, 0))::DOUBLE AS h, count(*) AS n FROM f GROUP BY ALL)"""
_SPLITS = f"""{_FITTED}, u AS (SELECT *, sum(g) OVER p AS g_all, sum(h) OVER p AS h_all, sum(n) OVER p AS n_all, coalesce(sum(g) FILTER (v IS NULL) OVER p, 0) AS g_none, coalesce(sum(h) FILTER (v IS NULL) OVER p, 0) AS h_none, coalesce(sum(n) FILTER (v IS NULL) OVER p, 0) AS n_none,
    sum(g) FILTER (v IS NOT NULL) OVER o AS g_to, sum(h) FILTER (v IS NOT NULL) OVER o AS h_to, sum(n) FILTER (v IS NOT NULL) OVER o AS n_to FROM s WINDOW p AS (PARTITION BY class, feature), o AS (PARTITION BY class, feature ORDER BY v NULLS LAST ROWS UNBOUNDED PRECEDING)),
  l AS (SELECT *, g_to + CASE WHEN side THEN g_none ELSE 0 END AS g_left, h_to + CASE WHEN side THEN h_none ELSE 0 END AS h_left, n_to + CASE WHEN side THEN n_none ELSE 0 END AS n_left FROM u, (VALUES (true), (false)) w(side) WHERE v IS NOT NULL AND (side OR n_none > 0)),
  y AS (SELECT *, (g_left / 16777216)^2 / (h_left / 16777216 + 1) + ((g_all - g_left) / 16777216)^2 / ((h_all - h_left) / 16777216 + 1) - (g_all / 16777216)^2 / (h_all / 16777216 + 1) AS gain FROM l WHERE n_left >= 20 AND n_all - n_left >= 20),
  b AS (SELECT *, CASE WHEN n_none > 0 THEN side ELSE n_left >= n_all - n_left END AS missing_left FROM y WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY class ORDER BY gain DESC, feature, v, side DESC) = 1)"""


def _fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with a feature that is missing on some partitions, and the size head's target."""
    return calls(spark, sf_dir).withColumns({"gappy": F.when(F.col("chrom") % 5 > 0, F.col("lcf")), "t": F.ln(F.col("called") / F.col("truth")), "motif_size": F.col("motif_size").cast("double")})


@query(f"""{_SPLITS} SELECT class, feature, v AS threshold, missing_left, round(gain, 6) AS gain, n_left::BIGINT AS n_left, n_all::BIGINT AS n FROM b""")
def root_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best first split of each class, from sums of gradients by bin."""
    df = _fitted(spark, sf_dir)
    cuts = boosting.feature_cuts(df, FEATURES)
    base = [boosting.log_share(s) for s in boosting.class_shares(df, "dir_code")]
    rows = boosting.binned_rows(df, FEATURES, "dir_code", None, cuts, base)
    found = boosting.best_splits(boosting.level_sums(rows, "log_loss", len(FEATURES), [], [boosting.GrownTree.stump() for _ in base], [[0]] * len(base)))
    values = spark.createDataFrame([(f, b, float(v)) for f, cut in enumerate(cuts) for b, v in enumerate(cut)], "feature int, bin int, threshold double")
    return found.join(F.broadcast(values), ["feature", "bin"]).select("class", "feature", "threshold", "missing_left", r6("gain").alias("gain"), F.col("n_left"), "n")


@query(f"""{_SPLITS}, w AS (SELECT x.rk, b.class, e.share, -0.3 * (CASE WHEN CASE WHEN val IS NULL THEN missing_left ELSE val <= v END THEN g_left / (h_left + 16777216) ELSE (g_all - g_left) / (h_all - h_left + 16777216) END) + ln(greatest(e.share, 1e-12)) AS raw
    FROM x, b JOIN e USING (class), LATERAL (SELECT CASE b.feature WHEN 0 THEN called WHEN 1 THEN motif_size WHEN 2 THEN p_ok ELSE gappy END AS val) z)
  SELECT class, count(*) AS n, round(avg(p), 4) AS mean_p, round(max(p), 3) AS top_p, round(min(p), 3) AS low_p FROM (SELECT rk, class, round_even(exp(raw) / sum(exp(raw)) OVER (PARTITION BY rk), 3) AS p FROM w) GROUP BY class""")  # fmt: skip
def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round of boosted trees, written as a model document, read again and used to score all rows."""
    df = _fitted(spark, sf_dir).withColumn("one", F.lit("all"))
    nodes = boosting.fit_boosted(df, FEATURES, "dir_code", "log_loss", iterations=1, rate=0.3, depth=1, least_rows=20).select(F.lit("all").alias("regime"), "*")
    nodes, knots = model_tables(model_documents(nodes, spark.createDataFrame([], "regime string, class int, i int, x double, y double")))
    scored = scoring.score(df.select("rk", "one", *FEATURES), nodes, knots, {"all": list(FEATURES)}, "one")
    each = scored.select(F.posexplode(F.array("p_0", "p_1", "p_2")).alias("class", "p"))
    found = each.groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("mean_p"), F.max("p").alias("top_p"), F.min("p").alias("low_p"))
    return rounded(found)


_CATEGORY = "CASE " + " ".join(f"WHEN motif_size < {edge} THEN {k}" for k, edge in enumerate(UNIT_CATEGORY_EDGES)) + f" ELSE {len(UNIT_CATEGORY_EDGES)} END"
_EVALUATED = f"""{ROUTED}, g AS (SELECT rk, round(factor, 3) AS factor, round(q0 / (q0 + q1 + q2), 3) AS p_0, round(q1 / (q0 + q1 + q2), 3) AS p_1, round(q2 / (q0 + q1 + q2), 3) AS p_2 FROM q),
  r AS (SELECT c.*, row_number() OVER (PARTITION BY sample_id ORDER BY md5('5|' || rk)) AS place FROM calls c),
  w AS (SELECT sample_id, regime, CASE WHEN motif_size = 1 THEN 'one' ELSE 'more' END AS stratum, {_CATEGORY} AS category, g.p_0 < 0.5 AS fires, truth, called, round_even(called / factor, 0) AS made, dir_code,
    CASE WHEN g.p_0 >= g.p_1 AND g.p_0 >= g.p_2 THEN 0 WHEN g.p_1 >= g.p_2 THEN 1 ELSE 2 END AS likeliest FROM r JOIN g USING (rk) WHERE place <= 40 AND NOT (dir_code = 2 AND chrom = 3)),
  z AS (SELECT *, abs(truth - called) AS before, abs(truth - made) AS own, CASE WHEN fires THEN abs(truth - made) ELSE abs(truth - called) END AS gated, CASE WHEN fires THEN made ELSE called END AS final FROM w)"""
_COUNTS = ", ".join(f"count_if({side}) AS n_{name}, count_if({side} AND own < before - 1e-9) AS helped_{name}, count_if({side} AND own > before + 1e-9) AS hurt_{name}" for name, side in (("below", "fires"), ("from", "NOT fires")))


def _evaluated(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    df = calls(spark, sf_dir)
    raw = df.withColumn("contradicted", (F.col("dir_code") == 2) & (F.col("chrom") == 3)).drop("dir_code", "tol", "p_ok", "p_too_long", "p_too_short", "lcf", "corrected", "fixed")
    return jobs.evaluate_model(raw, *routed_model(df), ["called", "truth"], "sample_id", ["rk"], "motif_size", cap=40, contradicted="contradicted", seed=5)


@query(f"""{_EVALUATED} SELECT regime, stratum, count(*) AS n, round(avg(before), 6) AS mae_raw, round(avg(gated), 6) AS mae_gated, round(1 - avg(gated) / nullif(avg(before), 0), 6) AS dist_reduction, round(median(before), 6) AS median_raw, round(median(gated), 6) AS median_gated,
  round(avg((round_even(called, 0) = round_even(truth, 0))::INT), 6) AS exact_raw, round(avg((round_even(final, 0) = round_even(truth, 0))::INT), 6) AS exact_gated, round(avg((likeliest = dir_code)::INT), 6) AS class_right, round(avg((fires = (dir_code <> 0))::INT), 6) AS gate_right, {_COUNTS} FROM z GROUP BY ALL""")  # fmt: skip
def model_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model against raw calls: labels, cap, contradicted rows, scores and the summary, units of one base apart."""
    return rounded(_evaluated(spark, sf_dir)["summary"])


@query(f"""{_EVALUATED} SELECT 'stratum ' || stratum AS part, regime, sample_id, count(*) AS n, round(sum(before), 6) AS sum_raw, round(sum(gated), 6) AS sum_gated FROM z GROUP BY ALL
  UNION ALL SELECT 'category ' || category, regime, sample_id, count(*), round(sum(before), 6), round(sum(gated), 6) FROM z GROUP BY ALL""")
def model_evaluation_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums by which two models are paired sample by sample."""
    found = _evaluated(spark, sf_dir)
    parts = [found[t].select(F.concat(F.lit(f"{c} "), c).alias("part"), "regime", "sample_id", "n", "sum_raw", "sum_gated") for t, c in (("by_sample", "stratum"), ("by_category", "category"))]
    return rounded(parts[0].unionByName(parts[1]))
