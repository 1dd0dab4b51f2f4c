"""Queries of the library's operators over the driver's tables, and the SQL that gives the same rows.

Line items stand in for calls: an order is an entity, a supplier a sample, its nation a person, the quantity a called
value, and the part's size gives a truth near it. Doubles are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callquality.functions import exprs as E
from callquality.functions import motifs as M
from callquality.functions import parse as P
from callquality.operators import categories, compare, components, intervals, joins, metrics, ordering, sampling, scoring, splits
from callquality.operators.shared import counted_broadcast
from callquality.streaming import streams

#: Rows of a broadcast of suppliers.
MOST_SUPPLIERS = 1_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CALLS = """
SELECT l.l_orderkey AS locus_id, l.l_suppkey AS sample_id, s.s_nationkey AS person_id, l.l_suppkey % 24 AS chrom,
       l.l_returnflag AS regime, l.l_linenumber AS motif_size, l.l_quantity AS called,
       GREATEST(CAST(1 AS DOUBLE), l.l_quantity + (p.p_size % 9) - 4) AS truth,
       1 + (l.l_tax - CAST(0.04 AS DOUBLE)) * 2 AS lcf,
       CAST(l.l_discount * 10 AS DOUBLE) AS p_ok,
       (1 - l.l_discount * 10) * (l.l_tax / CAST(0.08 AS DOUBLE)) AS p_too_long,
       (1 - l.l_discount * 10) * (1 - l.l_tax / CAST(0.08 AS DOUBLE)) AS p_too_short,
       l.l_partkey AS part, l.l_extendedprice AS price,
       concat_ws('|', l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, CAST(l.l_quantity AS INT), CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS rk
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
"""
#: Calls with rounded probabilities (they are sums of decimal fractions) and their labels.
LABELLED = f"""
SELECT c.*, motif_size * rint(truth) AS size,
  CASE WHEN motif_size * rint(truth) < 50 THEN 0 WHEN motif_size * rint(truth) <= 120 THEN 1 WHEN motif_size * rint(truth) < 270 THEN 2 WHEN motif_size * rint(truth) < 600 THEN 4 ELSE 8 END AS tol
FROM (SELECT * REPLACE (round(p_ok, 3) AS p_ok, round(p_too_long, 3) AS p_too_long, round(p_too_short, 3) AS p_too_short, round(lcf, 3) AS lcf) FROM ({CALLS})) c
"""
WITH = f"WITH labelled0 AS ({LABELLED.replace('rint(truth)', 'round_even(truth, 0)')}), calls AS (SELECT *, CASE WHEN round_even(called, 0) - round_even(truth, 0) > tol THEN 1 WHEN round_even(called, 0) - round_even(truth, 0) < -tol THEN 2 ELSE 0 END AS dir_code, CASE WHEN p_ok < 0.5 AND lcf > 0 THEN round_even(called / lcf, 0) ELSE called END AS fixed, round_even(called / lcf, 0) AS corrected FROM labelled0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The calls with labels: size, tol, dir_code, corrected, and fixed (corrected where the gate fires).

    ``dealt``: by entity, before keys and labels are derived, as table columns take less disk; suppliers meet the lines by
    a broadcast if they are at most ``MOST_SUPPLIERS``."""
    l, p, s = (table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier"))  # noqa: E741
    s = counted_broadcast(s, MOST_SUPPLIERS) if dealt else s
    j = l.join(p, l["l_partkey"] == p["p_partkey"]).join(s, l["l_suppkey"] == s["s_suppkey"])
    j = j.repartition("l_orderkey") if dealt else j
    tax, q, d = F.col("l_tax"), F.col("l_quantity"), F.col("l_discount")
    r3 = lambda c: F.round(c, 3)
    rk = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", q.cast("int"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    df = j.select(
        F.col("l_orderkey").alias("locus_id"), F.col("l_suppkey").alias("sample_id"), F.col("s_nationkey").alias("person_id"), (F.col("l_suppkey") % 24).alias("chrom"),
        F.col("l_returnflag").alias("regime"), F.col("l_linenumber").alias("motif_size"), q.alias("called"), F.greatest(F.lit(1.0), q + F.col("p_size") % 9 - 4).alias("truth"),
        r3(1 + (tax - 0.04) * 2).alias("lcf"), r3((d * 10).cast("double")).alias("p_ok"), r3((1 - d * 10) * (tax / 0.08)).alias("p_too_long"), r3((1 - d * 10) * (1 - tax / 0.08)).alias("p_too_short"),
        F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"), rk.alias("rk"),
    )
    df = df.withColumn("size", E.absolute_size("motif_size", "truth")).withColumn("tol", E.tolerance("size"))
    df = df.withColumn("dir_code", E.direction_code("called", "truth", F.col("tol")))
    return df.withColumn("corrected", E.half_even(F.col("called") / F.col("lcf"))).withColumn("fixed", E.corrected("called", "lcf", E.gate_fires("p_ok", "lcf")))


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    return F.round(E.col(c), 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(n).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


# Labels and errors


@query(f"""{WITH} SELECT regime, count(*) AS n, round(avg(abs(truth - called)), 6) AS mae_raw,
  round(avg(abs(truth - CASE WHEN p_ok < 0.5 THEN corrected ELSE called END)), 6) AS mae_gated, count_if(p_ok < 0.5) AS n_gated,
  count_if(p_ok < 0.5 AND abs(truth - corrected) < abs(truth - called) - 1e-9) AS helped, count_if(p_ok < 0.5 AND abs(truth - corrected) > abs(truth - called) + 1e-9) AS hurt
  FROM calls GROUP BY regime""")  # fmt: skip
def gated_mae_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.gated_errors(calls(spark, sf_dir), ["regime"]))


@query(f"{WITH} SELECT dir_code, tol, count(*) AS n, round(sum(size), 6) AS total_size FROM calls GROUP BY ALL")
def direction_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calls(spark, sf_dir).groupBy("dir_code", "tol").agg(F.count("*").alias("n"), F.sum("size").alias("total_size")))


@query(f"""{WITH}, marked AS (SELECT CASE WHEN called < 3 THEN 'small' WHEN truth > 50 THEN 'large_truth' WHEN p_ok >= 0.9 THEN 'sure' WHEN chrom >= 22 THEN 'partition' END AS reason FROM calls)
  SELECT n.reason, n.place, count(m.reason) AS n FROM (VALUES ('small', 0), ('large_truth', 1), ('sure', 2), ('partition', 3), ('never', 4)) n(reason, place) LEFT JOIN marked m ON m.reason = n.reason GROUP BY ALL""")  # fmt: skip
def drop_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {"small": F.col("called") < 3, "large_truth": F.col("truth") > 50, "sure": F.col("p_ok") >= 0.9, "partition": F.col("chrom") >= 22, "never": F.lit(False)}
    return categories.drop_ledger(calls(spark, sf_dir), tests)[1]


_ARGMAX = "CASE WHEN p_ok >= p_too_long AND p_ok >= p_too_short THEN 0 WHEN p_too_long >= p_too_short THEN 1 ELSE 2 END"


@query(f"""{WITH}, c AS (SELECT dir_code AS label, {_ARGMAX} AS predicted, count(*) AS n FROM calls GROUP BY ALL),
  grid AS (SELECT a.v AS label, b.v AS predicted FROM (VALUES (0), (1), (2)) a(v), (VALUES (0), (1), (2)) b(v))
  SELECT g.label, g.predicted, coalesce(n, 0) AS n, round(coalesce(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY g.label), 0), 0), 6) AS share FROM grid g LEFT JOIN c ON c.label = g.label AND c.predicted = g.predicted""")  # fmt: skip
def direction_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion(calls(spark, sf_dir), "dir_code", ["p_ok", "p_too_long", "p_too_short"]))


@query(f"""{WITH} SELECT regime, count(*) AS n, round(avg(abs(ln(called) - ln(truth) - ln(lcf))), 6) AS mae_t, round(avg(abs(truth - called / lcf)), 6) AS mae_true, round(avg(abs(truth - called)), 6) AS mae_raw,
  round(median(abs(truth - called / lcf)), 6) AS median_ae_true, round(median(abs(truth - called)), 6) AS median_ae_raw, round(1 - avg(abs(truth - called / lcf)) / avg(abs(truth - called)), 6) AS dist_reduction,
  round(avg((round_even(called / lcf, 0) = round_even(truth, 0))::INT), 6) AS exact_match_rate, round(avg((round_even(called, 0) = round_even(truth, 0))::INT), 6) AS raw_exact_match_rate,
  round(avg((abs(round_even(called / lcf, 0) - round_even(truth, 0)) <= tol)::INT), 6) AS within_tol_rate, round(avg((abs(round_even(called, 0) - round_even(truth, 0)) <= tol)::INT), 6) AS raw_within_tol_rate
  FROM calls GROUP BY regime""")  # fmt: skip
def tolerance_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumns({"predicted": F.col("called") / F.col("lcf"), "t": E.log_ratio("called", "truth"), "t_predicted": F.ln("lcf")})
    return rounded(metrics.point_metrics(df, ["regime"]))


@query(f"""{WITH} SELECT regime, round(avg(-ln(least(greatest(CASE dir_code WHEN 0 THEN p_ok WHEN 1 THEN p_too_long ELSE p_too_short END, 1e-6), 1 - 1e-6))), 6) AS log_loss FROM calls GROUP BY regime""")
def direction_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.log_loss(calls(spark, sf_dir), "dir_code", ["p_ok", "p_too_long", "p_too_short"], ["regime"], 1e-6))


@query(f"{WITH} SELECT regime, round(avg(({_ARGMAX} = dir_code)::INT), 6) AS accuracy, round(avg(((p_ok < 0.5) = (dir_code <> 0))::INT), 6) AS gate_accuracy FROM calls GROUP BY regime")
def direction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.accuracy(calls(spark, sf_dir), "dir_code", ["p_ok", "p_too_long", "p_too_short"], ["regime"]))


@query(f"""{WITH}, b AS (SELECT regime, least(greatest(CAST(floor(p_ok * 10) AS INT), 0), 9) AS b, count(*) AS n, avg(p_ok) AS p, avg((dir_code = 0)::INT) AS y FROM calls GROUP BY ALL)
  SELECT regime, round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b GROUP BY regime""")  # fmt: skip
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration_error(calls(spark, sf_dir).withColumn("ok", F.col("dir_code") == 0), "p_ok", "ok", ["regime"]))


_SCORES = f"""{WITH}, s AS (SELECT regime, 1 - p_ok AS score, count_if(dir_code <> 0) AS pos, count_if(dir_code = 0) AS neg FROM calls GROUP BY ALL),
  t AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pos_above, coalesce(sum(neg) OVER w, 0) AS neg_above, sum(pos) OVER (PARTITION BY regime) AS n_pos, sum(neg) OVER (PARTITION BY regime) AS n_neg
  FROM s WINDOW w AS (PARTITION BY regime ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _suspicion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).withColumn("suspicion", 1 - F.col("p_ok")).withColumn("off", F.col("dir_code") != 0)


@query(f"{_SCORES} SELECT regime, round(sum(neg * (pos_above + pos / 2)) / (max(n_pos) * max(n_neg)), 6) AS auc, CAST(max(n_pos) AS BIGINT) AS n_pos, CAST(max(n_neg) AS BIGINT) AS n_neg FROM t GROUP BY regime")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_auc(_suspicion(spark, sf_dir), "suspicion", "off", ["regime"]))


@query(f"{_SCORES} SELECT regime, round(sum(pos / n_pos * (pos_above + pos) / (pos_above + pos + neg_above + neg)), 6) AS average_precision FROM t GROUP BY regime")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_precision(_suspicion(spark, sf_dir), "suspicion", "off", ["regime"]))


@query(f"{_SCORES} SELECT regime, round(score, 6) AS score, round((pos_above + pos) / n_pos, 6) AS recall, round((pos_above + pos) / (pos_above + pos + neg_above + neg), 6) AS precision, round((neg_above + neg) / n_neg, 6) AS false_positive_rate FROM t")
def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.curve_points(_suspicion(spark, sf_dir), "suspicion", "off", ["regime"]))


@query(f"""{_SCORES}, r AS (SELECT t.*, rate FROM t, (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.2::DOUBLE)) v(rate))
  SELECT regime, rate, round(sum(greatest(0, least(1, (floor(rate * (n_pos + n_neg)) - pos_above - neg_above) / (pos + neg))) * pos) / max(n_pos), 6) AS recall FROM r GROUP BY ALL""")  # fmt: skip
def tie_aware_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.tie_aware_recall(_suspicion(spark, sf_dir), "suspicion", "off", [0.01, 0.05, 0.2], ["regime"]))


@query(f"""{WITH}, e AS (SELECT sample_id, locus_id, avg(p_ok) AS p_ok, max(abs(called - 20)) AS c, max(abs(truth - 20)) AS t FROM calls GROUP BY ALL)
  SELECT sample_id, locus_id, round(p_ok, 6) AS p_ok, c <= 1 AS reference_call, c <= 1 AND t > 2 AS miss FROM e""")  # fmt: skip
def early_warning_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumns({"c": F.abs(F.col("called") - 20), "t": F.abs(F.col("truth") - 20)})
    return rounded(metrics.entity_fold(df, ["sample_id", "locus_id"], "p_ok", "c", "t", F.col("motif_size") == 1).select("sample_id", "locus_id", "p_ok", "reference_call", "miss"))


@query(f"""{WITH}, u AS (SELECT regime, 'all' AS stratum, abs(truth - called) - abs(truth - fixed) AS gain FROM calls UNION ALL SELECT regime, 'gated', abs(truth - called) - abs(truth - fixed) FROM calls WHERE p_ok < 0.5
  UNION ALL SELECT regime, 'homopolymer', abs(truth - called) - abs(truth - fixed) FROM calls WHERE motif_size = 1)
  SELECT regime, stratum, count(*) AS n, round(avg(gain), 6) AS mean, round(min(gain), 6) AS low, round(max(gain), 6) AS high, round(quantile_cont(gain, 0.25), 6) AS q25, round(quantile_cont(gain, 0.5), 6) AS q50, round(quantile_cont(gain, 0.75), 6) AS q75 FROM u GROUP BY ALL""")  # fmt: skip
def reduction_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumn("gain", F.abs(F.col("truth") - F.col("called")) - F.abs(F.col("truth") - F.col("fixed")))
    df = metrics.strata(df, {"all": F.lit(True), "gated": F.col("p_ok") < 0.5, "homopolymer": F.col("motif_size") == 1})
    d = metrics.distribution(df, ["regime", "stratum"], "gain", (0.25, 0.5, 0.75))
    return rounded(d.select("regime", "stratum", "n", "mean", "low", "high", *[F.get("percentiles", F.lit(k)).alias(f"q{q}") for k, q in enumerate((25, 50, 75))]))


@query(f"""{WITH} SELECT regime, person_id, count(*) AS n, round(avg(abs(truth - fixed)), 6) AS mae FROM calls GROUP BY GROUPING SETS ((regime, person_id), (regime), ())""")
def summary_by_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = metrics.grouping_sets(calls(spark, sf_dir), ["regime", "person_id"], [["regime", "person_id"], ["regime"], []], F.count("*").alias("n"), F.avg(F.abs(F.col("truth") - F.col("fixed"))).alias("mae"))
    return rounded(g)


@query(f"""{WITH}, f AS (SELECT regime, unnest(['fixed', 'corrected']) AS field, called AS a, unnest([fixed, corrected]) AS b FROM calls)
  SELECT regime, field, count(*) AS n, round(median(a), 6) AS median_a, round(median(b), 6) AS median_b, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(median(a - b), 6) AS median_difference, round(avg((a = b)::INT), 6) AS share_equal FROM f GROUP BY ALL""")  # fmt: skip
def paired_field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.paired_summary(calls(spark, sf_dir), ["regime"], {"fixed": ("called", "fixed"), "corrected": ("called", "corrected")}))


@query(f"""{WITH} SELECT CAST(floor(called / 10) AS BIGINT) AS size_bin, count(*) AS n, round(median(p_ok), 6) AS median_score, round(avg((p_ok >= 0.5)::INT), 6) AS share_half, round(avg((called < truth)::INT), 6) AS share_under, round(avg(truth / called), 6) AS mean_ratio FROM calls GROUP BY ALL""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.score_summary(calls(spark, sf_dir).withColumn("size_bin", F.floor(F.col("called") / 10)), ["size_bin"], "p_ok", "called", "truth"))


@query(f"""{WITH}, c AS (SELECT dir_code, count(*) AS n FROM calls GROUP BY ALL), g AS (SELECT v AS dir_code, coalesce(n, 0) AS n FROM (VALUES (0), (1), (2), (3)) x(v) LEFT JOIN c ON c.dir_code = v)
  SELECT dir_code, n, round(n / sum(n) OVER (), 6) AS prior FROM g""")  # fmt: skip
def class_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_prior(calls(spark, sf_dir), "dir_code", 4))


@query(f"""{WITH} SELECT regime, round(avg(greatest(0.5 * (truth - fixed), -0.5 * (truth - fixed))), 6) AS pinball, round(sum(price * abs(truth - fixed)) / sum(price), 6) AS weighted_error FROM calls GROUP BY ALL""")
def weighted_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.abs(F.col("truth") - F.col("fixed"))
    return rounded(calls(spark, sf_dir).groupBy("regime").agg(metrics.pinball(F.col("truth"), F.col("fixed")).alias("pinball"), metrics.weighted_mean(off, F.col("price")).alias("weighted_error")))


# Categories and bins

_BIN = "CASE " + " ".join(f"WHEN round_even({{x}}, 0) <= {e} THEN {k}" for k, e in enumerate(E.DIFFERENCE_EDGES)) + f" ELSE {len(E.DIFFERENCE_EDGES)} END"
_UNIT = "CASE " + " ".join(f"WHEN {{x}} < {e} THEN {k}" for k, e in enumerate(E.UNIT_CATEGORY_EDGES)) + f" ELSE {len(E.UNIT_CATEGORY_EDGES)} END"
_CATEGORY = """CASE WHEN truth <> 25 AND all_ref THEN 'Called Hom Ref' WHEN truth <> 25 AND is_ref THEN 'Called Het Ref' WHEN (truth - 25) * (e - 25) < 0 THEN 'Wrong Direction'
  WHEN abs(e - truth) <= 1 THEN 'Same' WHEN abs(e - truth) <= 2 THEN CASE WHEN e < truth THEN '-2' ELSE '2' END WHEN abs(e - truth) <= 4 THEN CASE WHEN e < truth THEN '-3 to -4' ELSE '3 to 4' END
  WHEN abs(e - truth) <= 7 THEN CASE WHEN e < truth THEN '-5 to -7' ELSE '5 to 7' END WHEN abs(e - truth) <= 20 THEN CASE WHEN e < truth THEN '-8 to -20' ELSE '8 to 20' END ELSE CASE WHEN e < truth THEN '-21 or more' ELSE '21 or more' END END"""
_PAIRED = f"""{WITH}, v AS (SELECT rk, locus_id, regime, truth, fixed, row_number() OVER (PARTITION BY locus_id ORDER BY fixed NULLS LAST, rk) AS kc, row_number() OVER (PARTITION BY locus_id ORDER BY truth NULLS LAST, rk) AS kt FROM calls),
  m AS (SELECT t.rk, t.locus_id, t.regime, t.truth, c.fixed AS e FROM v t JOIN v c ON t.locus_id = c.locus_id AND t.kt = c.kc),
  f AS (SELECT *, e = 25 AS is_ref, bool_and(e = 25) OVER (PARTITION BY locus_id) AS all_ref FROM m), k AS (SELECT *, {_CATEGORY} AS category, {_BIN.format(x="truth - 25")} AS bin FROM f)"""


def _categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumn("reference", F.lit(25.0))
    return categories.corrected_categories(df, ["locus_id"], ["rk"], "called", "truth", "reference", "lcf", "p_ok").withColumn("bin", E.difference_bin(F.col("truth") - 25))


@query(f"{_PAIRED} SELECT regime, category, count(*) AS n, round(sum(e), 6) AS total FROM k GROUP BY ALL")
def repaired_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_categorised(spark, sf_dir).groupBy("regime", "category").agg(F.count("*").alias("n"), F.sum("_effective").alias("total")))


@query(f"""{_PAIRED}, g AS (SELECT regime, count(*) AS total, count(DISTINCT locus_id) AS entities FROM k GROUP BY ALL), c AS (SELECT regime, bin, category, count(*) AS n FROM k GROUP BY ALL)
  SELECT g.regime, total, entities, b.bin, x.category, coalesce(n, 0) AS n FROM g CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(27)) b CROSS JOIN (SELECT unnest([{", ".join(f"'{c}'" for c in categories.CATEGORIES)}]) AS category) x
  LEFT JOIN c ON c.regime = g.regime AND c.bin = b.bin AND c.category = x.category""")  # fmt: skip
def stacked_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binned_counts(_categorised(spark, sf_dir), ["regime"], "bin", "category", 27, categories.CATEGORIES, "locus_id")


@query(f"""{WITH} SELECT {_UNIT.format(x="motif_size")} AS unit, {_BIN.format(x="truth - called")} AS difference, CASE WHEN truth < 20 THEN '0-20' WHEN truth < 50 THEN '20-50' WHEN truth < 100 THEN '50-100' WHEN truth < 200 THEN '100-200' ELSE '200+' END AS truth_size,
  CASE WHEN lcf < 0.5 THEN 0 WHEN lcf < 0.8 THEN 1 WHEN lcf < 1.25 THEN 2 ELSE 3 END AS factor_bin, CASE WHEN motif_size BETWEEN 1 AND 2 THEN 0 WHEN motif_size BETWEEN 5 AND 6 THEN 1 ELSE -1 END AS gap_bin, least(floor(called / 20), 1) * 20 AS width_bin, count(*) AS n FROM calls GROUP BY ALL""")  # fmt: skip
def value_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir)
    return df.groupBy(E.unit_category("motif_size").alias("unit"), E.difference_bin(F.col("truth") - F.col("called")).alias("difference"), E.size_label("truth", E.TRUTH_SIZE_EDGES, E.TRUTH_SIZE_LABELS).alias("truth_size"), E.bin_index("lcf", E.FACTOR_EDGES[:3]).alias("factor_bin"), E.bin_with_gaps("motif_size", [(1, 2), (5, 6)]).alias("gap_bin"), E.width_bin("called", 20, 1).cast("double").alias("width_bin")).agg(F.count("*").alias("n"))


@query(f"{WITH}, s AS (SELECT sample_id, avg(CASE WHEN chrom >= 22 THEN (motif_size = 1)::INT END) AS share FROM calls GROUP BY ALL) SELECT sample_id, round(share, 6) AS share, CASE WHEN share > 0.2 THEN 'male' ELSE 'female' END AS sex FROM s")
def group_sex(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumn("p", F.when(F.col("chrom") == 22, "X").when(F.col("chrom") == 23, "Y").otherwise(F.col("chrom").cast("string")))
    found = categories.inferred_sex(df, "sample_id", "p", "motif_size")
    return rounded(found.withColumn("sex", F.when(F.col("share") > 0.2, "male").otherwise("female")))


@query(f"{WITH} SELECT locus_id, max(called) AS most, min(p_ok) AS least FROM calls GROUP BY ALL HAVING max(called) >= 30 AND min(p_ok) >= 0.3 AND NOT bool_or(motif_size = 7)")
def group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {"most": F.max("called"), "least": F.min("p_ok"), "flag": F.bool_or(F.col("motif_size") == 7)}
    return categories.group_filter(calls(spark, sf_dir), ["locus_id"], tests, (F.col("most") >= 30) & (F.col("least") >= 0.3) & ~F.col("flag")).drop("flag")


_READS = f"""{WITH}, t AS (SELECT locus_id, min(truth) AS short, max(truth) AS long, 3 AS unit FROM calls GROUP BY ALL),
  r AS (SELECT c.locus_id, CASE WHEN motif_size % 3 = 0 THEN 'left' WHEN motif_size % 7 = 5 THEN 'right' ELSE 'spanning' END AS kind, CASE WHEN p_ok < 0.5 THEN '+' ELSE '-' END AS strand,
    CAST(truth * 3 + k * 2 AS BIGINT) AS length, CAST(40 + motif_size AS INT) AS mapq, CAST(15 + motif_size * 2 AS INT) AS quality FROM calls c, (SELECT CAST(range AS INT) AS k FROM range(6)) x),
  j AS (SELECT r.*, short, long, unit, floor(length / unit) AS v, kind = 'spanning' AS sp, kind = 'spanning' AND quality >= 20 AS clean,
    (kind = 'left' AND strand = '+') OR (kind = 'right' AND strand = '-') AS at3 FROM r JOIN t USING (locus_id) WHERE mapq >= 40),
  q AS (SELECT *, abs(v - short) >= 2 AND abs(v - short) * unit >= 3 AS fs, abs(v - long) >= 2 AND abs(v - long) * unit >= 3 AS fl FROM j),
  n AS (SELECT locus_id, count(*) AS n_reads, count_if(sp) AS ns, count_if(clean) AS nc, count_if(clean AND abs(v - short) <= 1 AND (short = long OR abs(v - short) < abs(v - long))) AS f1, count_if(clean AND abs(v - long) <= 1 AND (short = long OR abs(v - long) < abs(v - short))) AS f2,
    count_if(v > long AND fl) AS longer, count_if(v > long AND fl AND quality >= 20 AND (sp OR NOT at3)) AS robust, count_if(v > long AND fl AND sp) AS ls, count_if(v > long AND fl AND quality >= 20 AND (sp OR NOT at3) AND v * unit > 90) AS rl FROM q GROUP BY ALL),
  k AS (SELECT locus_id, max(m) AS cluster FROM (SELECT locus_id, v + d AS center, count(*) AS m FROM q, (VALUES (-1), (0), (1)) z(d) WHERE clean AND fs AND fl GROUP BY ALL) GROUP BY ALL),
  a AS (SELECT t.*, coalesce(n_reads, 0) AS n_reads, ns, nc, coalesce(cluster, 0) AS cluster, coalesce(longer, 0) AS longer, robust, ls, rl,
    nc >= 8 AND ((short * unit <= 90 AND f1 <= 0.1 * nc) OR (long * unit <= 90 AND f2 <= 0.1 * nc)) AS un FROM t LEFT JOIN n USING (locus_id) LEFT JOIN k USING (locus_id))
  SELECT locus_id, n_reads, cluster, longer, CASE WHEN n_reads < 10 THEN 'too_few_reads' WHEN cluster >= 4 AND cluster >= 0.25 * ns AND (short = long OR un) THEN 'contradicted_by_spanning'
    WHEN longer >= 4 AND longer >= 0.25 * n_reads AND robust >= 3 AND (rl > 0 OR ls >= 2) AND (short = long OR long * unit > 90 OR un) THEN 'contradicted_by_longer'
    WHEN short <> long AND nc >= 8 AND long * unit <= 90 AND NOT un THEN 'both_supported' ELSE 'not_contradicted' END AS verdict FROM a"""


@query(_READS)
def truth_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir)
    truth = df.groupBy("locus_id").agg(F.min("truth").alias("short"), F.max("truth").alias("long"), F.lit(3).alias("unit"))
    kind = F.when(F.col("motif_size") % 3 == 0, "left").when(F.col("motif_size") % 7 == 5, "right").otherwise("spanning")
    reads = df.select("locus_id", kind.alias("kind"), F.when(F.col("p_ok") < 0.5, "+").otherwise("-").alias("strand"), "truth", (40 + F.col("motif_size")).cast("int").alias("mapq"), (15 + F.col("motif_size") * 2).cast("int").alias("quality"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    return categories.truth_verdicts(reads.withColumn("length", (F.col("truth") * 3 + F.col("k") * 2).cast("long")), truth)


# Samples and splits

_CELL = "CASE WHEN motif_size = 1 THEN 1 ELSE 0 END * 10 + CAST(floor(called / 20) AS INT)"
_LEVEL = """lv AS (SELECT coalesce(min_by(floor(({cap} - done) / remaining), n) FILTER (WHERE total > {cap} AND n * remaining + done > {cap}), max(n)) AS level FROM
  (SELECT n, coalesce(sum(n) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, count(*) OVER () - count(*) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS remaining, sum(n) OVER () AS total FROM cells))"""


def _celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).withColumn("cell", (F.col("motif_size") == 1).cast("int") * 10 + F.floor(F.col("called") / 20).cast("int"))


@query(f"""{WITH}, c AS (SELECT *, {_CELL} AS cell FROM calls), cells AS (SELECT cell, count(*) AS n FROM c GROUP BY ALL), {_LEVEL.format(cap=5000)},
  r AS (SELECT rk, cell, row_number() OVER (PARTITION BY cell ORDER BY md5(concat_ws('|', '0', rk))) AS k FROM c) SELECT rk, cell FROM r, lv WHERE k <= level""")  # fmt: skip
def quota_sample_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota_sample(_celled(spark, sf_dir), ["cell"], 5000, ["rk"]).select("rk", "cell")


@query(f"""{WITH}, c AS (SELECT *, {_CELL} AS cell, p_ok < 0.1 AS chosen FROM calls), cells AS (SELECT cell, count(*) AS n, count_if(chosen) AS have FROM c GROUP BY ALL), {_LEVEL.format(cap=8000)},
  need AS (SELECT cell, least(n, level) - have AS need FROM cells, lv), r AS (SELECT rk, cell, row_number() OVER (PARTITION BY cell ORDER BY md5(concat_ws('|', '0', rk))) AS k FROM c WHERE NOT chosen)
  SELECT rk, cell FROM r JOIN need USING (cell) WHERE k <= need""")  # fmt: skip
def quota_top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota_top_up(_celled(spark, sf_dir).withColumn("chosen", F.col("p_ok") < 0.1), "chosen", ["cell"], 8000, ["rk"]).select("rk", "cell")


@query(f"""{WITH}, r AS (SELECT rk, regime, row_number() OVER (PARTITION BY regime ORDER BY md5(concat_ws('|', '0', rk))) AS k FROM calls) SELECT rk, regime FROM r WHERE k <= 1000""")
def capped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cap_rows(calls(spark, sf_dir), 1000, ["rk"], by=["regime"]).select("rk", "regime")


@query(f"""{WITH}, e AS (SELECT locus_id, count_if(p_ok > 0.2) AS n FROM calls GROUP BY ALL), s AS (SELECT locus_id, sum(n) OVER (ORDER BY md5(concat_ws('|', '0', locus_id)) ROWS UNBOUNDED PRECEDING) AS total FROM e)
  SELECT rk FROM calls SEMI JOIN (SELECT locus_id FROM s WHERE total <= 10000) k USING (locus_id)""")  # fmt: skip
def entity_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.entity_cohort(calls(spark, sf_dir), "locus_id", F.col("p_ok") > 0.2, 10000).select("rk")


@query(f"""{WITH}, c AS (SELECT *, CAST(floor(called / 10) AS BIGINT) AS cell FROM calls), n AS (SELECT cell, count_if(dir_code = 1) AS a, count_if(dir_code = 2) AS b FROM c GROUP BY ALL)
  SELECT c.cell, dir_code, count(*) AS n, round(sum(CASE WHEN a > 0 AND b > 0 AND dir_code = 1 THEN (a + b) / 2 / a WHEN a > 0 AND b > 0 AND dir_code = 2 THEN (a + b) / 2 / b ELSE 1 END), 6) AS weight FROM c JOIN n USING (cell) GROUP BY ALL""")  # fmt: skip
def balancing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sampling.balancing_weights(calls(spark, sf_dir).withColumn("cell", F.floor(F.col("called") / 10)), "cell", "dir_code", 1, 2)
    return rounded(df.groupBy("cell", "dir_code").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")))


@query(f"{WITH}, r AS (SELECT rk, sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY rk) AS k FROM calls) SELECT rk, sample_id FROM r WHERE k % 7 = 0 AND k <= 140")
def strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.strided(calls(spark, sf_dir), 7, ["rk"], ["sample_id"], 20).select("rk", "sample_id")


@query(f"""{WITH}, k AS (SELECT chrom, row_number() OVER (ORDER BY md5(concat_ws('|', '0', chrom)), chrom) - 1 AS place FROM (SELECT DISTINCT chrom FROM calls)),
  e AS (SELECT chrom, CAST(range AS INT) AS fold, place % 5 = range AS test FROM k, range(5)),
  t AS (SELECT *, row_number() OVER (PARTITION BY fold, test ORDER BY md5(concat_ws('|', '0-calib', fold, chrom)), chrom) AS turn FROM e)
  SELECT chrom, fold, CASE WHEN test THEN 'test' WHEN turn <= 4 THEN 'calib' ELSE 'train' END AS role, n FROM t JOIN (SELECT chrom, count(*) AS n FROM calls GROUP BY ALL) USING (chrom)""")  # fmt: skip
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir)
    return splits.with_folds(df.groupBy("chrom").agg(F.count("*").alias("n")), splits.fold_table(df, "chrom", 5, 4), "chrom")


@query(f"""{WITH}, g AS (SELECT person_id, row_number() OVER (ORDER BY md5(concat_ws('|', '0', person_id)), person_id) AS k, count(*) OVER () AS m FROM (SELECT DISTINCT person_id FROM calls))
  SELECT person_id, CAST(k > m // 2 AS INT) AS half, n FROM g JOIN (SELECT person_id, count(*) AS n FROM calls GROUP BY ALL) USING (person_id)""")  # fmt: skip
def cross_fit_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.two_halves(calls(spark, sf_dir).groupBy("person_id").agg(F.count("*").alias("n")), "person_id").select("person_id", "half", "n")


@query(f"""{WITH}, g AS (SELECT DISTINCT 'p' || person_id AS family FROM calls), p AS (SELECT family FROM g ORDER BY md5(concat_ws('|', '0', family)), family LIMIT 5)
  SELECT 'p' || person_id || '_' || (chrom % 3) || 'x' AS source, p.family IS NOT NULL AS held_out, count(*) AS n FROM calls LEFT JOIN p ON p.family = 'p' || person_id GROUP BY ALL""")  # fmt: skip
def held_out_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumn("source", F.concat(F.lit("p"), "person_id", F.lit("_"), F.col("chrom") % 3, F.lit("x")))
    return splits.mark_held_out(df, "source", splits.held_out_groups(df, "source", 5)).groupBy("source", "held_out").agg(F.count("*").alias("n"))


#: CRC-32 of an ASCII string, bit by bit, as DuckDB has no function for it.
_BYTE = "(CASE WHEN i % 8 = 0 THEN ascii(s[(i // 8 + 1)::INT]) ELSE 0 END)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, range(8 * strlen(s))), lambda c, i: xor(xor(c, {_BYTE}) >> 1, CASE WHEN xor(c, {_BYTE}) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT)"


@query(f"""{WITH}, r AS (SELECT locus_id, max(CASE WHEN called < 10 THEN 0.02 WHEN called < 20 THEN 0.05 WHEN called < 30 THEN 0.15 WHEN called < 40 THEN 0.5 ELSE 1.0 END) AS rate, count(*) AS m, 'all-loci|p|' || locus_id AS s FROM calls GROUP BY locus_id)
  SELECT CAST(rate AS DOUBLE) AS keep_probability, CAST(sum(m) AS BIGINT) AS n, count(*) AS entities FROM r WHERE {_CRC} / 4294967296 < rate GROUP BY rate""")  # fmt: skip
def hash_rate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir)
    rate = F.get(F.array(*[F.lit(r) for r in (0.02, 0.05, 0.15, 0.5, 1.0)]), F.least(F.floor(F.col("called") / 10), F.lit(4)).cast("int"))
    return sampling.hash_rate_sample(df, "locus_id", rate, F.lit("all-loci"), F.lit("p")).groupBy("keep_probability").agg(F.count("*").alias("n"), F.count_distinct("locus_id").alias("entities"))


@query(f"""{WITH}, d AS (SELECT person_id, avg(abs(truth - fixed)) - avg(abs(truth - corrected)) AS delta FROM calls GROUP BY ALL), v AS (SELECT delta, row_number() OVER (ORDER BY person_id) - 1 AS at, count(*) OVER () AS n FROM d),
  x AS (SELECT b.range AS rep, k.range AS draw FROM range(200) b, range(1000) k WHERE k.range < (SELECT max(n) FROM v)),
  m AS (SELECT rep, avg(delta) AS mean FROM x JOIN v ON v.at = ('0x' || substr(md5(concat_ws('|', '0', rep, draw)), 1, 8))::BIGINT % n GROUP BY ALL)
  SELECT (SELECT count(*) FROM v) AS n, round((SELECT avg(delta) FROM v), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")  # fmt: skip
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = calls(spark, sf_dir).groupBy("person_id").agg((F.avg(F.abs(F.col("truth") - F.col("fixed"))) - F.avg(F.abs(F.col("truth") - F.col("corrected")))).alias("delta"))
    return rounded(sampling.bootstrap_means(d, "delta", "person_id", 200).select("n", "mean", "low", "high"))


@query(f"""{WITH}, s AS (SELECT regime, sample_id, count(*) AS n, sum(abs(truth - fixed)) AS a, sum(abs(truth - corrected)) AS b FROM calls GROUP BY ALL)
  SELECT regime, count(*) AS n_groups, round(avg(a / n), 6) AS prev_mean, round(avg(b / n), 6) AS new_mean, round(avg(b / n - a / n), 6) AS mean_delta FROM s WHERE sample_id <> 1 GROUP BY ALL""")  # fmt: skip
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, off = calls(spark, sf_dir), lambda c: F.abs(F.col("truth") - F.col(c))
    prev, new = (compare.group_sums(df, ["regime"], "sample_id", off("called"), off(c)) for c in ("fixed", "corrected"))
    return rounded(compare.paired_comparison(prev, new, ["regime"], "sample_id", exclude=[1], replicates=20).select("regime", "n_groups", "prev_mean", "new_mean", "mean_delta"))


# Joins and shapes


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS a, CAST(o_custkey AS VARCHAR) AS b FROM orders), n AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'Z' ELSE a END AS a, CASE WHEN id % 15 = 0 THEN NULL ELSE b END AS b FROM o WHERE id % 7 <> 0)
  SELECT o.id, 'row' AS field, 'present' AS "left", NULL AS "right" FROM o ANTI JOIN n USING (id) UNION ALL SELECT o.id, 'a', o.a, n.a FROM o JOIN n USING (id) WHERE o.a IS DISTINCT FROM n.a UNION ALL SELECT o.id, 'b', o.b, n.b FROM o JOIN n USING (id) WHERE o.b IS DISTINCT FROM n.b""")  # fmt: skip
def row_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("a"), F.col("o_custkey").cast("string").alias("b"))
    n = o.filter("id % 7 <> 0").withColumns({"a": F.when(F.col("id") % 10 == 0, "Z").otherwise(F.col("a")), "b": F.when(F.col("id") % 15 != 0, F.col("b"))})
    return joins.row_differences(o, n, ["id"])


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS v FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey END AS v FROM orders WHERE o_orderkey % 5 <> 0)
  SELECT CASE WHEN n.id IS NULL THEN 'only_current' WHEN o.id IS NULL THEN 'only_old' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'same' ELSE 'changed' END AS "case", count(*) AS n FROM o FULL JOIN n ON o.id = n.id GROUP BY ALL""")  # fmt: skip
def reconciled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("v"))
    found = joins.reconcile(o.filter("id % 3 <> 0"), o.filter("id % 5 <> 0").withColumn("v", F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("v"))), ["id"], "v")
    return found.groupBy("case").agg(F.count("*").alias("n"))


@query(f"""{WITH}, cur AS (SELECT rk, locus_id, row_number() OVER (ORDER BY rk) AS pos FROM calls WHERE motif_size <= 4), oth AS (SELECT rk, locus_id, row_number() OVER (ORDER BY rk) AS pos FROM calls WHERE motif_size > 2),
  ids AS (SELECT DISTINCT locus_id FROM calls WHERE locus_id % 3 = 0), stood AS (SELECT locus_id, min(pos) AS p FROM cur SEMI JOIN ids USING (locus_id) GROUP BY ALL)
  SELECT rk, locus_id, pos, CAST(pos AS DOUBLE) AS at, 0::BIGINT AS after FROM cur ANTI JOIN ids USING (locus_id) UNION ALL SELECT rk, oth.locus_id, pos, coalesce(CAST(p AS DOUBLE), 'inf'::DOUBLE), pos FROM oth SEMI JOIN ids USING (locus_id) LEFT JOIN stood USING (locus_id)""")  # fmt: skip
def replaced_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).select("rk", "locus_id", "motif_size")
    place = lambda d: ordering.ranks(d, [], ["rk"], "pos").withColumn("pos", F.col("pos") + 1).drop("motif_size")
    out = joins.replace_groups(place(df.filter("motif_size <= 4")), place(df.filter("motif_size > 2")), df.filter("locus_id % 3 = 0"), "locus_id")
    return out.select("rk", "locus_id", "pos", F.col("place.at").alias("at"), F.col("place.then").alias("after"))


@query(f"""{WITH} SELECT rk, locus_id, called, coalesce(CASE WHEN p_ok >= 0.5 THEN lcf END, first_value(CASE WHEN p_ok >= 0.5 THEN lcf END IGNORE NULLS) OVER (PARTITION BY locus_id, motif_size ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prediction FROM calls""")
def twin_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = calls(spark, sf_dir).withColumn("prediction", F.when(F.col("p_ok") >= 0.5, F.col("lcf")))
    return joins.fill_from_twin(df, ["locus_id", "motif_size"], "prediction", ["rk"], F.col("called").isNotNull()).select("rk", "locus_id", "called", "prediction")


@query("""SELECT o_orderkey AS id, 0 AS rank, CAST(o_custkey AS DOUBLE) AS value FROM orders UNION ALL SELECT o_orderkey, 1, o_totalprice FROM orders""")
def ranked_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("double").alias("s"), F.col("o_totalprice").alias("l"))
    return joins.ranked_long(o, ["id"], {"value": ("s", "l")})


@query(f"{WITH} SELECT locus_id, min(truth) AS short, max(truth) AS long, min_by(part, rk) AS part FROM calls GROUP BY ALL")
def min_max_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.min_max_wide(calls(spark, sf_dir), ["locus_id"], "truth", "part", "rk")


@query("SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def unique_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.many_to_one_join(c, n, ["c_nationkey"], "left").select("c_custkey", "c_nationkey", "n_name")


@query("WITH a AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 250000) SELECT id, 'left' AS side FROM a ANTI JOIN b USING (id) UNION ALL SELECT id, 'right' FROM b ANTI JOIN a USING (id)")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").filter("c_acctbal > 0"), table(spark, sf_dir, "orders").filter("o_totalprice > 250000")
    return joins.key_difference(a.select(F.col("c_custkey").alias("id")), b.select(F.col("o_custkey").alias("id")), ["id"])


@query(f"""{WITH}, s AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, o_totalprice AS v FROM orders), p AS (SELECT * FROM s WHERE id % 100 = 0)
  SELECT p.id AS probe_id, count(*) AS n, round(CASE WHEN count(*) >= 20 THEN 100 * avg((s.v < p.v)::INT) END, 6) AS percentile FROM p JOIN s ON s.k = p.k AND s.v BETWEEN p.v / 1.25 AND p.v * 1.25 GROUP BY ALL""")  # fmt: skip
def percentile_among_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("k"), F.col("o_totalprice").alias("v"))
    found = ordering.similar_percentiles(s, s.filter("id % 100 = 0"), "id", "k", "v", "v", 1.25)
    return rounded(found.select(F.col("id").alias("probe_id"), "n", "percentile"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey AS k, o_totalprice AS v FROM orders)
  SELECT p.id AS probe_id, count(*) AS n, sum(s.id)::BIGINT AS ids FROM s p JOIN s ON s.k = p.k AND s.v BETWEEN p.v / 1.25 AND p.v * 1.25 GROUP BY ALL""")  # fmt: skip
def similar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    return joins.similar_rows(s, s, "k", "v", 1.25).groupBy("probe_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"""{WITH} SELECT regime, sample_id, n, place FROM (SELECT regime, sample_id, count(*) AS n, row_number() OVER (PARTITION BY regime ORDER BY count(*) DESC, sample_id) AS place FROM calls GROUP BY regime, sample_id) WHERE place <= 5""")
def top_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = calls(spark, sf_dir).groupBy("regime", "sample_id").agg(F.count("*").alias("n"))
    return joins.top_of_each(counts, "regime", "n", 5, "place", "sample_id").select("regime", "sample_id", "n", "place")


@query("SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) + (count(*) OVER (PARTITION BY o_custkey, o_orderstatus) - 1) / 2 AS DOUBLE) AS average_rank FROM orders")
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", joins.average_rank("o_orderstatus", ["o_custkey"]).cast("double").alias("average_rank"))


@query("SELECT o_orderkey, CAST(rank() OVER (ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_orderdate) - 1) / 2 AS DOUBLE) AS average_rank FROM orders")
def average_rank_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks without a partition, which no window holds."""
    return ordering.average_ranks(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [], "o_orderdate").select("o_orderkey", "average_rank")


# Intervals: an event is an interval whose length comes from its value

_SPANS = "SELECT event_id AS id, user_id % 7 AS chrom, CAST(floor(epoch(ts)) AS BIGINT) % 10000000 AS \"start\", CAST(floor(epoch(ts)) AS BIGINT) % 10000000 + 60 + CAST(event_id % 600 AS BIGINT) AS \"end\" FROM events"
_WINDOWS = "SELECT c.range AS chrom, w.range * 5000 AS \"start\", w.range * 5000 + 2500 + c.range * 100 AS \"end\", w.range AS wid FROM range(7) c, range(2000) w"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long") % 10_000_000
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("chrom"), at.alias("start"), (at + 60 + (F.col("event_id") % 600)).alias("end"))


def _windows(spark: SparkSession) -> DataFrame:
    w = spark.range(7).select(F.col("id").alias("chrom")).crossJoin(spark.range(2000).select(F.col("id").alias("wid")))
    return w.select("chrom", (F.col("wid") * 5000).alias("start"), (F.col("wid") * 5000 + 2500 + F.col("chrom") * 100).alias("end"), "wid")


@query(f"""WITH s AS ({_SPANS}), w AS ({_WINDOWS}) SELECT s.id, coalesce(s."end" <= w."end", false) AS inside FROM s LEFT JOIN w ON w.chrom = s.chrom AND w."start" <= s."start" AND s."start" < w."end\"""")
def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.inside_disjoint(_spans(spark, sf_dir), _windows(spark)).select("id", "inside")


@query(f"""WITH s AS ({_SPANS}), w AS ({_WINDOWS}) SELECT w.chrom, w.wid, count(s.id) AS n_overlaps FROM w LEFT JOIN s ON w.chrom = s.chrom AND w."start" - 20 < s."end" AND s."start" < w."end" + 20 GROUP BY ALL""")
def overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark).withColumn("key", F.col("chrom") * 10_000 + F.col("wid"))
    return intervals.count_overlaps(w, _spans(spark, sf_dir).select("chrom", "start", "end"), "key", pad=20).select("chrom", "wid", "n_overlaps")


@query(f"""WITH s AS ({_SPANS}), w AS ({_WINDOWS}), o AS (SELECT s.id, w.wid, row_number() OVER (PARTITION BY s.id ORDER BY (w.wid % 2 = 0) DESC, least(s."end", w."end") - greatest(s."start", w."start") DESC, w.wid) AS k
  FROM s JOIN w ON w.chrom = s.chrom AND w."start" < s."end" AND s."start" < w."end") SELECT id, wid FROM o WHERE k = 1""")  # fmt: skip
def best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.best_overlap(_spans(spark, sf_dir), _windows(spark), "id", F.col("r_wid") % 2 == 0, "wid").select("id", F.col("r_wid").alias("wid"))


@query(f"""WITH s AS ({_SPANS}), n AS (SELECT *, CASE WHEN "start" - lag("end") OVER (PARTITION BY chrom ORDER BY "start", "end", id) < 100 THEN 0 ELSE 1 END AS new FROM s)
  SELECT id, chrom, CAST(sum(new) OVER (PARTITION BY chrom ORDER BY "start", "end", id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM n""")  # fmt: skip
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.islands(_spans(spark, sf_dir), gap=100, key="id").select("id", "chrom", "island")


@query(f"""WITH s AS ({_SPANS}), w AS ({_WINDOWS}) SELECT (SELECT count(*) FROM s JOIN w ON w.chrom = s.chrom AND w."start" <= s."start" AND s."start" < w."end") AS n, (SELECT CAST(sum("end" - "start") AS BIGINT) FROM w) AS width""")
def start_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.start_rate(_spans(spark, sf_dir), _windows(spark)).select("n", "width")


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS key, c_nationkey AS chrom, c_custkey * 100 AS spot, c_custkey % 1200 AS family FROM customer),
  near AS (SELECT key AS a, lag(key) OVER w AS b, spot - lag(spot + 50) OVER w AS d FROM c WINDOW w AS (PARTITION BY chrom ORDER BY spot, key)), f AS (SELECT family, min(key) AS b FROM c GROUP BY family),
  e AS (SELECT a, b FROM near WHERE d < 120 UNION SELECT key, b FROM c JOIN f USING (family)), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r AS (SELECT key AS node, key AS label FROM c UNION SELECT both_ways.b, r.label FROM r JOIN both_ways ON both_ways.a = r.node), g AS (SELECT node, min(label) AS low FROM r GROUP BY node)
  SELECT low AS "group", count(*) AS n FROM g GROUP BY low""")  # fmt: skip
def linked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(key.alias("key"), F.col("c_nationkey").alias("chrom"), (key * 100).alias("start"), (key * 100 + 50).alias("end"), (key % 1200).alias("family"))
    return components.linked_groups(c, intervals.proximity_edges(c, "key", gap=120, same="family"), "key").groupBy("group").agg(F.count("*").alias("n"))


# Parsing, units, hashes, coverage


@query(r"""WITH s AS (SELECT o_orderkey AS id, '(' || (o_orderkey % 50) || ', ' || (o_custkey % 9) || '), (' || (o_custkey % 60) || ', ' || (o_orderkey % 5 + 1) || ')' AS s, o_orderkey % 50 AS v FROM orders),
  p AS (SELECT id, v, CAST(unnest(regexp_extract_all(s, '\((\d+), *(\d+)\)', 1)) AS INT) AS size, CAST(unnest(regexp_extract_all(s, '\((\d+), *(\d+)\)', 2)) AS INT) AS n FROM s)
  SELECT id, CAST(sum(n) AS INT) AS total, CAST(coalesce(sum(n) FILTER (size = v), 0) AS INT) AS at_value, CAST(coalesce(sum(n) FILTER (size > v), 0) AS INT) AS above FROM p GROUP BY ALL""")  # fmt: skip
def counts_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    s = F.concat(F.lit("("), k % 50, F.lit(", "), c % 9, F.lit("), ("), c % 60, F.lit(", "), k % 5 + 1, F.lit(")"))
    a = o.select(k.alias("id"), P.parse_counts(s).alias("counts"), (k % 50).alias("v"))
    return a.select("id", P.counts_total(F.col("counts")).alias("total"), P.counts_at(F.col("counts"), F.col("v")).alias("at_value"), P.counts_above(F.col("counts"), F.col("v")).alias("above"))


@query("""WITH m AS (SELECT p_partkey, translate(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 1 + p_partkey % 6), '0123456789abcdef', 'ACGTACGTACGTACGT') AS motif FROM part),
  r AS (SELECT p_partkey, motif, unnest([motif, reverse(translate(motif, 'ACGTN', 'TGCAN'))]) AS s FROM m), t AS (SELECT p_partkey, motif, substr(s, i::INT) || substr(s, 1, i::INT - 1) AS x FROM r, range(1, 7) g(i) WHERE i <= length(s))
  SELECT p_partkey, motif, min(x) AS family FROM t GROUP BY ALL""")  # fmt: skip
def motif_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    motif = F.translate(F.substring(F.md5(k.cast("string")), F.lit(1), (1 + k % 6).cast("int")), "0123456789abcdef", "ACGTACGTACGTACGT")
    return table(spark, sf_dir, "part").select("p_partkey", motif.alias("motif")).withColumn("family", M.motif_family(F.col("motif")))


@query(f"""{WITH}, f AS (SELECT locus_id, ('0x' || substr(sha256(concat_ws('|', 'label', locus_id)), 1, 8))::BIGINT / 4294967296 AS x FROM (SELECT DISTINCT locus_id FROM calls)) SELECT locus_id, round(x, 6) AS fraction, x < 0.25 AS dropped FROM f""")
def hash_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = E.sha_fraction(F.lit("label"), F.col("locus_id").cast("string"))
    # The first 32 of the 64 bits decide to six decimals.
    high = F.floor(x * 4294967296.0) / 4294967296.0
    return calls(spark, sf_dir).select("locus_id").distinct().select("locus_id", F.round(high, 6).alias("fraction"), (x < 0.25).alias("dropped"))


@query(f"{WITH} SELECT sample_id, sha256(array_to_string(list_sort(list(rk)), chr(10))) AS digest FROM calls GROUP BY ALL")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("sample_id").agg(E.content_digest(F.col("rk")).alias("digest"))


_CARRIES = ", ".join(f"k{k} AS (SELECT *, (s{k} + {f'c{k - 1}' if k else '0'}) % 65536 AS d{k}, (s{k} + {f'c{k - 1}' if k else '0'}) // 65536 AS c{k} FROM {f'k{k - 1}' if k else 's'})" for k in range(16))


@query(f"""{WITH}, s AS (SELECT sample_id, count(*) AS n, {", ".join(f"sum(('0x' || substr(sha256(rk), {61 - 4 * k}, 4))::BIGINT)::BIGINT AS s{k}" for k in range(16))} FROM (SELECT sample_id, rk FROM calls UNION ALL SELECT sample_id, rk FROM calls WHERE motif_size = 1) GROUP BY ALL), {_CARRIES}
  SELECT sample_id, n, {" || ".join(f"lpad(lower(to_hex(d{k})), 4, '0')" for k in reversed(range(16)))} AS digest FROM k15""")  # fmt: skip
def multiset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each sample's rows, some of them twice, from sums that merge."""
    df = calls(spark, sf_dir).select("sample_id", "rk", "motif_size")
    both = df.unionByName(df.filter("motif_size = 1"))
    return both.groupBy("sample_id").agg(F.count("*").alias("n"), E.multiset_digest(F.col("rk")).alias("digest"))


@query(f"""{WITH}, t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 300 < 20 THEN '0-20' WHEN o_orderkey % 300 < 50 THEN '20-50' WHEN o_orderkey % 300 < 100 THEN '50-100' WHEN o_orderkey % 300 < 200 THEN '100-200' ELSE '200+' END AS size_bin, NOT EXISTS (SELECT 1 FROM calls WHERE locus_id = o_orderkey AND motif_size >= 5) AS gone FROM orders)
  SELECT 'all' AS size_bin, count(*) AS total, count_if(gone) AS missing, round(count_if(gone) / count(*), 6) AS gap FROM t UNION ALL SELECT size_bin, count(*), count_if(gone), round(count_if(gone) / count(*), 6) FROM t GROUP BY size_bin""")  # fmt: skip
def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    found = table(spark, sf_dir, "lineitem").filter("l_linenumber >= 5").select(F.col("l_orderkey").alias("id"))
    return rounded(metrics.coverage_gaps(truth, found, "id", E.size_label(F.col("id") % 300, E.TRUTH_SIZE_EDGES, E.TRUTH_SIZE_LABELS)))


#: Scores of the calls by trees with splits at table-wide medians.
ROUTED = f"""{WITH}, m AS (SELECT quantile_disc(called, 0.5) AS c, quantile_disc(size, 0.5) AS s FROM calls), x AS (SELECT rk, regime, called <= c AS low, size <= s AS small, CASE regime WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS k FROM calls, m),
  e AS (SELECT *, exp(CASE WHEN low THEN -0.05 - k / 100 ELSE 0.05 END) AS factor, exp(CASE WHEN small THEN 1.0 ELSE 0.2 END) AS e0, exp(CASE WHEN low THEN -0.5 ELSE 0.4 END) AS e1, exp(CASE WHEN low THEN 0.3 ELSE -0.2 END) AS e2 FROM x),
  p AS (SELECT *, e0 / (e0 + e1 + e2) AS raw0, e1 / (e0 + e1 + e2) AS q1, e2 / (e0 + e1 + e2) AS q2 FROM e), q AS (SELECT *, CASE WHEN regime = 'A' THEN least(greatest((raw0 - 0.1) / 0.7, 0), 1) ELSE raw0 END AS q0 FROM p)"""


@query(f"""{ROUTED}
  SELECT rk, regime, round(factor, 3) AS factor, round(q0 / (q0 + q1 + q2), 3) AS p_0, round(q1 / (q0 + q1 + q2), 3) AS p_1, round(q2 / (q0 + q1 + q2), 3) AS p_2 FROM q""")  # fmt: skip
def routed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees with splits at table-wide medians, kept as a model table, score every call by its regime's expert."""
    df = calls(spark, sf_dir)
    scored = scoring.score(df.select("rk", "regime", "called", "size"), *routed_model(df))
    return scored.select("rk", "regime", "factor", "p_0", "p_1", "p_2")


def routed_model(df: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, list[str]]]:
    """Nodes, knots and features of a small model for three regimes."""
    spark = df.sparkSession
    mid = df.agg(F.percentile_approx("called", 0.5).alias("c"), F.percentile_approx("size", 0.5).alias("s")).first()
    rows = []
    for k, regime in enumerate("ANR"):
        for head, cls, feature, limit, low, high in (("size", 0, 0, mid["c"], -0.05 - k / 100, 0.05), ("direction", 0, 1, mid["s"], 1.0, 0.2), ("direction", 1, 0, mid["c"], -0.5, 0.4), ("direction", 2, 0, mid["c"], 0.3, -0.2)):
            rows.append((regime, head, 0, cls, 0, False, None, feature, float(limit), True, 1, 2))
            rows += [(regime, head, 0, cls, n, True, float(v), None, None, None, None, None) for n, v in ((1, low), (2, high))]
    nodes = spark.createDataFrame(rows, "regime string, head string, iter int, class int, node_id int, is_leaf boolean, value double, feature int, threshold double, missing_left boolean, left int, right int")
    knots = spark.createDataFrame([("A", 0, 0, 0.1, 0.0), ("A", 0, 1, 0.8, 1.0)], "regime string, class int, i int, x double, y double")
    return nodes, knots, {r: ["called", "size"] for r in "ANR"}


# Streams


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    kinds = table(spark, sf_dir, "events").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields)
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if not sf_dir.endswith("events.parquet") else "*").parquet(sf_dir)
    sums = streams.running_summary(s, ["event_type"], F.count("*").alias("n"), F.sum("value").alias("total"))
    return streams.drained(sums, f"summary_{uuid.uuid4().hex}").withColumn("total", F.round("total", 4))
