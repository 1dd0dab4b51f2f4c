"""Stratified error, calibration and ranking metrics.

Ranking metrics come from one row a distinct score: counts are aggregated first, and running sums go over that table, so
no window holds all rows. Groups may overlap (``strata``): rows are exploded to the names of the strata they are in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callquality.functions.exprs import half_even, ratio
from callquality.operators.joins import GuardError
from callquality.operators.quantiles import with_quantiles
from callquality.operators.shared import stored


def _grouped(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def strata(df: DataFrame, tests: dict[str, Column], name: str = "stratum") -> DataFrame:
    """A row for each stratum that a row is in."""
    return df.withColumn(name, F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))))


def grouping_sets(df: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]], *aggs: Column) -> DataFrame:
    """One aggregation with several groupings; columns outside a row's grouping are NULL."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(*aggs)


def point_metrics(df: DataFrame, by: Sequence[str] = (), called: str = "called", truth: str = "truth", predicted: str = "predicted", t: str = "t", t_predicted: str = "t_predicted", tol: str = "tol") -> DataFrame:
    """n, mean and median absolute errors, distance reduction, exact-match and within-tolerance rates; n = 0 for none."""
    c, y, p = F.col(called), F.col(truth), F.col(predicted)
    off = lambda x: half_even(x) - half_even(y)
    share = lambda test: F.avg(test.cast("double"))
    raw, new = F.avg(F.abs(y - c)), F.avg(F.abs(y - p))
    means = _grouped(
        df, by, F.count("*").alias("n"), F.avg(F.abs(F.col(t) - F.col(t_predicted))).alias("mae_t"), new.alias("mae_true"), raw.alias("mae_raw"),
        F.when(raw > 0, 1 - new / raw).alias("dist_reduction"),
        share(off(p) == 0).alias("exact_match_rate"), share(off(c) == 0).alias("raw_exact_match_rate"),
        share(F.abs(off(p)) <= F.col(tol)).alias("within_tol_rate"), share(F.abs(off(c)) <= F.col(tol)).alias("raw_within_tol_rate"),
    )
    medians = {"median_ae_true": F.abs(y - p), "median_ae_raw": F.abs(y - c)}
    return with_quantiles(means, df, by, medians, [0.5]).withColumns({m: F.get(m, F.lit(0)) for m in medians})


def gated_errors(df: DataFrame, by: Sequence[str] = (), called: str = "called", truth: str = "truth", corrected: str = "corrected", p_ok: str = "p_ok", gate: float = 0.5, eps: float = 1e-9) -> DataFrame:
    """n, mae_raw, mae_gated, and how many corrections helped, hurt, or did neither, where the gate fires."""
    fires = F.coalesce(F.col(p_ok) < gate, F.lit(False))
    raw = F.abs(F.col(truth) - F.col(called))
    new = F.abs(F.col(truth) - F.when(fires, F.col(corrected)).otherwise(F.col(called)))
    return _grouped(
        df, by, F.count("*").alias("n"), F.avg(raw).alias("mae_raw"), F.avg(new).alias("mae_gated"), F.count_if(fires).alias("n_gated"),
        F.count_if(fires & (new < raw - eps)).alias("helped"), F.count_if(fires & (new > raw + eps)).alias("hurt"),
    )


def log_loss(df: DataFrame, label: str, probabilities: Sequence[str], by: Sequence[str] = (), eps: float = 1e-15, weight: str | None = None) -> DataFrame:
    p = F.get(F.array(*[F.col(c) for c in probabilities]), F.col(label))
    loss = -F.ln(F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)))
    return _grouped(df, by, (F.avg(loss) if weight is None else weighted_mean(loss, F.col(weight))).alias("log_loss"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight).cast("double"))


def pinball(value: Column, predicted: Column, q: float = 0.5) -> Column:
    d = value - predicted
    return F.avg(F.greatest(q * d, (q - 1) * d))


def argmax(columns: Sequence[str]) -> Column:
    """Number of the largest value, the lowest of equals."""
    return F.array_position(F.array(*[F.col(c) for c in columns]), F.greatest(*[F.col(c) for c in columns])).cast("int") - 1


def confusion(df: DataFrame, label: str, probabilities: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Dense (label, predicted, n, share of the label's row); a class without rows has share 0."""
    classes = len(probabilities)
    counts = df.groupBy(*by, F.col(label).cast("int").alias("label"), argmax(probabilities).alias("predicted")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(i, j) for i in range(classes) for j in range(classes)], "label int, predicted int")
    dense = df.select(*by).distinct().crossJoin(grid).join(counts, [*by, "label", "predicted"], "left") if by else grid.join(counts, ["label", "predicted"], "left")
    n = F.coalesce("n", F.lit(0))
    whole = F.sum(n).over(W.partitionBy(*by, "label"))
    return dense.select(*by, "label", "predicted", n.alias("n"), F.when(whole > 0, n / whole).otherwise(0.0).alias("share"))


def accuracy(df: DataFrame, label: str, probabilities: Sequence[str], by: Sequence[str] = (), gate: float = 0.5) -> DataFrame:
    """Share of right argmax, and share of right decisions between the first class and the others."""
    first, y = F.col(probabilities[0]), F.col(label)
    return _grouped(df, by, F.avg((argmax(probabilities) == y).cast("double")).alias("accuracy"), F.avg(((first < gate) == (y != 0)).cast("double")).alias("gate_accuracy"))


def calibration_error(df: DataFrame, probability: str, outcome: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins."""
    p, y = F.col(probability), F.col(outcome).cast("double")
    at = F.least(F.greatest(F.floor(p * bins).cast("int"), F.lit(0)), F.lit(bins - 1))
    each = df.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(y).alias("y"))
    return _grouped(each, by, (F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


#: Ranges of the scores between the least and the greatest, for the two-level running sums.
SCORE_RANGES = 4096


def score_table(df: DataFrame, score: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """One row a distinct score: pos, neg, those at a higher score, totals. NULL scores are left out.

    Running sums go over ranges of the score first and then inside each range, so that no task holds all scores of a
    group, unless they all fall into one of ``SCORE_RANGES`` equal ranges."""
    flag = F.coalesce(F.col(positive).cast("boolean"), F.lit(False))
    keys = {f"_k{k}": F.col(c) for k, c in enumerate(by)} or {"_k0": F.lit(0)}
    known = df.filter(F.col(score).isNotNull()).withColumns(keys)
    at = stored(known.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(flag).alias("pos"), F.count_if(~flag).alias("neg")), "scores")
    ends = at.groupBy(*keys).agg(F.min("score").cast("double").alias("_low"), F.max("score").cast("double").alias("_high"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))

    def joined(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        other = right.withColumnsRenamed({k: f"_o{k}" for k in on})
        test = F.lit(True)
        for k in on:
            test = test & F.col(k).eqNullSafe(F.col(f"_o{k}"))
        return left.join(other, test).drop(*[f"_o{k}" for k in on])

    share = F.nanvl(F.coalesce(F.try_divide(F.col("score") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(1.0)), F.lit(1.0))
    ranged = joined(at, ends, *keys).withColumn("_range", F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * SCORE_RANGES)).drop("_low", "_high")
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    before = W.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*keys, "_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_base") for c in ("pos", "neg")])
    above = W.partitionBy(*keys, "_range").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1)
    table = joined(ranged, base, *keys, "_range")
    sides = [(F.col(f"_{c}_base") + F.coalesce(F.sum(c).over(above), F.lit(0))).alias(f"{c}_above") for c in ("pos", "neg")]
    return table.select(*[F.col(f"_k{k}").alias(c) for k, c in enumerate(by)], "score", "pos", "neg", *sides, "n_pos", "n_neg")


def roc_auc(df: DataFrame, score: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties half; NULL with one class."""
    t = score_table(df, score, positive, by)
    wins = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2))
    return _grouped(t, by, F.try_divide(wins, (F.max("n_pos") * F.max("n_neg")).cast("double")).alias("auc"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))


def average_precision(df: DataFrame, score: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum over scores of the gain in recall times the precision; NULL with one class."""
    t = score_table(df, score, positive, by)
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    gain = F.try_divide(F.col("pos").cast("double"), F.col("n_pos").cast("double")) * tp / (tp + fp)
    return _grouped(t, by, F.when((F.max("n_pos") > 0) & (F.max("n_neg") > 0), F.sum(gain)).alias("average_precision"))


def curve_points(df: DataFrame, score: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """Recall, precision, true and false positive rates at each distinct score."""
    t = score_table(df, score, positive, by)
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    return t.select(*by, "score", ratio(tp, F.col("n_pos")).alias("recall"), ratio(tp, tp + fp).alias("precision"), ratio(fp, F.col("n_neg")).alias("false_positive_rate"))


def tie_aware_recall(df: DataFrame, score: str, positive: str, rates: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, rate, recall): share of positives among the highest ``rate`` of scores; scores tied at the cutoff share the
    places left. NULL where no place or no positive is there."""
    t = score_table(df, score, positive, by).withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    n = F.col("pos") + F.col("neg")
    above = F.col("pos_above") + F.col("neg_above")
    places = F.floor(F.col("rate") * (F.col("n_pos") + F.col("n_neg")))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (places - above) / n))
    return t.groupBy(*by, "rate").agg(F.when((F.max(places) > 0) & (F.max("n_pos") > 0), F.sum(weight * F.col("pos")) / F.max("n_pos")).alias("recall"))


def binned_counts(df: DataFrame, by: Sequence[str], bin_col: str, category: str, bins: int, categories: Sequence[str], entity: str | None = None) -> DataFrame:
    """Dense counts of bin by category in each group, with the group's distinct entities."""
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias(bin_col)).crossJoin(spark.createDataFrame([(c,) for c in categories], f"{category} string"))
    counts = df.groupBy(*by, F.col(bin_col).cast("int").alias(bin_col), category).agg(F.count("*").alias("n"))
    groups = df.groupBy(*by).agg(F.count("*").alias("total"), *([F.count_distinct(entity).alias("entities")] if entity else []))
    return groups.crossJoin(grid).join(counts, [*by, bin_col, category], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def distribution(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99), exact: bool = True) -> DataFrame:
    """n, mean, min, max and percentiles; with ``exact=False`` the percentiles are those of a sketch."""
    known = df.filter(F.col(value).isNotNull())
    sums = [F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")]
    if exact:
        return with_quantiles(_grouped(known, by, *sums), known, by, {"percentiles": value}, shares)
    return _grouped(known, by, *sums, F.percentile_approx(value, F.array(*[F.lit(float(s)) for s in shares])).alias("percentiles"))


def nested_thresholds(df: DataFrame, value: str, thresholds: Sequence[float], name: str = "below") -> DataFrame:
    """A row for each threshold that the value is below."""
    return df.withColumn(name, F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col(value) < t)))


def entity_fold(df: DataFrame, entity: Sequence[str], p_ok: str, call_distance: str, truth_distance: str, single: Column) -> DataFrame:
    """Per entity: mean p, largest distances, whether all are single; reference call within 1, missed above 2."""
    each = df.groupBy(*entity).agg(F.avg(p_ok).alias("p_ok"), F.max(call_distance).alias("call_distance"), F.max(truth_distance).alias("truth_distance"), F.bool_and(single).alias("single"))
    kept = each.filter(F.col("p_ok").isNotNull()).withColumn("reference_call", F.coalesce(F.col("call_distance") <= 1, F.lit(False)))
    return kept.withColumn("miss", F.col("reference_call") & F.coalesce(F.col("truth_distance") > 2, F.lit(False)))


def early_warning(entities: DataFrame, group: str, subsets: dict[str, Column], rates: Sequence[float] = (0.01, 0.02, 0.05, 0.10)) -> tuple[DataFrame, DataFrame]:
    """Per group the AUC of low p for misses and the share of p below one half; recall of misses by subset and rate."""
    calls = entities.filter("reference_call").withColumn("suspicion", 1 - F.col("p_ok"))
    shares = entities.groupBy(group).agg(F.avg((F.col("p_ok") < 0.5).cast("double")).alias("share_below_half"))
    return shares.join(roc_auc(calls, "suspicion", "miss", [group]), group, "left"), tie_aware_recall(strata(calls, subsets, "subset"), "suspicion", "miss", rates, ["subset"])


def early_warning_report(entities: DataFrame, group: str, on_sex_chromosome: Column, rates: Sequence[float] = (0.01, 0.02, 0.05, 0.10)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, recall, means) of entities as ``entity_fold`` gives them.

    Groups: sex (male where most entities on sex chromosomes are single; female otherwise and without any), reference calls,
    misses, AUC and share of p below one half. Recall: pooled, by rate, for all, for those off the sex chromosomes, and for
    each sex, subsets that overlap. Means: one row, over groups; those without an AUC (one class) count in the other only.
    """
    told = stored(entities.withColumn("_on_sex", F.coalesce(on_sex_chromosome, F.lit(False))), "early-warning")
    calls = F.col("reference_call").cast("long")
    single = F.avg(F.when(F.col("_on_sex"), F.col("single").cast("double")))
    counted = told.groupBy(group).agg(
        F.when(single > 0.5, "male").otherwise("female").alias("sex"), F.sum(calls).alias("n_reference_calls"), F.sum((F.col("reference_call") & F.col("miss")).cast("long")).alias("n_misses")
    )
    sexes = told.join(counted.select(group, "sex"), group)
    subsets = {"all": F.lit(True), "off_sex_chromosomes": ~F.col("_on_sex"), "female": F.col("sex") == "female", "male": F.col("sex") == "male"}
    groups, recall = early_warning(sexes, group, subsets, rates)
    groups = stored(counted.join(groups.select(group, "auc", "share_below_half"), group), "early-warning")
    return groups, recall, groups.agg(F.count("*").alias("n_groups"), F.count("auc").alias("n_with_auc"), F.avg("auc").alias("auc"), F.avg("share_below_half").alias("share_below_half"))


def coverage_gaps(truth: DataFrame, found: DataFrame, key: str, label: Column) -> DataFrame:
    """(size_bin, total, missing, gap) and the row ``all``: truth keys without a record."""
    marked = truth.withColumn("size_bin", label).join(found.select(key, F.lit(True).alias("_found")).distinct(), key, "left").withColumn("_gone", F.col("_found").isNull().cast("long"))
    every = marked.select(key, "_gone").distinct().agg(F.lit("all").alias("size_bin"), F.count("*").alias("total"), F.sum("_gone").alias("missing"))
    each = marked.groupBy("size_bin").agg(F.count("*").alias("total"), F.sum("_gone").alias("missing"))
    return every.unionByName(each).withColumn("gap", F.coalesce(ratio(F.col("missing"), F.col("total")), F.lit(0.0)))


def require_coverage(gaps: DataFrame, whole: float = 0.02, worst: float = 0.15) -> None:
    bad = gaps.filter(F.col("gap") > F.when(F.col("size_bin") == "all", whole).otherwise(worst)).orderBy(F.col("gap").desc()).limit(1).collect()
    if bad:
        raise GuardError(f"{bad[0]['missing']} of {bad[0]['total']} truth keys of {bad[0]['size_bin']} have no record")


def paired_summary(df: DataFrame, by: Sequence[str], fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(by, field): count, medians and means of both sides, median difference, share equal; fields are exploded once."""
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for n, (a, b) in fields.items()])
    each = df.select(*by, F.explode(rows).alias("r")).select(*by, "r.*").filter("a IS NOT NULL AND b IS NOT NULL")
    means = each.groupBy(*by, "field").agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("share_equal"))
    medians = {"median_a": "a", "median_b": "b", "median_difference": F.col("a") - F.col("b")}
    return with_quantiles(means, each, [*by, "field"], medians, [0.5]).withColumns({m: F.get(m, F.lit(0)) for m in medians})


def percentile_among(pairs: DataFrame, probe: Sequence[str], value: str, own: str, least: int = 20) -> DataFrame:
    """Percentage of similar rows strictly below the probe's value; NULL below ``least`` rows."""
    return pairs.groupBy(*probe).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, 100 * F.avg((F.col(value) < F.col(own)).cast("double"))).alias("percentile"))


def score_summary(df: DataFrame, by: Sequence[str], score: str, called: str, truth: str) -> DataFrame:
    """n, median score, share of scores from one half on, share called too small, mean of truth over call."""
    means = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(score) >= 0.5).cast("double")).alias("share_half"), F.avg((F.col(called) < F.col(truth)).cast("double")).alias("share_under"), F.avg(F.try_divide(F.col(truth).cast("double"), F.col(called).cast("double"))).alias("mean_ratio"))
    return with_quantiles(means, df, by, {"median_score": score}, [0.5]).withColumn("median_score", F.get("median_score", F.lit(0)))


def rate_table(df: DataFrame, by: Sequence[str], events: str, exposure: str, required: DataFrame | None = None) -> DataFrame:
    """Events over exposure of each bin; GuardError if a required bin is missing."""
    rates = df.groupBy(*by).agg(F.sum(events).alias("events"), F.sum(exposure).alias("exposure")).withColumn("rate", ratio(F.col("events"), F.col("exposure")))
    if required is not None:
        missing = required.select(*by).join(rates.filter("exposure > 0"), list(by), "left_anti").limit(1).collect()
        if missing:
            raise GuardError(f"no events for {missing[0].asDict()}")
    return rates


def origin_log_slope(df: DataFrame, x: str, rate: str, weight: str) -> DataFrame:
    """exp of the weighted slope through the origin of ln(rate) on x; 1 with nothing to fit."""
    good = df.filter((F.col(rate) > 0) & F.col(x).isNotNull() & (F.col(weight) > 0))
    w, a, y = F.col(weight), F.col(x), F.ln(rate)
    return good.agg(F.coalesce(F.exp(F.try_divide(F.sum(w * a * y), F.sum(w * a * a))), F.lit(1.0)).alias("base"))


def corrected_rates(used: DataFrame, real: DataFrame, simulated: DataFrame, by: Sequence[str], rate: str = "rate") -> DataFrame:
    """used * real / simulated, and the used rate where nothing was simulated or the real side has no row."""
    j = used.join(real.select(*by, F.col(rate).alias("_r")), list(by), "left").join(simulated.select(*by, F.col(rate).alias("_s")), list(by), "left")
    return j.withColumn(rate, F.when((F.col("_s") > 0) & F.col("_r").isNotNull(), F.col(rate) * F.col("_r") / F.col("_s")).otherwise(F.col(rate))).drop("_r", "_s")


def low_share_by_place(df: DataFrame, values: str, low: float, width: int, last: int) -> DataFrame:
    """Share of low values of each bin of places in arrays."""
    each = df.select(F.posexplode(values).alias("at", "v"))
    return each.groupBy((F.least(F.floor(F.col("at") / width), F.lit(last)) * width).alias("place")).agg(F.count("*").alias("n"), F.avg((F.col("v") < low).cast("double")).alias("share"))


def class_prior(df: DataFrame, label: str, classes: int) -> DataFrame:
    grid = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(label))
    counts = df.groupBy(F.col(label).cast("int").alias(label)).agg(F.count("*").alias("n"))
    dense = grid.join(counts, label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return dense.withColumn("prior", ratio(F.col("n"), F.sum("n").over(W.partitionBy(F.lit(0)))))
