"""Ordered drops, call categories, re-pairing of ranks, and verdicts from reads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callquality.functions.exprs import corrected, gate_fires, half_even

#: Labels of the call-against-truth categories, the bands of the difference, and the called sizes above
#: which "Same" widens.
CATEGORIES = (
    "No Call", "Called Hom Ref", "Called Het Ref", "Wrong Direction",
    "-21 or more", "-8 to -20", "-5 to -7", "-3 to -4", "-2", "Same",
    "2", "3 to 4", "5 to 7", "8 to 20", "21 or more",
)
BANDS = ((2, "2", "-2"), (4, "3 to 4", "-3 to -4"), (7, "5 to 7", "-5 to -7"), (20, "8 to 20", "-8 to -20"), (None, "21 or more", "-21 or more"))
SAME_WIDENS = ((120, 2), (240, 3), (360, 4))


def first_reason(reasons: dict[str, Column]) -> Column:
    """Name of the first predicate that holds; NULL if none does. NULL predicates don't hold."""
    out = None
    for name, test in reasons.items():
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def drop_ledger(df: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that no predicate drops, and (reason, n) with each row under its first reason, zero counts included."""
    marked = df.withColumn("_reason", first_reason(reasons))
    spark = df.sparkSession
    names = spark.createDataFrame([(k, n) for k, n in enumerate(reasons)], "place int, reason string")
    counts = marked.filter(F.col("_reason").isNotNull()).groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))
    return marked.filter(F.col("_reason").isNull()).drop("_reason"), names.join(counts, "reason", "left").select("place", "reason", F.coalesce("n", F.lit(0)).alias("n"))


def keep_where(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """Rows whose optional boolean column is true; without the column all rows."""
    return df.filter(F.coalesce(F.col(column), F.lit(keep_null))) if column in df.columns else df


def group_filter(df: DataFrame, by: Sequence[str], tests: dict[str, Column], condition: Column) -> DataFrame:
    """Groups whose aggregates pass."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in tests.items()]).filter(condition)


def mixed_groups(df: DataFrame, by: str, value: str, most: int = 5) -> DataFrame:
    """Up to ``most`` groups whose rows don't share one value, as examples for an error."""
    found = df.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(F.col(value).isNull()).alias("nulls"), F.count("*").alias("n"))
    return found.filter("low <> high OR (nulls > 0 AND nulls < n)").orderBy(by).limit(most)


def call_category(difference: Column, called: Column, truth_off: Column, call_off: Column, is_reference: Column, all_reference: Column) -> Column:
    """One of ``CATEGORIES``: the band of call minus truth; over it wrong direction, het and hom reference, no call.

    ``called`` widens "Same"; ``truth_off`` and ``call_off`` are each side's difference from the reference."""
    off = half_even(difference)
    d = F.abs(off)
    same = d <= 1
    for limit, units in SAME_WIDENS:
        same = same | F.coalesce((called > limit) & (d <= units), F.lit(False))
    band = None
    for high, over, under in BANDS:
        label = F.when(off < 0, F.lit(under)).otherwise(F.lit(over))
        band = (F.when if band is None else band.when)(d <= high, label) if high is not None else band.otherwise(label)
    variant = F.coalesce(truth_off != 0, F.lit(True))
    wrong = F.coalesce(F.signum(truth_off) * F.signum(call_off) < 0, F.lit(False))
    return (
        F.when(difference.isNull(), "No Call")
        .when(variant & F.coalesce(all_reference, F.lit(False)), "Called Hom Ref")
        .when(variant & F.coalesce(is_reference, F.lit(False)), "Called Het Ref")
        .when(wrong, "Wrong Direction")
        .when(same, "Same")
        .otherwise(band)
    )


def all_in_group(test: Column, by: Sequence[str]) -> Column:
    return F.bool_and(F.coalesce(test, F.lit(False))).over(W.partitionBy(*by))


def re_paired(df: DataFrame, entity: Sequence[str], value: str, truth: str, order: Sequence[str], along: Sequence[str] = ()) -> DataFrame:
    """Within an entity the k-th smallest value meets the k-th smallest truth, missing values last, ties in row order.

    The value and the columns ``along`` move to the row with that truth; other columns stay."""
    w = W.partitionBy(*entity)
    calls = df.select(*entity, F.row_number().over(w.orderBy(F.col(value).asc_nulls_last(), *order)).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in (value, *along)])
    rows = df.withColumn("_k", F.row_number().over(w.orderBy(F.col(truth).asc_nulls_last(), *order)))
    moved = rows.join(calls, [*entity, "_k"])
    return moved.select(*[F.col(f"_new_{c}").alias(c) if c in (value, *along) else F.col(c) for c in df.columns])


def paired_variants(df: DataFrame, entity: Sequence[str], values: dict[str, Column], truth: str, order: Sequence[str], name: str) -> DataFrame:
    """``re_paired`` for several variants of the value, as rows with ``variant``: within an entity the k-th smallest of a
    variant's values, in ``name``, meets the row with the k-th smallest truth. Entities without a key meet nothing.

    Rows are dealt by entity once, whatever the variants; the rest are sorts within tasks, as each row and each of its
    values take their places, and a place's values read the row there. No join."""
    keyed = reduce(DataFrame.filter, [F.col(c).isNotNull() for c in entity], df)
    known = keyed.withColumn("_order", F.row_number().over(W.partitionBy(*entity).orderBy(*order)))
    none = F.lit(None).cast("double")
    # kind 0 is the row itself with its truth, the others are its values
    events = F.array(*[F.struct(F.lit(k).alias("_kind"), v.alias(name)) for k, v in enumerate((none, *values.values()))])
    flat = known.withColumn("_event", F.explode(events)).select(*df.columns, "_order", "_event.*")
    by = W.partitionBy(*entity, "_kind").orderBy(F.when(F.col("_kind") == 0, F.col(truth)).asc_nulls_last(), F.col(name).asc_nulls_last(), "_order")
    placed = flat.withColumn("_k", F.row_number().over(by))
    place = W.partitionBy(*entity, "_k").orderBy("_kind")
    rows = placed.select(*[F.col(c) if c in entity else F.first(c).over(place).alias(c) for c in df.columns], "_kind", name)
    variant = F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_kind"))
    return rows.filter("_kind > 0").select(*df.columns, variant.alias("variant"), name)


def corrected_categories(df: DataFrame, entity: Sequence[str], order: Sequence[str], called: str, truth: str, reference: str, factor: str, p_ok: str, threshold: float = 0.5) -> DataFrame:
    """Adds ``category``: corrected where the gate fires, re-paired with the truth, classified."""
    value = df.withColumn("_effective", corrected(called, factor, gate_fires(p_ok, factor, threshold)))
    return classified(re_paired(value, entity, "_effective", truth, order), entity, truth, reference)


def classified(paired: DataFrame, entity: Sequence[str], truth: str, reference: str) -> DataFrame:
    """Adds ``category`` to rows whose ``_effective`` call is paired with their truth."""
    off = half_even(F.col("_effective")) - half_even(reference)
    marked = paired.withColumn("_ref", F.coalesce(off == 0, F.lit(False))).withColumn("_all_ref", all_in_group(F.col("_ref"), entity))
    e = F.col("_effective")
    category = call_category(e - F.col(truth), e, half_even(truth) - half_even(reference), half_even(e) - half_even(reference), F.col("_ref"), F.col("_all_ref"))
    return marked.withColumn("category", category).drop("_ref", "_all_ref")


def inferred_sex(df: DataFrame, group: str, partition: str, n_elements: str) -> DataFrame:
    """(group, share, sex): male if over half of a group's entities on X and Y have one element."""
    on = F.col(partition).isin("X", "Y")
    share = F.avg(F.when(on, (F.col(n_elements) == 1).cast("double")))
    return df.groupBy(group).agg(share.alias("share")).withColumn("sex", F.when(F.col("share") > 0.5, "male").otherwise("female"))


def entities_off(df: DataFrame, entity: Sequence[str], code: str = "dir_code") -> DataFrame:
    return df.filter(F.col(code) != 0).select(*entity).distinct()


#: Fixed values of the verdict from reads.
LEAST_MAPQ, LEAST_QUALITY, LEAST_READS = 40, 20, 10
FAR_UNITS, FAR_BASES = 2, 3
LEAST_SHOWING, SHARE_SHOWING, LEAST_ROBUST, LEAST_SPANNING_LONGER = 4, 0.25, 3, 2
MOST_SPANNABLE, LEAST_TO_JUDGE, SHARE_UNSUPPORTED = 90, 8, 0.10
VERDICTS = ("too_few_reads", "contradicted_by_spanning", "contradicted_by_longer", "both_supported", "not_contradicted")


def read_values(reads: DataFrame, unit: str = "unit", length: str = "length", mapq: str = "mapq") -> DataFrame:
    """Confident reads with ``repeats`` and whether the run ends at the read's 3' end.

    A read bound at its left flank runs to its right end, the 3' end on the plus strand; mirrored for the right."""
    three = ((F.col("kind") == "left") & (F.col("strand") == "+")) | ((F.col("kind") == "right") & (F.col("strand") == "-"))
    return reads.filter(F.col(mapq) >= LEAST_MAPQ).withColumn("repeats", F.floor(F.col(length) / F.col(unit))).withColumn("at_3", three)


def truth_verdicts(reads: DataFrame, truth: DataFrame, entity: str = "locus_id") -> DataFrame:
    """(entity, n_reads, cluster, longer, verdict) of every entity of ``truth`` (entity, short, long, unit).

    With fewer than ten confident reads there is no verdict. Contradicted by spanning reads: a cluster within one unit of
    a common length, far from both truths, that is large enough, where the truth can't explain it. Contradicted by
    longer reads: enough reads far above the longer truth, enough of them robust. The truth explains reads if it has two
    values that both have support, as far as spanning reads can show them."""
    far = lambda t: (F.abs(F.col("repeats") - t) >= FAR_UNITS) & (F.abs(F.col("repeats") - t) * F.col("unit") >= FAR_BASES)
    short, long, v = F.col("short"), F.col("long"), F.col("repeats")
    joined = read_values(reads.join(truth.select(entity, "short", "long", "unit"), entity))
    spanning = F.col("kind") == "spanning"
    clean = spanning & ((F.col("quality") >= LEAST_QUALITY) | (F.col("quality") == -1))
    near = lambda t, o: clean & (F.abs(v - t) <= 1) & ((short == long) | (F.abs(v - t) < F.abs(v - o)))
    longer = (v > long) & far(long)
    robust = longer & (F.col("quality") >= LEAST_QUALITY) & (spanning | ~F.col("at_3"))
    lone = clean & far(short) & far(long)
    n = lambda test, name: F.count_if(test).alias(name)
    counts = joined.groupBy(entity).agg(
        F.count("*").alias("n_reads"), n(spanning, "n_spanning"), n(clean, "n_clean"), n(near(short, long), "for_short"), n(near(long, short), "for_long"),
        n(longer, "longer"), n(robust, "robust"), n(longer & spanning, "longer_spanning"), n(robust & (v * F.col("unit") > MOST_SPANNABLE), "robust_long"),
    )
    centers = joined.filter(lone).select(entity, F.explode(F.sequence(v - 1, v + 1)).alias("center"))
    cluster = centers.groupBy(entity, "center").agg(F.count("*").alias("m")).groupBy(entity).agg(F.max("m").alias("cluster"))
    told = truth.select(entity, "short", "long", "unit").join(counts, entity, "left").join(cluster, entity, "left")
    told = told.na.fill(0, ["n_reads", "n_spanning", "n_clean", "for_short", "for_long", "longer", "robust", "longer_spanning", "robust_long", "cluster"])
    judged = F.col("n_clean") >= LEAST_TO_JUDGE
    lacks = lambda t, support: (t * F.col("unit") <= MOST_SPANNABLE) & (F.col(support) <= SHARE_UNSUPPORTED * F.col("n_clean"))
    unsupported = judged & (lacks(short, "for_short") | lacks(long, "for_long"))
    same, beyond = short == long, long * F.col("unit") > MOST_SPANNABLE
    a = (F.col("cluster") >= LEAST_SHOWING) & (F.col("cluster") >= SHARE_SHOWING * F.col("n_spanning")) & (same | unsupported)
    b = (
        (F.col("longer") >= LEAST_SHOWING) & (F.col("longer") >= SHARE_SHOWING * F.col("n_reads")) & (F.col("robust") >= LEAST_ROBUST)
        & ((F.col("robust_long") > 0) | (F.col("longer_spanning") >= LEAST_SPANNING_LONGER)) & (same | beyond | unsupported)
    )
    verdict = F.when(F.col("n_reads") < LEAST_READS, VERDICTS[0]).when(a, VERDICTS[1]).when(b, VERDICTS[2]).when(~same & judged & ~beyond & ~unsupported, VERDICTS[3]).otherwise(VERDICTS[4])
    return told.select(entity, "n_reads", "cluster", "longer", verdict.alias("verdict"))


def eligible_entities(entities: DataFrame, truth: DataFrame, contradicted: DataFrame, entity: str = "locus_id") -> DataFrame:
    """Adds ``equal_ok`` (equal alleles, not contradicted) and ``heir_ok`` (inheritance known, short, not contradicted)."""
    bad = contradicted.select(entity, F.lit(True).alias("_bad")).distinct()
    j = entities.join(truth.select(entity, "short", "long"), entity, "left").join(bad, entity, "left")
    fine = F.col("confident") & F.col("short").isNotNull() & F.col("_bad").isNull()
    heir = F.col("inheritance").isNotNull() & (F.col("long") < F.coalesce("pathogenic_min", F.lit(float("inf"))))
    return j.withColumn("equal_ok", F.coalesce(fine & (F.col("short") == F.col("long")), F.lit(False))).withColumn("heir_ok", F.coalesce(fine & heir, F.lit(False))).drop("_bad")
