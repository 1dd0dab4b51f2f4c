"""Jobs that users call whole: population filters, reference tables, assembly of training rows, full categorisation,
evaluation runs, one-source merges, rankings. Each is a composition of the other operators, one plan from end to end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callquality.functions.exprs import absolute_size, bin_index, col, corrected, difference_bin, direction_code, gate_fires, half_even, numeric, tolerance, unit_category
from callquality.operators.categories import VERDICTS, classified, drop_ledger, entities_off, paired_variants, truth_verdicts
from callquality.operators.compare import feature_changes, group_sums, paired_comparison
from callquality.operators.joins import GuardError, difference_summary, first_per_key, only_keys_of, replace_groups
from callquality.operators.metrics import argmax, gated_errors
from callquality.operators.quantiles import with_quantiles
from callquality.operators.reads import flank_table, measure_reads
from callquality.operators.sampling import cap_per_class, cap_rows
from callquality.operators.scoring import score
from callquality.operators.shared import stored
from callquality.sources.io import marked, require_contract

#: Called sizes that bound the quota cells.
QUOTA_SIZE_EDGES = (0, 20, 40, 60, 100, 150, 300)


def is_variant(reference: Column | str, short: Column | str, long: Column | str) -> Column:
    """Whether a truth differs from the reference in either allele; NULL where a count can't be read as a number."""
    ref, a, b = (numeric(col(c)) for c in (reference, short, long))
    return F.when(ref.isNotNull() & a.isNotNull() & b.isNotNull(), (a != ref) | (b != ref))


def skipped_for_read_length(start: Column | str, end: Column | str, unit: Column | str, read_length: int) -> Column:
    """Whether a caller leaves out an entity for reads of this length: its region is wider than two reads, or its unit is
    longer than half a read."""
    return (col(end) - col(start) > 2 * read_length) | (2 * F.length(col(unit)) > read_length)


def reference_table(truth: DataFrame, ids: DataFrame, key: str, order: Sequence[str], reference: str, short: str, long: str, purity: str) -> DataFrame:
    """(key, reference, is_reference, purity) of the wanted entities, one row each: the first in ``order``."""
    first = first_per_key(only_keys_of(truth, ids, [key]), [key], *order)
    return first.select(key, numeric(col(reference)).alias("reference"), F.coalesce(~is_variant(reference, short, long), F.lit(False)).alias("is_reference"), numeric(col(purity)).alias("purity"))


def quota_cell(unit: Column | str, called: Column | str, by_category: bool = False) -> Column:
    """Cell of a training quota: homopolymer or not (or the unit's category), by the called size in bases."""
    group = unit_category(unit) if by_category else (col(unit) == 1).cast("int")
    return group * (len(QUOTA_SIZE_EDGES) + 1) + bin_index(col(called) * col(unit), QUOTA_SIZE_EDGES, "right")


def assembled(
    df: DataFrame, reasons: dict[str, Column], cap: int, key: Sequence[str], by: Sequence[str], unit: str, called: str, population: Column | None = None, branch: Column | None = None, representative: str | None = None, seed: int | str = 0
) -> tuple[DataFrame, DataFrame]:
    """The training rows of all sources in one plan, and the ledger of dropped rows.

    Rows of the population and the branch, without those that a reason drops; of each ``by`` (source and regime) a
    uniform sample of ``cap`` rows, marked ``representative``, and a top-up of rare quota cells that is not. A NULL
    population or branch keeps nothing of that row. Labels should be columns already, so that reasons can use them.
    """
    for test in (population, branch):
        df = df if test is None else df.filter(F.coalesce(test, F.lit(False)))
    kept, ledger = drop_ledger(df, reasons)
    celled = kept.withColumn("_cell", quota_cell(unit, called))
    return cap_per_class(celled, cap, ["_cell"], key, by, seed, representative).drop("_cell"), ledger


def all_categories(df: DataFrame, variants: dict[str, tuple[Column | None, Column | None]], entity: Sequence[str], order: Sequence[str], called: str, truth: str, reference: str, threshold: float = 0.5) -> DataFrame:
    """Categories of every variant of the correction, as rows with ``variant``: each has its own factor and probability;
    without them the calls stay raw. All variants share the re-pairing, whose rows are shuffled once."""
    none = F.lit(None).cast("double")
    made = lambda factor, p: corrected(called, factor, gate_fires(p, factor, threshold))
    values = {name: made(*(none if c is None else c.cast("double") for c in v)) for name, v in variants.items()}
    return classified(paired_variants(df, entity, values, truth, order, "_effective"), [*entity, "variant"], truth, reference)


def evaluation_run(df: DataFrame, doubles: Sequence[str], sample: str, cap: int | None, key: Sequence[str], by: Sequence[str] = ("regime",), contradicted: str | None = None, seed: int | str = 0, **columns: str) -> DataFrame:
    """Errors by stratum of scored and labelled rows: the contract is checked, each sample is capped by hash, then rows
    whose truth is contradicted go, so that runs with and without them have one sample."""
    require_contract(df.schema, doubles, [sample, *key, *by], "evaluation")
    capped = df if cap is None else cap_rows(df, cap, key, seed, [sample])
    left = capped if contradicted is None else capped.filter(~F.coalesce(F.col(contradicted), F.lit(False)))
    return gated_errors(left, list(by), **columns)


def evaluate_model(
    df: DataFrame, nodes: DataFrame, knots: DataFrame, features: dict[str, list[str]], doubles: Sequence[str], sample: str, key: Sequence[str], unit: str = "unit", called: str = "called", truth: str = "truth", regime: str = "regime",
    cap: int | None = None, contradicted: str | None = None, seed: int | str = 0, gate: float = 0.5, eps: float = 1e-9,
) -> dict[str, DataFrame]:
    """A model held against raw rows, by its own features: ``summary`` (regime, stratum), ``by_sample`` (regime, stratum,
    sample) and ``by_category`` (regime, category of the unit's size, sample).

    The contract and the features are checked; rows whose call or truth is missing go, the others are labelled; each
    sample is capped by hash; then contradicted rows go (a GuardError if the column isn't there), so that runs with and
    without them have one sample; rows are scored by their regime's experts. Corrections are whole sizes, made where the
    gate fires; what they would do elsewhere is counted too (``_from`` the gate on). Units of one base are a stratum of their
    own, ``one``; the others are ``more``. Sums by sample let runs be paired sample by sample."""
    wanted = sorted({f for fs in features.values() for f in fs})
    require_contract(df.schema, doubles, [sample, *key, regime, unit, called, truth, *wanted, *([contradicted] if contradicted else [])], "evaluation")
    c, y = F.col(called), F.col(truth)
    known = df.filter(c.isNotNull() & y.isNotNull() & ~F.isnan(c.cast("double")) & ~F.isnan(y.cast("double")))
    labelled = known.withColumn("_label", direction_code(called, truth, tolerance(absolute_size(unit, truth))))
    capped = labelled if cap is None else cap_rows(labelled, cap, key, seed, [sample])
    left = capped if contradicted is None else capped.filter(~F.coalesce(F.col(contradicted), F.lit(False)))
    slim = left.select(*dict.fromkeys([sample, regime, unit, called, truth, "_label", *wanted]))
    scored = stored(score(slim, nodes, knots, features, regime), "evaluated")
    fires = F.coalesce(F.col("p_0") < gate, F.lit(False))
    made = F.when(F.col("factor") > 0, half_even(c / F.col("factor")))
    raw, own = F.abs(y - c), F.abs(y - F.coalesce(made, c))
    rows = scored.select(
        sample, regime, F.when(F.col(unit) == 1, "one").otherwise("more").alias("stratum"), unit_category(unit).alias("category"), raw.alias("raw"), own.alias("own"), F.when(fires, own).otherwise(raw).alias("gated"), fires.alias("fires"),
        (half_even(c) == half_even(y)).alias("exact_raw"), (half_even(F.when(fires, F.coalesce(made, c)).otherwise(c)) == half_even(y)).alias("exact_gated"),
        (argmax(["p_0", "p_1", "p_2"]) == F.col("_label")).alias("class_right"), (fires == (F.col("_label") != 0)).alias("gate_right"),
    )
    share = lambda name: F.avg(F.col(name).cast("double")).alias(name)
    sides = {"below": F.col("fires"), "from": ~F.col("fires")}
    counts = [F.count_if(test & side).alias(f"{name}_{where}") for where, side in sides.items() for name, test in (("n", F.lit(True)), ("helped", F.col("own") < F.col("raw") - eps), ("hurt", F.col("own") > F.col("raw") + eps))]
    means = rows.groupBy(regime, "stratum").agg(
        F.count("*").alias("n"), F.avg("raw").alias("mae_raw"), F.avg("gated").alias("mae_gated"), (1 - F.try_divide(F.avg("gated"), F.avg("raw"))).alias("dist_reduction"), *[share(x) for x in ("exact_raw", "exact_gated", "class_right", "gate_right")], *counts,
    )
    medians = {"median_raw": "raw", "median_gated": "gated"}
    summary = with_quantiles(means, rows, [regime, "stratum"], medians, [0.5]).withColumns({m: F.get(m, F.lit(0)) for m in medians})
    sums = [F.count("*").alias("n"), F.sum("raw").alias("sum_raw"), F.sum("gated").alias("sum_gated")]
    return {"summary": summary, "by_sample": rows.groupBy(regime, "stratum", sample).agg(*sums), "by_category": rows.groupBy(regime, "category", sample).agg(*sums)}


def merged_source(current: DataFrame, other: DataFrame, changed: DataFrame, entity: str, on: Sequence[str], pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """The current rows with the changed entities' rows from the other run in their places, and (field, compared,
    differing) of the merged rows against the current ones."""
    merged = replace_groups(current, other, changed, entity, pos)
    fields = [c for c in current.columns if c != pos]
    return merged, difference_summary(current.select(*fields), merged.select(*fields), on)


def error_profile(df: DataFrame, by: Sequence[str], called: str, truth: str, probabilities: dict[str, str]) -> DataFrame:
    """(by, bin, class, n, mean, low, middle, high): each class's probability by bin of the signed error, with the
    quartiles. The 27 bins are those of ``difference_bin``."""
    each = F.array(*[F.struct(F.lit(name).alias("class"), F.col(c).cast("double").alias("p")) for name, c in probabilities.items()])
    rows = df.select(*by, difference_bin(col(called) - col(truth)).alias("bin"), F.explode(each).alias("x")).select(*by, "bin", "x.*")
    means = rows.groupBy(*by, "bin", "class").agg(F.count("*").alias("n"), F.avg("p").alias("mean"))
    made = with_quantiles(means, rows, [*by, "bin", "class"], {"_q": "p"}, (0.25, 0.5, 0.75))
    return made.select(*by, "bin", "class", "n", "mean", *[F.get("_q", F.lit(k)).alias(name) for k, name in enumerate(("low", "middle", "high"))])


def paired_by_category(prev: DataFrame, new: DataFrame, group: str, raw: Column, gated: Column, unit: str = "unit", **how) -> DataFrame | None:
    """The paired comparison by category of the unit's size; None where a run lacks the unit."""
    if unit not in prev.columns or unit not in new.columns:
        return None
    sums = [group_sums(df.withColumn("category", unit_category(unit)), ["category"], group, raw, gated) for df in (prev, new)]
    return paired_comparison(*sums, ["category"], group, **how)


def importance_ranking(scores: DataFrame, group: str, feature: str, score: str, reference: str, n: int) -> DataFrame:
    """(group, feature, score, place, reference_place): the first n features of each group, with each one's place in the
    reference group; ties go by name, and a feature that the reference group lacks has none."""
    ranked = scores.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc_nulls_last(score), feature)))
    there = ranked.filter(F.col(group) == reference).select(feature, F.col("place").alias("reference_place"))
    return ranked.filter(F.col("place") <= n).join(there, feature, "left").select(group, feature, score, "place", "reference_place")


def ranking_gap(ranking: DataFrame, contract: DataFrame, name: str, counts: tuple[str, str] | None = None) -> DataFrame:
    """(name, change): features of the contract that a stored ranking lacks (added) and those that it has beyond it
    (dropped); with ``counts``, also features whose row count in the ranking isn't the contract's (counted)."""
    found = feature_changes(ranking, contract, name)
    if counts is None:
        return found
    both = ranking.select(name, F.col(counts[0]).alias("_a")).join(contract.select(name, F.col(counts[1]).alias("_b")), name)
    return found.unionByName(both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(name, F.lit("counted").alias("change")).distinct())


#: Verdict of a locus whose flanks are not unique, so that no read measures it.
NOT_UNIQUE = "flanks_not_unique"


def measured_people(reads: DataFrame, loci: DataFrame, wanted: DataFrame, person: str = "person_id", entity: str = "locus_id") -> tuple[DataFrame, DataFrame]:
    """(measures, unmeasurable): the wanted (person, locus)s measured in that person's reads, and those whose flanks are
    not unique. The person goes into the partition, so that reads meet their own person's loci only."""
    sep = "\t"
    flanked = flank_table(loci.withColumnRenamed(entity, "locus_id"))
    own = wanted.select(person, F.col(entity).alias("locus_id")).distinct().join(flanked, "locus_id")
    inside = lambda df: df.withColumn("chrom", F.concat_ws(sep, F.col(person).cast("string"), "chrom"))
    fine = inside(own.filter("has_unique_flanks")).withColumn("locus_id", F.concat_ws(sep, F.col(person).cast("string"), F.col("locus_id").cast("string")))
    found = measure_reads(inside(reads), fine.select(*loci.withColumnRenamed(entity, "locus_id").columns))
    parts = F.split("locus_id", sep, 2)
    kinds = {person: wanted.schema[person].dataType, entity: wanted.schema[entity].dataType}
    measures = found.select(*[F.get(parts, F.lit(k)).cast(t).alias(c) for k, (c, t) in enumerate(kinds.items())], *[c for c in found.columns if c != "locus_id"])
    return measures, own.filter(~F.coalesce("has_unique_flanks", F.lit(False))).select(person, F.col("locus_id").alias(entity))


def marked_by_reads(
    rows: DataFrame, measures: DataFrame, unmeasurable: DataFrame | None = None, person: str = "person_id", entity: str = "locus_id", source: str | None = None,
    code: str = "dir_code", truth: str = "truth", unit: str = "unit", column: str = "truth_contradicted",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, judgments, ledger) of a mark run over all people and sources in one plan.

    Every (person, locus) with a call off its truth in any source is judged from that person's reads; ``rows`` come back
    with ``column`` set where the truth is contradicted and false elsewhere; the ledger counts judgments by person.
    GuardError if two sources have different truths for one of them. Loci without reads have too few; a truth or unit that
    is NULL throughout gives no contradiction.
    """
    key = [person, entity]
    wanted = only_keys_of(rows, entities_off(rows, key, code), key)
    ends = [F.min(truth).alias("short"), F.max(truth).alias("long"), F.max(unit).alias("unit")]
    if source is not None:
        by_source = wanted.groupBy(*key, source).agg(*ends).groupBy(*key).agg(F.count_distinct(F.struct("short", "long")).alias("_n"))
        if (worst := by_source.filter("_n > 1").first()) is not None:
            raise GuardError(f"sources differ in the truth of {worst[person]} {worst[entity]}")
    both = F.struct(*key).alias("_key")
    truths = wanted.groupBy(*key).agg(*ends).select(both, "short", "long", "unit")
    judged = truth_verdicts(measures.select(both, *[c for c in measures.columns if c not in key]), truths, "_key")
    if unmeasurable is not None:
        judged = marked(judged, unmeasurable.select(both), "_key", "_no").withColumn("verdict", F.when(F.col("_no"), NOT_UNIQUE).otherwise(F.col("verdict"))).drop("_no")
    bad = judged.filter(F.col("verdict").isin(*VERDICTS[1:3])).select("_key")
    out = marked(rows.withColumn("_key", F.struct(*key)), bad, "_key", column).drop("_key")
    judgments = judged.select("_key.*", *[c for c in judged.columns if c != "_key"])
    return out, judgments, judgments.groupBy(person, "verdict").agg(F.count("*").alias("n"))
