"""Paired comparison of two runs: the same rows, deltas by group, bootstrap intervals, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callquality.operators.joins import GuardError
from callquality.operators.sampling import bootstrap_means

LEAST_GROUPS = 10


def require_same_rows(a: DataFrame, b: DataFrame, on: Sequence[str], n: str = "n", raw: str = "mae_raw", eps: float = 1e-9) -> None:
    """GuardError unless the strata of both runs have equal counts and equal raw errors."""
    j = a.select(*on, F.col(n).alias("na"), F.col(raw).alias("ra")).join(b.select(*on, F.col(n).alias("nb"), F.col(raw).alias("rb")), list(on), "full_outer")
    bad = j.filter(~F.col("na").eqNullSafe(F.col("nb")) | (F.abs(F.col("ra") - F.col("rb")) > eps)).limit(1).collect()
    if bad:
        raise GuardError(f"the runs did not score the same rows: {bad[0].asDict()}")


def group_sums(df: DataFrame, strata: Sequence[str], group: str, raw: Column, gated: Column) -> DataFrame:
    return df.groupBy(*strata, group).agg(F.count("*").alias("n"), F.sum(raw).alias("sum_raw"), F.sum(gated).alias("sum_gated"))


def winner(n: Column, low: Column, high: Column, least: int = LEAST_GROUPS) -> Column:
    return F.when(n < least, "too few samples").when(high < 0, "new").when(low > 0, "prev").otherwise("tie")


def paired_comparison(prev: DataFrame, new: DataFrame, strata: Sequence[str], group: str, exclude: Sequence[str] = (), replicates: int = 2000, seed: int | str = 0) -> DataFrame:
    """Per stratum of two tables of group sums: mean error over groups of both, mean delta, 95 % interval, winner."""
    mean = lambda df, name: df.filter("n > 0").select(*strata, group, (F.col("sum_gated") / F.col("n")).alias(name))
    pairs = mean(prev, "prev").join(mean(new, "new"), [*strata, group]).withColumn("delta", F.col("new") - F.col("prev"))
    if exclude:
        pairs = pairs.filter(~F.col(group).isin(*exclude))
    means = pairs.groupBy(*strata).agg(F.count("*").alias("n_groups"), F.avg("prev").alias("prev_mean"), F.avg("new").alias("new_mean"), F.avg("delta").alias("mean_delta"))
    spread = bootstrap_means(pairs, "delta", group, replicates, seed, strata).select(*strata, "low", "high")
    return means.join(spread, list(strata), "left").withColumn("winner", winner(F.col("n_groups"), F.col("low"), F.col("high")))


def verdict(rows: DataFrame) -> DataFrame:
    """One row: wins of each kind, judged strata, and whose they are: new, prev, mixed or none."""
    n = lambda w: F.count_if(F.col("winner") == w)
    counts = rows.agg(n("new").alias("new"), n("prev").alias("prev"), n("tie").alias("tie"), n("too few samples").alias("too_few"))
    whose = F.when((F.col("new") > 0) & (F.col("prev") > 0), "mixed").when(F.col("new") > 0, "new").when(F.col("prev") > 0, "prev").otherwise("none")
    return counts.withColumn("judged", F.col("new") + F.col("prev") + F.col("tie")).withColumn("verdict", whose)


def row_sets(df: DataFrame, contradicted: str) -> dict[str, DataFrame]:
    """All rows, and those whose truth isn't contradicted; taken after a cap, so both come from one sample."""
    return {"all": df, "not contradicted": df.filter(~F.coalesce(F.col(contradicted), F.lit(False)))}


def feature_changes(old: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    """(name, change): features added to or dropped from a model's table."""
    a, b = old.select(name).distinct(), new.select(name).distinct()
    return b.join(a, name, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, name, "left_anti").withColumn("change", F.lit("dropped")))


def results_of(results: DataFrame, fingerprint: str, column: str = "model_fingerprint") -> DataFrame:
    """Stored results of one model; those of others are stale."""
    return results.filter(F.col(column) == fingerprint)


def model_fingerprint(table: DataFrame) -> DataFrame:
    """One digest of a model's table: digests of 256 buckets of sorted row digests, so no group grows without bound."""
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    bucket = table.select(row.alias("r")).groupBy(F.substring("r", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("r")), ""), 256).alias("d"))
    return bucket.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("fingerprint"))
