"""Reproducible samples: hash order instead of random draws, quotas by water-filling, whole-entity cohorts, weights.

A sample is a function of the seed and of each row's own key, so it is the same under any partitioning. Global ranks are
found from counts per hash bucket, so that no window holds the whole table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callquality.functions.exprs import hash_fraction, order_hash

#: Hex digits of a hash that make a bucket of the two-level prefix sums.
BUCKET_DIGITS = 3


def _prefix_sum(df: DataFrame, by: Sequence[str], order: str, value: Column, name: str) -> DataFrame:
    """Adds the running sum of ``value`` in order of a hex hash: sums of buckets first, then inside each bucket."""
    keyed = df.withColumn("_b", F.substring(order, 1, BUCKET_DIGITS)).withColumn("_v", value)
    sums = keyed.groupBy(*by, "_b").agg(F.sum("_v").alias("_s"))
    ahead = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_s").over(ahead), F.lit(0))).drop("_s")
    inside = W.partitionBy(*by, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return keyed.withColumn("_in", F.sum("_v").over(inside)).join(base, [*by, "_b"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_b", "_v", "_in", "_base")


def hash_ranked(df: DataFrame, key: Sequence[str], seed: int | str | Column, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Adds the row's place, from 1, in hash order within ``by``. Keys should be unique."""
    hashed = df.withColumn("_h", order_hash(seed, *key))
    return _prefix_sum(hashed, by, "_h", F.lit(1), name).drop("_h")


def cap_rows(df: DataFrame, cap: int, key: Sequence[str], seed: int | str = 0, by: Sequence[str] = ()) -> DataFrame:
    """At most ``cap`` rows (of each ``by``), without replacement, those first in hash order."""
    return hash_ranked(df, key, seed, by, "_rank").filter(F.col("_rank") <= cap).drop("_rank")


def quota_level(counts: DataFrame, cap: int, by: Sequence[str] = (), n: str = "n") -> DataFrame:
    """(by, level): the largest level with sum(min(n, level)) <= cap; the largest count where all fit.

    ``counts`` has one row a cell; ascending running sums of that small table give the level.
    """
    order = W.partitionBy(*by).orderBy(n).rowsBetween(W.unboundedPreceding, -1) if by else W.orderBy(n).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    done, smaller = F.coalesce(F.sum(n).over(order), F.lit(0)), F.count("*").over(order)
    cells = F.count("*").over(whole)
    told = counts.withColumn("_done", done).withColumn("_left", cells - smaller).withColumn("_max", F.max(n).over(whole)).withColumn("_all", F.sum(n).over(whole))
    binds = (F.col("_all") > cap) & (F.col(n) * F.col("_left") + F.col("_done") > cap)
    level = F.floor((F.lit(cap) - F.col("_done")) / F.col("_left"))
    agg = told.groupBy(*by) if by else told
    return agg.agg(F.coalesce(F.min_by(F.when(binds, level), F.when(binds, F.struct(F.col(n), F.col("_done")))), F.max("_max")).cast("long").alias("level"))


def quota_sample(df: DataFrame, cells: Sequence[str], cap: int, key: Sequence[str], seed: int | str = 0, by: Sequence[str] = ()) -> DataFrame:
    """At most ``cap`` rows of each ``by``, as even over the cells as they allow: small cells whole, others to the level."""
    groups = [*by, *cells]
    level = quota_level(df.groupBy(*groups).agg(F.count("*").alias("n")), cap, by)
    ranked = hash_ranked(df, key, seed, groups, "_rank")
    joined = ranked.join(level, list(by)) if by else ranked.crossJoin(level)
    return joined.filter(F.col("_rank") <= F.col("level")).drop("_rank", "level")


def quota_top_up(df: DataFrame, chosen: str, cells: Sequence[str], cap: int, key: Sequence[str], seed: int | str = 0, by: Sequence[str] = ()) -> DataFrame:
    """Rows to add to those marked ``chosen``: only in cells that hold fewer chosen rows than their quota."""
    groups = [*by, *cells]
    counts = df.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(F.col(chosen)).alias("have"))
    level = quota_level(counts, cap, by)
    need = (counts.join(level, list(by)) if by else counts.crossJoin(level)).select(*groups, (F.least("n", "level") - F.col("have")).alias("need")).filter("need > 0")
    return hash_ranked(df.filter(~F.col(chosen)), key, seed, groups, "_rank").join(need, groups).filter("_rank <= need").drop("_rank", "need")


def cap_per_class(df: DataFrame, cap: int, cells: Sequence[str], key: Sequence[str], by: Sequence[str] = ("source", "regime"), seed: int | str = 0, representative: str | None = None) -> DataFrame:
    """Uniform sample of each class, marked representative, and a quota top-up, not marked; small pools stay whole.

    With a given ``representative`` column the uniform sample is drawn from the rows it marks."""
    pool = df if representative is None else df.filter(F.col(representative))
    ranked = hash_ranked(pool, key, seed, by, "_rank")
    marked = ranked.withColumn("representative", F.col("_rank") <= cap).drop("_rank")
    extra = quota_top_up(marked, "representative", cells, cap, key, f"{seed}-top-up", by)
    return marked.filter("representative").unionByName(extra)


def entity_cohort(df: DataFrame, entity: str, scored: Column, cap: int, seed: int | str = 0) -> DataFrame:
    """All rows of entities taken in hash order while the running number of scored rows stays within the cap."""
    sizes = df.groupBy(entity).agg(F.count_if(scored).alias("_n")).withColumn("_h", order_hash(seed, entity))
    kept = _prefix_sum(sizes, (), "_h", F.col("_n"), "_sum").filter(F.col("_sum") <= cap).select(entity)
    return df.join(kept, entity, "left_semi")


def keep_rates(df: DataFrame, entity: str, rate: Column) -> DataFrame:
    """(entity, rate): the largest rate of an entity's elements, zero without any."""
    return df.groupBy(entity).agg(F.coalesce(F.max(rate), F.lit(0.0)).alias("rate"))


def hash_rate_sample(df: DataFrame, entity: str, rate: Column, *salt: Column | str) -> DataFrame:
    """Rows of the entities whose hash fraction is below their keep rate."""
    kept = keep_rates(df, entity, rate).filter(hash_fraction(*salt, F.col(entity).cast("string")) < F.col("rate"))
    return df.join(kept.select(entity, F.col("rate").alias("keep_probability")), entity)


def with_population(df: DataFrame, entity: str, variant: Column, reference: str, truth: str, rate: Column, *salt: Column | str) -> DataFrame:
    """Variant entities and hash-sampled reference-equal ones: adds variant, keep_probability, in_pool, representative;
    reference-equal rows get the reference as their truth."""
    marked = df.withColumn("variant", variant)
    rates = keep_rates(marked, entity, rate).withColumn("_f", hash_fraction(*salt, F.col(entity).cast("string")))
    joined = marked.join(rates, entity)
    keep = F.col("variant") | (F.col("_f") < F.col("rate"))
    return joined.filter(keep).select(
        *[c for c in df.columns if c != truth], F.when(F.col("variant"), F.col(truth)).otherwise(F.col(reference)).alias(truth), "variant",
        F.when(F.col("variant"), F.lit(1.0)).otherwise(F.col("rate")).alias("keep_probability"), (F.col("_f") < F.col("rate")).alias("in_pool"),
        (F.col("_f") < F.col("rate")).alias("representative"),
    )


def strided(df: DataFrame, step: int, key: Sequence[str], by: Sequence[str], most: int = 6000) -> DataFrame:
    """Every ``step``-th row of each group in order of the key, at most ``most``."""
    order = W.partitionBy(*by).orderBy(*key)
    return df.withColumn("_rn", F.row_number().over(order)).filter((F.col("_rn") % step == 0) & (F.col("_rn") <= most * step)).drop("_rn")


def two_pool_sample(df: DataFrame, flag: Column, cells: Sequence[str], caps: tuple[int, int], key: Sequence[str], seed: int | str = 0) -> DataFrame:
    """A quota sample of the rows with the flag and one of those without, each with its own cap."""
    yes = F.coalesce(flag, F.lit(False))
    return quota_sample(df.filter(yes), cells, caps[0], key, seed).unionByName(quota_sample(df.filter(~yes), cells, caps[1], key, seed))


def balancing_weights(df: DataFrame, cell: str, label: str, first: object, second: object, out: str = "weight") -> DataFrame:
    """Within a cell, rows of the two classes share their total weight equally; others, and cells with one class, weigh 1."""
    counts = df.groupBy(cell).agg(F.count_if(F.col(label) == first).alias("_a"), F.count_if(F.col(label) == second).alias("_b"))
    both = (F.col("_a") > 0) & (F.col("_b") > 0)
    half = (F.col("_a") + F.col("_b")) / 2
    weight = F.when(both & (F.col(label) == first), half / F.col("_a")).when(both & (F.col(label) == second), half / F.col("_b")).otherwise(1.0)
    return df.join(counts, cell, "left").withColumn(out, weight).drop("_a", "_b")


def inverse_rate_weights(sample: DataFrame, pool: DataFrame, cells: Sequence[str], out: str = "weight") -> DataFrame:
    """Rows of the sample weigh the pool's rows per sampled row of their cell."""
    n = lambda df, name: df.groupBy(*cells).agg(F.count("*").alias(name))
    rates = n(pool, "_p").join(n(sample, "_s"), list(cells)).select(*cells, (F.col("_p") / F.col("_s")).alias(out))
    return sample.join(rates, list(cells), "left")


def bootstrap_means(df: DataFrame, value: str, order: str, replicates: int = 2000, seed: int | str = 0, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, low, high): the mean of group values and the 2.5 and 97.5 percentiles of resampled means.

    Values are few (one a group that was measured); draws are hashes of replicate and place, so reruns agree."""
    places = W.partitionBy(*by).orderBy(order) if by else W.orderBy(order)
    values = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), (F.row_number().over(places) - 1).alias("_at"))
    sizes = values.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean")) if by else values.agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    drawn = sizes.filter("n > 0").select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_rep"))
    drawn = drawn.select(*by, "n", "_rep", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("_draw"))
    picked = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "_rep", "_draw")), 1, 8), 16, 10).cast("long") % F.col("n")
    means = drawn.withColumn("_at", picked.cast("int")).join(values, [*by, "_at"]).groupBy(*by, "_rep").agg(F.avg("_v").alias("_m"))
    ends = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))
    spread = (means.groupBy(*by) if by else means).agg(F.get(ends, F.lit(0)).alias("low"), F.get(ends, F.lit(1)).alias("high"))
    return sizes.join(spread, list(by), "left") if by else sizes.crossJoin(spread)


def copies_and_controls(df: DataFrame, target: float, coverage: str) -> DataFrame:
    """Two rows a row, copy and control, each with the fraction that brings its coverage to the target."""
    fraction = F.least(F.lit(1.0), F.try_divide(F.lit(float(target)), F.col(coverage).cast("double")))
    return df.withColumn("fraction", fraction).withColumn("role", F.explode(F.array(F.lit("copy"), F.lit("control"))))
