"""Checked joins, reconciliation of two tables, and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class GuardError(ValueError):
    """A table does not keep a promise that an operator needs."""


def require_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """The table, or GuardError naming a key that occurs more than once. One aggregation, stopped at the first find."""
    bad = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if bad:
        raise GuardError(f"{name}: {', '.join(f'{k}={bad[0][k]}' for k in keys)} occurs {bad[0]['count']} times")
    return df


def unique_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join with both sides unique on the keys."""
    return require_unique(left, keys, "left").join(require_unique(right, keys, "right"), list(keys), "left")


def many_to_one_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return left.join(require_unique(right, keys, "right"), list(keys), how)


def complete_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one left join; GuardError if a left row has no partner."""
    marked = unique_left_join(left, right.withColumn("_here", F.lit(True)), keys)
    missing = marked.filter(F.col("_here").isNull()).select(*keys).limit(1).collect()
    if missing:
        raise GuardError(f"no partner for {missing[0].asDict()}")
    return marked.drop("_here")


def only_keys_of(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def without_keys_of(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def key_difference(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys of one side only, with ``side``; empty if the key sets are equal."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    return a.join(b, list(on), "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, list(on), "left_anti").withColumn("side", F.lit("right")))


def exactly_one(df: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """The row of each wanted key; GuardError unless there is exactly one for each."""
    counted = wanted.select(*on).distinct().join(df.groupBy(*on).agg(F.count("*").alias("_n")), list(on), "left")
    bad = counted.filter(F.coalesce("_n", F.lit(0)) != 1).limit(1).collect()
    if bad:
        raise GuardError(f"{bad[0].asDict()} instead of one row")
    return only_keys_of(df, wanted, on)


def consistent_union(tables: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """One row a key from tables with the same columns; GuardError if tables disagree about a key."""
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t)
    rest = [c for c in union.columns if c not in on]
    grouped = union.groupBy(*on).agg(F.min(F.struct(*rest)).alias("_low"), F.max(F.struct(*rest)).alias("_high"))
    bad = grouped.filter(~F.col("_low").eqNullSafe(F.col("_high"))).limit(1).collect()
    if bad:
        raise GuardError(f"sources disagree at {[bad[0][k] for k in on]}")
    return grouped.select(*on, *[F.col("_low")[c].alias(c) for c in rest])


def reconcile(current: DataFrame, old: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Full outer comparison by key: both values and the case (same, changed, only_current, only_old)."""
    a = current.select(*on, F.col(value).alias("current"), F.lit(True).alias("_a"))
    b = old.select(*on, F.col(value).alias("old"), F.lit(True).alias("_b"))
    case = F.when(F.col("_b").isNull(), "only_current").when(F.col("_a").isNull(), "only_old").when(F.col("current").eqNullSafe(F.col("old")), "same").otherwise("changed")
    return a.join(b, list(on), "full_outer").select(*on, "current", "old", case.alias("case"))


def row_differences(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """(key, field, left, right) of every shared column that differs, nulls equal; ``row`` where one side is missing."""
    fields = [c for c in left.columns if c in right.columns and c not in on]
    a = left.select(*on, F.struct(*[F.col(c).cast("string").alias(c) for c in fields]).alias("_a"))
    b = right.select(*on, F.struct(*[F.col(c).cast("string").alias(c) for c in fields]).alias("_b"))
    entry = lambda name, x, y: F.struct(F.lit(name).alias("field"), x.alias("left"), y.alias("right"))
    whole = F.array(entry("row", F.when(F.col("_a").isNotNull(), F.lit("present")), F.when(F.col("_b").isNotNull(), F.lit("present"))))
    each = F.filter(F.array(*[entry(c, F.col("_a")[c], F.col("_b")[c]) for c in fields]), lambda e: ~e["left"].eqNullSafe(e["right"]))
    found = F.when(F.col("_a").isNull() | F.col("_b").isNull(), whole).otherwise(each)
    return a.join(b, list(on), "full_outer").select(*on, F.explode(found).alias("d")).select(*on, "d.*")


def parity(left: DataFrame, right: DataFrame, on: Sequence[str], group: str, entity: str | None = None, chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(differences, groups) of two extractions that should agree, at the ``chosen`` entities where given.

    Differences are ``row_differences`` by group and key; a column of one side is NULL on the other, NULL and NaN are equal,
    and the right side's values take the left side's types. Groups: every group of either side, with its rows on both,
    the rows that differ, and ``failed`` where any does. A NULL in the group or key matches none, so such a row differs.
    """
    if chosen is not None:
        left, right = (side.join(chosen.select(entity).distinct(), entity, "left_semi") for side in (left, right))
    keys = [group, *[c for c in on if c != group]]
    kinds = {f.name: f.dataType for f in (*right.schema.fields, *left.schema.fields)}
    names = [c for c in kinds if c not in keys]
    plain = lambda c, t: F.nullif(c, F.lit(float("nan")).cast(t)) if t.typeName() in ("double", "float") else c
    sides = [side.select(*[F.col(c).cast(kinds[c]).alias(c) for c in keys], *[(plain(F.col(c).cast(kinds[c]), kinds[c]) if c in side.columns else F.lit(None).cast(kinds[c])).alias(c) for c in names]) for side in (left, right)]
    found = row_differences(*sides, keys)
    rows = sides[0].groupBy(group).agg(F.count("*").alias("n_left"), F.lit(0).cast("long").alias("n_right"), F.lit(0).cast("long").alias("n_differing"))
    rows = rows.unionByName(sides[1].groupBy(group).agg(F.lit(0).cast("long").alias("n_left"), F.count("*").alias("n_right"), F.lit(0).cast("long").alias("n_differing")))
    off = found.select(*keys).distinct().groupBy(group).agg(F.lit(0).cast("long").alias("n_left"), F.lit(0).cast("long").alias("n_right"), F.count("*").alias("n_differing"))
    each = rows.unionByName(off).groupBy(group).agg(*[F.sum(c).alias(c) for c in ("n_left", "n_right", "n_differing")])
    return found, each.withColumn("failed", F.col("n_differing") > 0)


def difference_summary(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """(field, compared, differing) of keys on both sides, in one pass; field ``any`` counts rows."""
    fields = [c for c in left.columns if c in right.columns and c not in on]
    both = left.select(*on, *[F.col(c).alias(f"a_{c}") for c in fields]).join(right.select(*on, *[F.col(c).alias(f"b_{c}") for c in fields]), list(on))
    off = {c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in fields}
    some = F.lit(False)
    for test in off.values():
        some = some | test
    sums = both.agg(F.count("*").alias("compared"), *[F.count_if(t).alias(c) for c, t in {**off, "any": some}.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), "compared", F.col(c).alias("differing")) for c in (*fields, "any")])).alias("x")).select("x.*")


def fill_from_twin(df: DataFrame, group: Sequence[str], value: str, order: Sequence[Column | str], wanted: Column) -> DataFrame:
    """Missing values of the wanted rows come from the first row of their group that has one."""
    first = F.first(value, ignorenulls=True).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return df.withColumn(value, F.when(F.col(value).isNull() & wanted, first).otherwise(F.col(value)))


def paired_rows(left: DataFrame, right: DataFrame, on: Sequence[str], value: str, eligible: str) -> DataFrame:
    """Rows of two runs by key, where both are eligible: key, left, right."""
    take = lambda df, name: df.filter(F.col(eligible)).select(*on, F.col(value).alias(name))
    return take(left, "left").join(take(right, "right"), list(on))


def similar_rows(df: DataFrame, probes: DataFrame, by: str, size: str, factor: float) -> DataFrame:
    """Rows of the same class whose size is within a factor of the probe's: buckets of log size, three a probe."""
    import math

    width = math.log(factor)
    bucket = lambda c: F.floor(F.ln(c) / width)
    left = probes.filter(F.col(size) > 0).select(*[F.col(c).alias(f"probe_{c}") for c in probes.columns])
    left = left.withColumn("_bucket", F.explode(F.array(*[bucket(F.col(f"probe_{size}")) + k for k in (-1, 0, 1)])))
    right = df.filter(F.col(size) > 0).withColumn("_bucket", bucket(F.col(size)))
    near = F.col(size).between(F.col(f"probe_{size}") / factor, F.col(f"probe_{size}") * factor)
    return left.join(right, (left["_bucket"] == right["_bucket"]) & (F.col(f"probe_{by}") == F.col(by)) & near).drop("_bucket")


# Reshaping


def ranked_long(df: DataFrame, keys: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Wide (short, long) columns as two rows, ranks 0 and 1: ``pairs`` maps a new column to its two old ones."""
    rows = [F.struct(F.lit(k).alias("rank"), *[F.col(p[k]).alias(name) for name, p in pairs.items()]) for k in (0, 1)]
    return df.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def min_max_wide(df: DataFrame, keys: Sequence[str], value: str, first: str | None = None, order: str | None = None) -> DataFrame:
    """Smallest and largest value of a group, and ``first`` of the row that comes first in ``order``."""
    extra = [F.min_by(first, order).alias(first)] if first and order else []
    return df.groupBy(*keys).agg(F.min(value).alias("short"), F.max(value).alias("long"), *extra)


def aligned_union(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def replace_groups(current: DataFrame, other: DataFrame, keys: DataFrame, on: str, pos: str = "pos") -> DataFrame:
    """Rows of the chosen entities come from ``other`` and stand where the old ones stood; new entities come last, in the
    order of ``other``. ``place`` orders the result."""
    chosen = keys.select(on).distinct()
    stay = current.join(chosen, on, "left_anti").withColumn("place", F.struct(F.col(pos).cast("double").alias("at"), F.lit(0).cast("long").alias("then")))
    stood = current.join(chosen, on, "left_semi").groupBy(on).agg(F.min(pos).alias("_stood"))
    come = other.join(chosen, on, "left_semi").join(stood, on, "left")
    come = come.withColumn("place", F.struct(F.coalesce(F.col("_stood").cast("double"), F.lit(float("inf"))).alias("at"), F.col(pos).cast("long").alias("then"))).drop("_stood")
    return stay.unionByName(come)


def variant_rows(df: DataFrame, name: str, variants: dict[str, Column]) -> DataFrame:
    """One row a variant: a struct of each variant's columns is exploded, so that one aggregation serves all."""
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), c.alias("value")) for v, c in variants.items()])
    return df.withColumn(name, F.explode(rows))


def upsert_groups(existing: DataFrame, new: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows of the groups in ``new`` replace theirs."""
    return existing.join(new.select(*groups).distinct(), list(groups), "left_anti").unionByName(new)


# Order


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the order, which should leave no ties."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def average_rank(value: str, partition: Sequence[str] = ()) -> Column:
    """Rank with ties at their mean."""
    w = W.partitionBy(*partition) if partition else W.partitionBy(F.lit(0))
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*partition, value) if partition else W.partitionBy(value)) - 1) / 2


def natural_order(partition: Column) -> Column:
    """1 to 22 in order of numbers, then X, Y, M, then others."""
    number = partition.try_cast("int")
    return F.coalesce(number, F.when(partition == "X", 23).when(partition == "Y", 24).when(partition == "M", 25), F.lit(99))


def top_of_each(df: DataFrame, group: str, value: str, n: int, name: str = "place", *ties: str) -> DataFrame:
    order = W.partitionBy(group).orderBy(F.col(value).desc(), *ties)
    return df.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= n)


def latest_by_name(df: DataFrame, name: str, pattern: str = r"([0-9]{4}-[0-9]{2}-[0-9]{2})") -> Column:
    """Aggregate: the name with the latest date in it, undated names before all dated ones."""
    return F.max_by(name, F.struct(F.regexp_extract(name, pattern, 1), F.col(name)))
