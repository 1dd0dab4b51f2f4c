"""Group-aware, leak-free splits: folds by partition key, held-out groups, cross-fit halves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callquality.functions.exprs import family_of, is_derived, order_hash
from callquality.operators.joins import GuardError


def fold_table(keys: DataFrame, key: str, n_folds: int, n_calib: int, seed: int | str = 0) -> DataFrame:
    """(key, fold, role): each key tests in one fold; of the others of a fold ``n_calib`` calibrate and the rest train.

    Keys are few (a partition key), so they are ranked in one window."""
    place = F.row_number().over(W.orderBy(order_hash(seed, key), key)) - 1
    ranked = keys.select(key).distinct().withColumn("_place", place)
    each = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).withColumn("_test", F.col("_place") % n_folds == F.col("fold"))
    turn = F.row_number().over(W.partitionBy("fold", "_test").orderBy(order_hash(f"{seed}-calib", "fold", key), key))
    role = F.when(F.col("_test"), "test").when(turn <= n_calib, "calib").otherwise("train")
    return each.withColumn("role", role).select(key, "fold", "role")


def with_folds(df: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """Rows by fold and role. The fold table has a few rows a key; Spark broadcasts it below its own limit."""
    return df.join(folds, key)


def held_out_groups(df: DataFrame, group: str, n: int, seed: int | str = 0, always_train: Sequence[str] = ()) -> DataFrame:
    """The ``n`` groups first in hash order; derived groups follow their family and are never picked themselves."""
    family = family_of(group)
    picked = df.filter(~is_derived(group)).select(family.alias("family")).distinct().filter(~F.col("family").isin(*always_train) if always_train else F.lit(True))
    return picked.orderBy(order_hash(seed, "family"), "family").limit(n)


def mark_held_out(df: DataFrame, group: str, picked: DataFrame, partition: str | None = None, always_train: Sequence[str] = (), partitions: Sequence[str] = ()) -> DataFrame:
    """Adds ``held_out``: rows of picked families; of always-train families the given partitions only."""
    marked = df.withColumn("_family", family_of(group)).join(picked.select(F.col("family").alias("_family"), F.lit(True).alias("_picked")), "_family", "left")
    out = F.coalesce("_picked", F.lit(False))
    if always_train and partition:
        out = out | (F.col("_family").isin(*always_train) & F.col(partition).isin(*partitions))
    return marked.withColumn("held_out", out).drop("_picked", "_family")


def refuse_derived(df: DataFrame, group: str, picked: DataFrame) -> None:
    """GuardError if a held-out family has derived rows."""
    bad = df.filter(is_derived(group)).select(family_of(group).alias("family")).join(picked, "family", "left_semi").limit(1).collect()
    if bad:
        raise GuardError(f"held-out group {bad[0]['family']} has derived rows")


def fold_group(group: Column | str, partition: Column | str, always_train: Sequence[str]) -> Column:
    """The group, or group|partition for those that are always trained on."""
    g, p = (F.col(x) if isinstance(x, str) else x for x in (group, partition))
    return F.when(g.isin(*always_train), F.concat_ws("|", g, p)).otherwise(g) if always_train else g


def two_halves(df: DataFrame, group: str, seed: int | str = 0) -> DataFrame:
    """Adds ``half`` 0 or 1: the first half of the groups in hash order, and the rest."""
    groups = df.select(group).distinct()
    rank = F.row_number().over(W.orderBy(order_hash(seed, group), group))
    halves = groups.withColumn("half", (rank > F.floor(F.count("*").over(W.partitionBy(F.lit(0))) / 2)).cast("int"))
    return df.join(halves, group)


def evaluation_cells(df: DataFrame, held_out: Column, unseen: Column) -> DataFrame:
    """Adds ``cell``: train, new_groups, new_entities or both_new."""
    cell = F.when(held_out & unseen, "both_new").when(held_out, "new_groups").when(unseen, "new_entities").otherwise("train")
    return df.withColumn("cell", cell)


def require_disjoint(train: DataFrame, evaluation: DataFrame, group: str) -> None:
    bad = evaluation.select(group).distinct().join(train.select(group).distinct(), group, "left_semi").limit(1).collect()
    if bad:
        raise GuardError(f"{group} {bad[0][0]} is in both")
