"""Counts along an order, for groups of any size: ranks, rows within a range of sizes, and rows below in two dimensions.

Tasks sort ranges of (group, order), whatever a group holds, count as they go, and add what earlier tasks of the same
group have counted. No window holds a group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callquality.functions.exprs import col
from callquality.operators.quantiles import null_safe_join
from callquality.operators.shared import counted_broadcast, stored

#: Digits of ranks in ``counts_below``; more digits, fewer levels.
FAN = 64


def counted_before(events: DataFrame, group: Sequence[str], order: Sequence[str | Column], point: Column, name: str, digit: Column | None = None, asked: Column | None = None, fan: int = 1) -> DataFrame:
    """Adds ``name``: how many points (rows where ``point`` is true) stand before a row in its group by ``order``, of those
    whose ``digit`` (0 to fan - 1; without it 0) is less than what the row has ``asked`` (0 to fan; without it fan).

    Rows that are equal in ``order`` stand in some order; a column of it should put what must come first first. NULL keys
    are groups; NULLs come first. Group columns may be of any type that has an order."""
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group_key = F.xxhash64(*group) if group else F.lit(0).cast("long")
    digit, asked = F.lit(0) if digit is None else digit, F.lit(fan) if asked is None else asked
    work = {"_group": group_key, "_digit": digit.cast("int"), "_asked": asked.cast("int"), "_is": F.coalesce(point, F.lit(False))}
    keyed = events.withColumns(work)
    by = [*[F.col(c) for c in group], *[col(c) for c in order]]
    ranged = keyed.repartitionByRange(n, *by).sortWithinPartitions(*by)
    columns = [*events.columns, "_group", "_asked", "_task", "_local", "_sums"]
    kept = T.StructType([T.StructField(f.name, f.dataType) for f in events.schema]).add("_group", T.LongType()).add("_asked", T.IntegerType()).add("_task", T.IntegerType()).add("_local", T.LongType()).add("_sums", T.ArrayType(T.LongType()))

    def run(batches):
        from pyspark import TaskContext

        task, last, held, types = TaskContext.get().partitionId(), None, np.zeros(fan, np.int64), None
        totals: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            of, own, ask = (batch.column(c).to_numpy() for c in ("_group", "_digit", "_asked"))
            is_point = batch.column("_is").to_numpy(zero_copy_only=False).astype(bool)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
            ends = np.concatenate([starts[1:], [m]])
            local = np.empty(m, np.int64)
            for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
                if last is None or of[a] != last:
                    if last is not None and not totals:
                        totals.append((last, held))
                    last, held = of[a], np.zeros(fan, np.int64)
                if fan == 1:
                    running = np.concatenate([[0], np.cumsum(is_point[a:z])])
                    local[a:z] = np.where(ask[a:z] > 0, running[:-1] + held[0], 0)
                    held = held + running[-1]
                else:
                    seen = np.zeros((z - a + 1, fan), np.int64)
                    at = np.flatnonzero(is_point[a:z])
                    seen[at + 1, own[a:z][at]] = 1
                    below = np.concatenate([np.zeros((z - a + 1, 1), np.int64), np.cumsum(np.cumsum(seen, axis=0) + held, axis=1)], axis=1)
                    local[a:z] = below[np.arange(z - a), ask[a:z]]
                    held = held + seen.sum(axis=0)
            given = [batch.column(k) for k in range(len(columns) - 5)]
            types = [c.type for c in given]
            yield pa.RecordBatch.from_arrays([*given, batch.column("_group"), batch.column("_asked"), pa.array(np.full(m, task, np.int32)), pa.array(local), pa.nulls(m, pa.list_(pa.int64()))], columns)
        if last is not None:  # only a task's first and last group can go on elsewhere
            ends = [*totals, (last, held)]
            k = len(ends)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(k, t) for t in types], pa.array([g for g, _ in ends], pa.int64()), pa.nulls(k, pa.int32()), pa.array([task] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.array([s.tolist() for _, s in ends], pa.list_(pa.int64()))], columns)

    counted = stored(ranged.mapInArrow(run, kept), "ordering")
    sums = counted.filter("_sums IS NOT NULL").select("_group", "_task", F.posexplode("_sums").alias("_d", "_n"))
    earlier = sums.withColumn("_n", F.coalesce(F.sum("_n").over(W.partitionBy("_group", "_d").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    upto = earlier.withColumn("_more", F.sum("_n").over(W.partitionBy("_group", "_task").orderBy("_d"))).filter("_more > 0")
    more = counted_broadcast(stored(upto.select("_group", "_task", (F.col("_d") + 1).alias("_asked"), "_more"), "ordering"))
    rows = counted.filter("_sums IS NULL").join(more, ["_group", "_task", "_asked"], "left")
    return rows.select(*events.columns, (F.col("_local") + F.coalesce("_more", F.lit(0))).alias(name))


def ranks(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Adds the row's place in its group by ``order``, from 0; equal rows stand in some order."""
    return counted_before(df, by, order, F.lit(True), name)


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str = "average_rank") -> DataFrame:
    """Adds the row's rank in its group by ``value``, from 1, with ties at their mean; NULLs come first and tie."""
    placed = stored(ranks(df, by, [value], "_place"), "ordering")
    means = placed.groupBy(*by, value).agg(((F.min("_place") + F.max("_place")) / 2 + 1).alias(name))
    return null_safe_join(placed, means, [*by, value]).select(*df.columns, name)


def similar_percentiles(df: DataFrame, probes: DataFrame, key: str, by: str, size: str, value: str, factor: float, least: int = 20) -> DataFrame:
    """key, n, percentile of each probe: how many rows of its class ``by`` have a size within a factor of its own, and
    which percentage of those with a value lie strictly below its value; NULL below ``least`` rows or without a value.

    Rows and probes without a class, or with a size that is not positive, don't take part. Keys of probes are unique.
    No pairs are formed: ranks by value and by size turn the question into counts of points below and left of others,
    and these into counts by digits of the ranks, some log_64 of the rows a row.
    """
    fine = lambda t: t.filter((F.col(size) > 0) & ~F.isnan(F.col(size).cast("double")) & F.col(by).isNotNull())
    v, none = F.col(value).cast("double"), F.lit(None).cast(probes.schema[key].dataType)
    rows = fine(df).select(F.col(by).alias("_by"), none.alias("_key"), F.col(size).cast("double").alias("_size"), v.alias("_value"), F.lit(True).alias("_point"))
    asked = fine(probes).select(F.col(by).alias("_by"), F.col(key).alias("_key"), F.col(size).cast("double").alias("_size"), v.alias("_value"), F.lit(False).alias("_point"))
    by_value = counted_before(rows.unionByName(asked), ["_by"], ["_value", "_point"], F.col("_point") & F.col("_value").isNotNull(), "_j")
    # events by size: a point; for a probe both ends of its range, of all rows (2) and of those with a value (1)
    ends = [(F.col("_size") / factor, -1, 0, d) for d in (1, 2)] + [(F.col("_size") * factor, 1, 2, d) for d in (1, 2)]
    asked = F.array(*[F.struct(s.alias("_at"), F.lit(g).alias("_sign"), F.lit(o).alias("_turn"), F.lit(d).alias("_d")) for s, g, o, d in ends])
    alone = F.array(F.struct(F.col("_size").alias("_at"), F.lit(0).alias("_sign"), F.lit(1).alias("_turn"), F.lit(1).alias("_d")))
    events = by_value.withColumn("_e", F.explode(F.when(F.col("_point"), alone).otherwise(asked))).select("_by", "_key", "_value", "_point", "_j", "_e.*")
    placed = stored(counted_before(events, ["_by"], ["_at", "_turn"], F.col("_point"), "_i", F.col("_value").isNull(), F.col("_d"), fan=2), "similar")
    counts = placed.filter("NOT _point AND _d = 2").groupBy("_key").agg(F.sum(F.col("_sign") * F.col("_i")).alias("n"))
    valued = placed.filter("(_point AND _value IS NOT NULL) OR (NOT _point AND _d = 1)")
    of_value = valued.filter("NOT _point").groupBy("_key").agg(F.sum(F.col("_sign") * F.col("_i")).alias("_n"), F.max(F.col("_value").isNull()).alias("_none"))
    below = counts_below(valued.select("_by", "_key", "_sign", "_point", "_i", "_j")).groupBy("_key").agg(F.sum(F.col("_sign") * F.col("_below")).alias("_below"))
    found = counts.join(of_value, "_key").join(below, "_key", "left")
    share = 100 * F.try_divide(F.coalesce("_below", F.lit(0)).cast("double"), F.col("_n"))
    return found.filter("n > 0").select(F.col("_key").alias(key), "n", F.when((F.col("n") >= least) & ~F.col("_none"), share).alias("percentile"))


def counts_below(events: DataFrame) -> DataFrame:
    """Adds ``_below`` to the rows that aren't points: how many points of their class ``_by`` have both a smaller ``_i`` and
    a smaller ``_j``; a row a digit where that is not 0. Ranks of points are unique from 0 in ``_i``."""
    top = events.agg(F.max("_i")).head()[0] or 0
    levels = max(1, math.ceil(math.log(top + 2, FAN)))
    width = F.pow(F.lit(float(FAN)), F.col("_level")).cast("long")
    each = events.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    digit = F.floor(F.col("_i") / width) % FAN
    each = each.select("*", F.floor(F.col("_i") / (width * FAN)).cast("long").alias("_prefix"), digit.cast("int").alias("_digit_of"))
    each = each.filter("_point OR _digit_of > 0")
    counted = counted_before(each, ["_by", "_level", "_prefix"], ["_j", "_point"], F.col("_point"), "_below", F.col("_digit_of"), F.col("_digit_of"), fan=FAN)
    return counted.filter("NOT _point AND _below > 0")
