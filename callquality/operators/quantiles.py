"""Exact quantiles by selection: a sketch brackets each wanted rank, counts below and inside the bracket settle it.

No group is sorted whole: of its rows only those inside the brackets, about 8 / accuracy of them, keep their values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callquality.functions.exprs import col
from callquality.operators.shared import stored

#: Groups of at most so many rows per unit of accuracy are one bracket.
WHOLE = 10


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on columns where NULL equals NULL; the right side's key columns go. Without columns, every pair of rows:
    only for sides of one row."""
    if not on:
        return left.join(right, F.lit(True), how)
    other = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    test = F.lit(True)
    for c in on:
        test = test & left[c].eqNullSafe(other[f"_right_{c}"])
    return left.join(other, test, how).drop(*[f"_right_{c}" for c in on])


def exact_quantiles(df: DataFrame, by: Sequence[str], values: dict[str, Column | str], shares: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """by, and for each name an array of the quantiles of its non-null values at ``shares``: linear between the two order
    statistics around share * (n - 1), as ``percentile`` gives. Groups without any value have no row (without ``by`` there is one); a name without
    values in a group is NULL; NaN is the greatest value.

    One pass sketches each group and name within 1 / ``accuracy`` of ranks, which gives a bracket a share of 4 / accuracy
    to either side; a second counts what lies below a bracket, and its values by themselves, so ties are one entry. If
    a sketch missed, the quantile would be NULL; its bound is four times met.
    """
    keys = {f"_by{k}": F.col(c) for k, c in enumerate(by)}
    cells = F.array(*[F.struct(F.lit(k).alias("_name"), col(v).cast("double").alias("_v")) for k, v in enumerate(values.values())])
    rows = stored(df.select(*[c.alias(k) for k, c in keys.items()], F.explode(cells).alias("_x")).select(*keys, "_x.*").filter("_v IS NOT NULL"), "quantiles")
    group, margin = [*keys, "_name"], 4 / accuracy
    edges = [min(max(s + d, 0.0), 1.0) for s in shares for d in (-margin, margin)]
    sketch = rows.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), accuracy).alias("_edges"))
    small = F.col("_n") <= WHOLE * accuracy
    brackets = [
        F.struct(F.lit(j).alias("_j"), F.when(small, F.col("_low")).otherwise(F.col("_edges")[2 * j]).alias("_from"), F.when(small, F.col("_high")).otherwise(F.col("_edges")[2 * j + 1]).alias("_to"))
        for j in range(len(shares))
    ]
    sketch = stored(sketch.select(*group, "_n", F.array(*brackets).alias("_brackets")), "quantiles")
    v = F.col("_v")
    met = null_safe_join(rows, sketch, group)
    hit = F.filter(F.col("_brackets"), lambda b: v <= b["_to"])
    place = met.select(*group, F.explode(F.transform(hit, lambda b: F.struct(b["_j"].alias("_j"), F.when(v >= b["_from"], v).alias("_v")))).alias("_x"))
    counts = place.select(*group, "_x.*").groupBy(*group, "_j", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*group, "_j").orderBy(F.asc_nulls_first("_v")))
    ranked = null_safe_join(counts.withColumn("_upto", upto), sketch.select(*group, "_n"), group)
    at = F.get(F.array(*[F.lit(float(s)) for s in shares]), F.col("_j")) * (F.col("_n") - 1)
    first = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    found = ranked.withColumn("_at", at).groupBy(*group, "_j").agg(F.max("_at").alias("_at"), first(F.floor("_at")).alias("_below"), first(F.ceil("_at")).alias("_above"))
    a, z, p = F.col("_below"), F.col("_above"), F.col("_at")
    value = F.when(a == z, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * z)
    each = found.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", value.alias("_q")))), lambda x: x["_q"]).alias("_q"))
    wide = each.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == k, F.col("_q"))).alias(name) for k, name in enumerate(values)])
    return wide.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *values)


def with_quantiles(summary: DataFrame, df: DataFrame, by: Sequence[str], values: dict[str, Column | str], shares: Sequence[float]) -> DataFrame:
    """A summary of ``df`` by ``by`` with the exact quantiles of more values, an array a name."""
    return null_safe_join(summary, exact_quantiles(df, by, values, shares), by, "left")
