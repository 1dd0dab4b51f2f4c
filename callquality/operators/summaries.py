"""Summaries that merge: sums, distinct counts and quantiles of parts give those of the whole without its rows.

A state has one row a group: sums as they are, a distinct sketch (HyperLogLog) and a quantile sketch (KLL) as bytes of
bounded size. States of batches, files or sources are merged by a grouping; merging over fewer columns rolls groups up.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the sketches: 2^14 registers (relative standard error 0.8 %), k of KLL.
LOG_REGISTERS, KLL_SIZE = 14, 1000


def rank_bound(k: int = KLL_SIZE) -> float:
    """Normalised rank error of a KLL sketch (99 % confidence), for any number of merged parts: 0.28 % at 1000."""
    return 2.296 / k**0.9723


class Summary(NamedTuple):
    """What is kept of rows, each a name and an expression in SQL: sums, distinct values, and values whose quantiles are asked."""

    sums: dict[str, str]
    distinct: dict[str, str] = {}
    quantiles: dict[str, str] = {}


def state_of(df: DataFrame, by: Sequence[str], summary: Summary) -> DataFrame:
    """The state of these rows, one row a group. NULLs count for nothing, nor does NaN as a quantile's value; a sum of NULLs
    only is NULL."""
    sums = [F.sum(F.expr(c)).alias(n) for n, c in summary.sums.items()]
    distinct = [F.hll_sketch_agg(F.expr(c), LOG_REGISTERS).alias(n) for n, c in summary.distinct.items()]
    quantiles = [F.kll_sketch_agg_double(F.nullif(F.expr(c).cast("double"), F.lit(float("nan"))), KLL_SIZE).alias(n) for n, c in summary.quantiles.items()]
    return df.groupBy(*by).agg(*sums, *distinct, *quantiles)


def merged(states: DataFrame, by: Sequence[str], summary: Summary) -> DataFrame:
    """States of parts as the state of all, by the same columns or fewer."""
    sums = [F.sum(n).alias(n) for n in summary.sums]
    distinct = [F.hll_union_agg(n).alias(n) for n in summary.distinct]
    quantiles = [F.kll_merge_agg_double(n, KLL_SIZE).alias(n) for n in summary.quantiles]
    return states.groupBy(*by).agg(*sums, *distinct, *quantiles)


def told(state: DataFrame, summary: Summary, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The state in numbers: sums, distinct counts (long), and an array of quantiles a value (NULL for a group without any)."""
    ranks = F.array(*[F.lit(float(s)) for s in shares])
    out = {n: F.hll_sketch_estimate(n) for n in summary.distinct}
    out |= {n: F.when(F.kll_sketch_get_n_double(n) > 0, F.kll_sketch_get_quantile_double(n, ranks)) for n in summary.quantiles}
    return state.withColumns(out) if out else state
