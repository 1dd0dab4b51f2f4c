"""Connected groups of a graph by alternating star contractions, each a grouping and a join by key whose hubs are split."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callquality.operators.joins import GuardError
from callquality.operators.shared import stored

#: A hub holds more than this share of all edge ends, so there are at most 20,000 hubs, which can be broadcast.
HUB_SHARE = 1 / 20_000
#: Below so many edge ends no node is a hub.
LEAST_HUB = 100_000


def _with_least(ends: DataFrame, least_hub: int) -> DataFrame:
    """Adds ``m``, the smaller of ``u`` and its smallest ``v``.

    The minimum is a partial aggregation. Rows of hubs get it by a broadcast join, where they are; only rows of other nodes
    are shuffled by key, at most a 20,000th of all (or ``least_hub``) to a key."""
    least = stored(ends.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")), "components-least")
    total = least.agg(F.sum("n")).head()[0] or 0
    is_hub = F.col("n") > max(least_hub, total * HUB_SHARE)
    hubs = least.filter(is_hub).select("u", F.col("m").alias("_hub"))
    told = ends.join(F.broadcast(hubs), "u", "left")
    others = told.filter("_hub IS NULL").drop("_hub").join(least.filter(~is_hub).select("u", "m"), "u")
    return others.unionByName(told.filter("_hub IS NOT NULL").withColumnRenamed("_hub", "m"))


def _pairs(rows: DataFrame, *ends: tuple[Column, Column]) -> DataFrame:
    """Distinct (u, v), u above v, of these ends."""
    each = rows.select(F.explode(F.array(*[F.struct(a.alias("u"), b.alias("v")) for a, b in ends])).alias("e")).select("e.*")
    return each.filter("u > v").distinct()


def components(edges: DataFrame, most_rounds: int | None = None, least_hub: int = LEAST_HUB) -> DataFrame:
    """(node, group): for each key that an edge (a, b) names, the smallest key that it reaches.

    A round links each node's larger neighbours to the smallest of all (large star), then its smaller ones and itself to the
    smallest of these (small star); groups become stars after rounds by the logarithm of their longest path. Each half is
    written to the shared folder. Edges with a NULL or twice the same key, and repeated ones, say nothing. GuardError if
    ``most_rounds`` rounds are not enough.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    for done in count():
        role = F.explode(F.array(F.struct(u.alias("node"), F.lit(1).alias("n"), F.lit(False).alias("low")), F.struct(v.alias("node"), F.lit(0).alias("n"), F.lit(True).alias("low")))).alias("r")
        roles = now.select(role).select("r.*").groupBy("node").agg(F.sum("n").alias("n"), F.bool_or("low").alias("low"))
        if roles.filter("n > 1 OR (n = 1 AND low)").isEmpty():
            break
        if done == most_rounds:
            raise GuardError(f"groups are not yet stars after {most_rounds} rounds")
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        now = stored(_pairs(_with_least(both, least_hub).filter("v > u"), (v, m)), "components")
        now = stored(_pairs(_with_least(now, least_hub), (v, m), (u, m)), "components")
    return now.select(u.alias("node"), v.alias("group")).unionByName(now.select(v.alias("node"), v.alias("group")).distinct())


def linked_groups(nodes: DataFrame, edges: DataFrame, key: str, most_rounds: int | None = None, least_hub: int = LEAST_HUB) -> DataFrame:
    """Adds ``group``, the smallest key that a node reaches over edges (a, b): its own where it has none. Keys that only edges
    name link as well. A NULL key has a NULL group, a repeated one the same group each time."""
    found = components(edges, most_rounds, least_hub)
    joined = nodes.join(found.select(F.col("node").alias("_node"), F.col("group").alias("_group")), F.col(key) == F.col("_node"), "left")
    return joined.withColumn("group", F.coalesce("_group", F.col(key))).drop("_node", "_group")
