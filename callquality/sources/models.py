"""Models between their tables (nodes and knots, see ``operators.scoring``) and one JSON document a regime."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a model document.
_NODE = "leaf: boolean, value: double, feature: int, threshold: double, missing_left: boolean, left: int, right: int"
_TREE = f"struct<nodes: array<struct<{_NODE}>>>"
DOCUMENT = (
    f"q_median struct<baseline: double, trees: array<{_TREE}>>, "
    f"direction struct<classes: array<string>, baseline: array<double>, trees: array<array<{_TREE}>>, calibrators: array<struct<x: array<double>, y: array<double>, increasing: boolean>>>"
)
CLASS_NAMES = ("ok", "too_long", "too_short")
NODE_COLUMNS = ("regime", "head", "iter", "class", "node_id", "is_leaf", "value", "feature", "threshold", "missing_left", "left", "right")


def _in_order(keys: Sequence[str], value: str, where: Column | None = None) -> Column:
    """The values of a group as an array in the order of the keys, which are unique in it."""
    row = F.struct(*keys, value)
    return F.transform(F.array_sort(F.collect_list(row if where is None else F.when(where, row))), lambda x: x[value])


def model_documents(nodes: DataFrame, knots: DataFrame, class_names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """(regime, document): each regime's two heads as JSON. Leaves and splits carry only their own fields; a class without
    knots gets empty ones, a head without a baseline none."""
    leaf = F.col("is_leaf")
    own = [F.when(leaf, F.lit(True)).alias("leaf"), F.when(leaf, F.col("value")).alias("value")]
    own += [F.when(~leaf, F.col(c)).alias(c) for c in ("feature", "threshold", "missing_left", "left", "right")]
    grown = nodes.filter("iter >= 0").withColumn("_node", F.struct(*own)).groupBy("regime", "head", "iter", "class").agg(_in_order(["node_id"], "_node").alias("nodes"))
    by_iter = grown.withColumn("_tree", F.struct("nodes")).groupBy("regime", "head", "iter").agg(_in_order(["class"], "_tree").alias("_trees")).withColumn("_first", F.get("_trees", F.lit(0)))
    size, direction = F.col("head") == "size", F.col("head") == "direction"
    trees = by_iter.groupBy("regime").agg(_in_order(["iter"], "_first", size).alias("_size"), _in_order(["iter"], "_trees", direction).alias("_direction"))
    base = nodes.filter("iter = -1").groupBy("regime").agg(F.max(F.when(size, F.col("value"))).alias("_size_base"), _in_order(["class"], "value", direction).alias("_direction_base"))
    curves = knots.groupBy("regime", "class").agg(_in_order(["i"], "x").alias("x"), _in_order(["i"], "y").alias("y"))
    curves = curves.groupBy("regime").agg(F.map_from_entries(F.collect_list(F.struct("class", F.struct("x", "y", F.lit(True).alias("increasing"))))).alias("_curves"))
    none = F.struct(F.array().cast("array<double>").alias("x"), F.array().cast("array<double>").alias("y"), F.lit(True).alias("increasing"))
    calibrators = F.array(*[F.coalesce(F.try_element_at("_curves", F.lit(k)), none) for k in range(len(class_names))])
    heads = nodes.select("regime").distinct().join(trees, "regime", "left").join(base, "regime", "left").join(curves, "regime", "left")
    q = F.struct(F.col("_size_base").alias("baseline"), F.col("_size").alias("trees"))
    d = F.struct(F.array(*[F.lit(c) for c in class_names]).alias("classes"), F.col("_direction_base").alias("baseline"), F.col("_direction").alias("trees"), calibrators.alias("calibrators"))
    return heads.select("regime", F.to_json(F.struct(q.alias("q_median"), d.alias("direction"))).alias("document"))


def model_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, knots) of documents (regime, document). Node numbers are places in the document; baselines are leaves of
    iteration -1. A document that is no JSON of this form gives no rows."""
    read = documents.select("regime", F.from_json("document", DOCUMENT).alias("_m")).select("regime", "_m.*")
    q = read.select("regime", F.lit("size").alias("head"), F.posexplode("q_median.trees").alias("iter", "_tree")).withColumn("class", F.lit(0))
    d = read.select("regime", F.lit("direction").alias("head"), F.posexplode("direction.trees").alias("iter", "_classes")).select("regime", "head", "iter", F.posexplode("_classes").alias("class", "_tree"))
    each = q.unionByName(d).select("regime", "head", "iter", "class", F.posexplode("_tree.nodes").alias("node_id", "_n"))
    grown = each.select(
        "regime", "head", "iter", "class", "node_id", F.coalesce("_n.leaf", F.lit(False)).alias("is_leaf"),
        *[F.col("_n")[c].alias(c) for c in ("value", "feature", "threshold", "missing_left", "left", "right")],
    )
    base = read.select("regime", F.lit("size").alias("head"), F.lit(0).alias("class"), F.col("q_median.baseline").alias("value")).unionByName(
        read.select("regime", F.lit("direction").alias("head"), F.posexplode("direction.baseline").alias("class", "value"))
    )
    base = base.filter("value IS NOT NULL").withColumns({"iter": F.lit(-1), "node_id": F.lit(0), "is_leaf": F.lit(True)})
    nodes = grown.unionByName(base, allowMissingColumns=True).select(*NODE_COLUMNS)
    curves = read.select("regime", F.posexplode("direction.calibrators").alias("class", "_c"))
    knots = curves.select("regime", "class", F.posexplode(F.arrays_zip("_c.x", "_c.y")).alias("i", "_k"))
    return nodes, knots.select("regime", "class", "i", F.col("_k")["x"].alias("x"), F.col("_k")["y"].alias("y"))
