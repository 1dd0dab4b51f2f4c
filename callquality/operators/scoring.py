"""Scoring with tree ensembles kept as tables: Arrow batches, experts by regime, native calibration.

A model is two tables: nodes (regime, head, iter, class, node_id, is_leaf, value, feature, threshold, missing_left, left,
right) with baselines as leaves of iteration -1, and knots (regime, class, i, x, y). Models are small by contract
(``MOST_NODES``), and broadcast only after their nodes have been counted.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callquality.operators.joins import GuardError

MOST_NODES = 5_000_000
FINITE = 1.7976931348623157e308


def compile_model(nodes: DataFrame) -> dict:
    """(regime, head) -> list of (class, arrays of one tree); GuardError beyond ``MOST_NODES`` or on NaN."""
    if (n := nodes.count()) > MOST_NODES:
        raise GuardError(f"{n} nodes; a broadcast model has at most {MOST_NODES}")
    trees = defaultdict(list)
    table = nodes.select("regime", "head", "iter", "class", "node_id", "is_leaf", "value", "feature", "threshold", "missing_left", "left", "right").toPandas()
    for (regime, head, _, cls), t in table.groupby(["regime", "head", "iter", "class"], sort=True):
        t = t.sort_values("node_id")
        leaf = t["is_leaf"].to_numpy(bool)
        value, limit = (t[c].to_numpy(float) for c in ("value", "threshold"))
        if np.isnan(value[leaf]).any() or np.isnan(limit[~leaf]).any():
            raise GuardError(f"NaN in a tree of {regime} {head}")
        whole = lambda c: t[c].fillna(0).to_numpy(np.int64)
        trees[regime, head].append((int(cls), leaf, value, whole("feature"), np.clip(limit, -FINITE, FINITE), t["missing_left"].eq(True).to_numpy(bool), whole("left"), whole("right")))
    return dict(trees)


def tree_values(tree, x: np.ndarray) -> np.ndarray:
    """Leaf values of all rows: down the tree level by level; a missing value goes where its node says, x <= threshold left."""
    _, leaf, value, feature, limit, missing_left, left, right = tree
    at = np.zeros(len(x), np.int64)
    active = np.flatnonzero(~leaf[at])
    while len(active):
        node = at[active]
        v = x[active, feature[node]]
        with np.errstate(invalid="ignore"):
            go_left = np.where(np.isnan(v), missing_left[node], v <= limit[node])
        at[active] = np.where(go_left, left[node], right[node])
        active = active[~leaf[at[active]]]
    return value[at]


def raw_sums(trees: list, x: np.ndarray, classes: int) -> np.ndarray:
    out = np.zeros((len(x), classes))
    for tree in trees:
        out[:, tree[0]] += tree_values(tree, x)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def isotonic(knots: list[tuple[float, float]] | None, p: np.ndarray) -> np.ndarray:
    """Piecewise linear between knots, clipped at the ends; no knots leave the value."""
    if not knots:
        return p
    xs, ys = np.array(knots).T
    return np.interp(p, xs, ys)


def calibrated(p: np.ndarray, knots: dict[int, list]) -> np.ndarray:
    """Each class through its own curve, clipped to [0, 1] and renormalised; all zero becomes equal shares."""
    q = np.clip(np.column_stack([isotonic(knots.get(k), p[:, k]) for k in range(p.shape[1])]), 0, 1)
    total = q.sum(axis=1, keepdims=True)
    return np.where(total > 0, q / np.where(total > 0, total, 1), 1 / p.shape[1])


def compile_knots(knots: DataFrame) -> dict:
    """regime -> class -> knots in order; GuardError beyond ``MOST_NODES``."""
    if (n := knots.count()) > MOST_NODES:
        raise GuardError(f"{n} knots; a broadcast model has at most {MOST_NODES}")
    out: dict = defaultdict(lambda: defaultdict(list))
    for r in knots.select("regime", "class", "i", "x", "y").orderBy("regime", "class", "i").collect():
        out[r["regime"]][r["class"]].append((r["x"], r["y"]))
    return {k: dict(v) for k, v in out.items()}


def score(df: DataFrame, nodes: DataFrame, knots: DataFrame, features: dict[str, list[str]], regime: str = "regime", classes: int = 3, digits: int = 3) -> DataFrame:
    """Adds factor, p_0 ... p_k: each row by its regime's experts, with that regime's ordered features, rounded.

    Rows of a regime without experts get NULLs. Missing feature values are NaN inside. No shuffle: a batch is masked by
    regime, so a regime with most rows is no hot key."""
    shared = df.sparkSession.sparkContext.broadcast((compile_model(nodes), compile_knots(knots)))
    names = sorted({n for fs in features.values() for n in fs})
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise GuardError(f"missing features: {missing}")
    outputs = ["factor", *[f"p_{k}" for k in range(classes)]]
    carried = df.columns
    base = df.withColumn("_x", F.array(*[F.col(n).cast("double") for n in names])) if names else df.withColumn("_x", F.array().cast("array<double>"))

    def run(batches):
        trees, curves = shared.value
        for batch in batches:
            n = batch.num_rows
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, len(names)) if n else np.zeros((0, len(names)))
            of = np.array(batch.column(regime).to_pylist(), dtype=object)
            out = np.full((n, classes + 1), np.nan)
            for r, own in features.items():
                rows = np.flatnonzero(of == r)
                if not len(rows):
                    continue
                part = x[np.ix_(rows, [names.index(c) for c in own])]
                if (r, "size") in trees:
                    out[rows, 0] = np.exp(raw_sums(trees[r, "size"], part, 1)[:, 0])
                if (r, "direction") in trees:
                    out[rows, 1:] = calibrated(softmax(raw_sums(trees[r, "direction"], part, classes)), curves.get(r, {}))
            scale = 10.0**digits
            out = np.rint(out * scale) / scale + 0.0
            columns = [pa.array(out[:, k], pa.float64(), from_pandas=True) for k in range(classes + 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *columns], [*carried, *outputs])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return base.mapInArrow(run, f"{kinds}, " + ", ".join(f"{o} double" for o in outputs))


def calibrate_column(value: Column, knots: Column) -> Column:
    """Native piecewise-linear calibration: ``knots`` is an array of (x, y) in order of x.

    The value is bound once, outside the comparisons, as it may come from a model's own function."""

    def curve(v: Column) -> Column:
        n = F.size(knots)
        inside = F.filter(F.transform(knots, lambda k, i: F.struct(k.alias("a"), F.get(knots, i + 1).alias("b"))), lambda s: (s["a"]["x"] <= v) & (v <= s["b"]["x"]))
        s = F.get(inside, F.lit(0))
        width = s["b"]["x"] - s["a"]["x"]
        line = F.when(width > 0, s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * (v - s["a"]["x"]) / width).otherwise(s["b"]["y"])
        first, last = F.get(knots, F.lit(0)), F.get(knots, n - 1)
        return F.when(F.coalesce(n, F.lit(0)) == 0, v).when(v <= first["x"], first["y"]).when(v >= last["x"], last["y"]).otherwise(line)

    return F.get(F.transform(F.array(value), curve), F.lit(0))


def renormalised(probabilities: list[Column]) -> list[Column]:
    clipped = [F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) for p in probabilities]
    total = clipped[0]
    for c in clipped[1:]:
        total = total + c
    return [F.when(total > 0, c / total).otherwise(1.0 / len(clipped)) for c in clipped]


def prediction_parity(a: DataFrame, b: DataFrame, on: list[str], columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(column, largest difference, agree) of two scorers' results."""
    j = a.select(*on, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(*on, *[F.col(c).alias(f"b_{c}") for c in columns]), on)
    worst = j.agg(*[F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias(c) for c in columns])
    return worst.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("worst")) for c in columns])).alias("x")).select("x.*", (F.coalesce("x.worst", F.lit(math.inf)) <= tolerance).alias("agree"))


def combine_experts(first: DataFrame, second: DataFrame, regimes_of_first: list[str], features_first: DataFrame, features_second: DataFrame) -> DataFrame:
    """Nodes of chosen regimes from one model and of the others from another; their features must be equal."""
    cols = ["branch", "pos", "name"]
    if not features_first.select(*cols).exceptAll(features_second.select(*cols)).isEmpty() or not features_second.select(*cols).exceptAll(features_first.select(*cols)).isEmpty():
        raise GuardError("the models have different features")
    return first.filter(F.col("regime").isin(*regimes_of_first)).unionByName(second.filter(~F.col("regime").isin(*regimes_of_first)))
