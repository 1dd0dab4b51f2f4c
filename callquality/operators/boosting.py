"""Boosted trees on histograms, grown by Spark jobs, as node tables (see ``operators.scoring``).

Features are cut into at most 255 bins at quantiles and stored as a byte each. A level of all trees of a round is one
job: tasks bring their rows to their nodes, sum gradients, hessians and counts by (class, node, feature, bin), and only
these sums are shuffled, so their number depends on nodes, features and bins, not on rows. Running sums over bins give
each node's best split, with missing values on either side. Gradients are summed as integers, so a fit gives the same
trees whatever the partitions and however often a task is run.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callquality.operators.joins import GuardError
from callquality.operators.scoring import FINITE, softmax
from callquality.operators.shared import stored

#: The byte of a missing value; bins are below it. Units of a gradient of one.
MISSING, UNIT = 255, 1 << 24
NODE_SCHEMA = "head string, iter int, class int, node_id int, is_leaf boolean, value double, feature int, threshold double, missing_left boolean, `left` int, `right` int"


def feature_cuts(df: DataFrame, features: Sequence[str], bins: int = 255, accuracy: int = 10_000) -> list[np.ndarray]:
    """Per feature at most ``bins`` - 1 increasing cuts: quantiles of the values that are there, from one aggregation.

    A feature with fewer values than bins is cut at each of them. The greatest value is no cut, nor is NaN or NULL."""
    if not 2 <= bins <= 255:
        raise GuardError("bins must be 2 to 255")
    known = [F.when(~F.isnan(c) & c.isNotNull(), c) for c in (F.col(f).cast("double") for f in features)]
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    row = df.agg(*[F.struct(F.percentile_approx(c, shares, accuracy).alias("at"), F.max(c).alias("top")).alias(f"f{k}") for k, c in enumerate(known)]).head()
    return [np.array(sorted({v for v in row[f"f{k}"]["at"] or [] if v < row[f"f{k}"]["top"]})) for k in range(len(features))]


def class_shares(df: DataFrame, label: str, classes: int = 3, weight: str | None = None) -> list[float]:
    """Share of each class by weight; GuardError on other classes or no weight."""
    known = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("c")).agg(F.sum(F.col(weight) if weight else F.lit(1)).cast("double").alias("w"))
    found = {r["c"]: r["w"] or 0.0 for r in known.limit(classes + 1).collect()}
    if set(found) - set(range(classes)) or sum(found.values()) <= 0:
        raise GuardError(f"no rows to fit, or labels are not 0 to {classes - 1}")
    return [found.get(c, 0.0) / sum(found.values()) for c in range(classes)]


def log_share(share: float) -> float:
    """The baseline of a class; one without rows counts as 1e-12 of them."""
    return float(np.log(max(share, 1e-12)))


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bytes of the bins: the number of cuts below a value, so that x <= cuts[b] is bin <= b."""
    out = np.empty(x.shape, np.uint8)
    for f, cut in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(cut, x[:, f], "left"))
    return out


@dataclass
class GrownTree:
    """A tree over bins, by node: feature (-1: leaf), last bin of the left side, side of missing values, children, value."""

    feature: list[int]
    bin: list[int]
    missing_left: list[bool]
    left: list[int]
    right: list[int]
    value: list[float]

    @classmethod
    def stump(cls) -> GrownTree:
        return cls([-1], [0], [False], [0], [0], [0.0])

    def split(self, node: int, feature: int, last: int, missing_left: bool) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.bin[node], self.missing_left[node], self.left[node], self.right[node] = feature, last, missing_left, n, n + 1
        for _ in range(2):
            for column, v in zip((self.feature, self.bin, self.missing_left, self.left, self.right, self.value), (-1, 0, False, 0, 0, 0.0), strict=True):
                column.append(v)
        return n, n + 1

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, last, missing_left, left, right = (np.array(c) for c in (self.feature, self.bin, self.missing_left, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        active = np.flatnonzero(feature[at] >= 0)
        while len(active):
            node = at[active]
            v = bins[active, feature[node]]
            at[active] = np.where(np.where(v == MISSING, missing_left[node], v <= last[node]), left[node], right[node])
            active = active[feature[at[active]] >= 0]
        return at

    def values_of(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes_of(bins)]


def gradients(loss: str, raw: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives by row and class, in units: absolute loss (half of it, the median's) or log loss."""
    if loss == "median":
        g, h = np.where(target[:, None] > raw, -0.5, 0.5) * (target[:, None] != raw), np.ones_like(raw)
    else:
        p = softmax(raw)
        g, h = p - (target[:, None] == np.arange(raw.shape[1])), p * (1 - p)
    return tuple(np.rint(d * weight[:, None] * UNIT).astype(np.int64) for d in (g, h))


def level_sums(rows: DataFrame, loss: str, n_features: int, done: Sequence[Sequence[GrownTree]], trees: Sequence[GrownTree], open_nodes: Sequence[Sequence[int]]) -> DataFrame:
    """class, node, feature, bin, g, h, n: sums over the rows in the open nodes of the trees of one round."""
    held = rows.sparkSession.sparkContext.broadcast((done, trees, open_nodes))
    names = ["class", "node", "feature", "bin", "g", "h", "n"]

    def run(batches):
        done, trees, open_nodes = held.value
        sums = [np.zeros((len(at), n_features, 256, 3), np.int64) for at in open_nodes]
        for batch in batches:
            bins, raw, target, weight = _read(batch, n_features, done)
            g, h = gradients(loss, raw, target, weight)
            for k, (tree, at) in enumerate(zip(trees, open_nodes, strict=True)):
                if not at:
                    continue
                place = np.full(len(tree.feature), -1)
                place[at] = np.arange(len(at))
                node = place[tree.nodes_of(bins)]
                rows = np.flatnonzero(node >= 0)
                node, own = node[rows] * 256, np.stack([g[rows, k], h[rows, k], np.ones(len(rows), np.int64)])
                for f in range(n_features):
                    key = node + bins[rows, f]
                    for j in range(3):  # sums of whole numbers below 2**53: exact
                        sums[k][:, f, :, j] += np.bincount(key, own[j], len(at) * 256).reshape(len(at), 256).astype(np.int64)
        for k, at in enumerate(open_nodes):
            if at:
                node, feature, b = np.nonzero(sums[k][..., 2])
                found = sums[k][node, feature, b]
                columns = [np.full(len(b), k, np.int32), np.array(at, np.int32)[node], feature.astype(np.int32), b.astype(np.int32), *found.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    each = rows.mapInArrow(run, "class int, node int, feature int, bin int, g long, h long, n long")
    # Tasks have summed already, so rows go straight to where their bins are summed and walked: one shuffle.
    return each.repartition("class", "node", "feature").groupBy("class", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])


def best_splits(sums: DataFrame, l2: float = 1.0, least_rows: int = 20) -> DataFrame:
    """One row a class and node: its sums (g, h, n), and its best split: feature, bin (the last of the left side),
    missing_left, gain, and the left side's sums; gain is NULL where no split leaves ``least_rows`` on both sides.

    A split's gain is what the sides' g**2 / (h + l2) exceed the node's by. Missing values are tried on both sides; where
    a feature has none, they will follow the larger side. Ties: the first feature, then the first bin, then missing left."""
    node = W.partitionBy("class", "node", "feature")
    upto = node.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    columns = ("g", "h", "n")
    known = {c: F.when(F.col("bin") < MISSING, F.col(c)).otherwise(0) for c in columns}
    ready = sums.select("class", "node", "feature", "bin", *[F.sum(c).over(node).alias(f"{c}_all") for c in columns], *[F.sum(known[c]).over(upto).alias(f"{c}_upto") for c in columns], *[(F.sum(c).over(node) - F.sum(known[c]).over(node)).alias(f"{c}_missing") for c in columns])
    sides = F.explode(F.array(F.lit(True), F.lit(False))).alias("missing_left")
    tried = ready.select("*", sides).filter((F.col("n_missing") > 0) | F.col("missing_left"))
    tried = tried.withColumns({f"{c}_left": F.col(f"{c}_upto") + F.when(F.col("missing_left"), F.col(f"{c}_missing")).otherwise(0) for c in columns})

    def part(g: Column, h: Column) -> Column:
        return (g / UNIT) * (g / UNIT) / (h / UNIT + l2)

    right = {c: F.col(f"{c}_all") - F.col(f"{c}_left") for c in columns}
    gain = part(F.col("g_left"), F.col("h_left")) + part(right["g"], right["h"]) - part(F.col("g_all"), F.col("h_all"))
    fits = (F.col("bin") < MISSING) & (F.col("n_left") >= least_rows) & (right["n"] >= least_rows)
    heavier = F.when(F.col("n_missing") > 0, F.col("missing_left")).otherwise(F.col("n_left") >= right["n"])
    tried = tried.withColumn("gain", F.when(fits, gain))
    order = F.when(F.col("gain") > 1e-12, F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), F.col("missing_left").alias("m")))
    split = F.struct("feature", "bin", heavier.alias("missing_left"), "gain", *[f"{c}_left" for c in columns])
    best = tried.groupBy("class", "node").agg(*[F.max(f"{c}_all").alias(c) for c in columns], F.max_by(split, order).alias("split"))
    return best.select("class", "node", *columns, "split.*")


def _read(batch, n_features: int, done) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, raw predictions (those stored and those of the rounds since), targets and weights of a batch."""
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, n_features)
    raw = np.frombuffer(b"".join(batch.column("raw").to_pylist()), np.float64).reshape(n, -1).copy()
    for trees in done:
        for k, tree in enumerate(trees):
            raw[:, k] += tree.values_of(bins)
    return bins, raw, batch.column("target").to_numpy(), batch.column("weight").to_numpy()


def binned_rows(df: DataFrame, features: Sequence[str], target: str, weight: str | None, cuts: Sequence[np.ndarray], base: Sequence[float]) -> DataFrame:
    """target, weight, bins (a byte a feature) and raw (the predictions to start from, 8 bytes a class) of the rows that count."""
    given = df.select(F.col(target).cast("double").alias("target"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("weight"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    start, width = np.array(base, np.float64).tobytes(), len(features)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, width)
            bins = binned(x, cuts).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("target"), batch.column("weight"), pa.array([bins[k * width : (k + 1) * width] for k in range(n)], pa.binary()), pa.array([start] * n, pa.binary())], ["target", "weight", "bins", "raw"])

    return given.filter("target IS NOT NULL AND NOT isnan(target) AND weight > 0").mapInArrow(run, "target double, weight double, bins binary, raw binary")


def _advanced(rows: DataFrame, n_features: int, done) -> DataFrame:
    """The rows with the predictions of the rounds so far, stored."""
    held = rows.sparkSession.sparkContext.broadcast(done)

    def run(batches):
        for batch in batches:
            _, raw, _, _ = _read(batch, n_features, held.value)
            packed, width = raw.tobytes(), raw.shape[1] * 8
            yield pa.RecordBatch.from_arrays([batch.column("target"), batch.column("weight"), batch.column("bins"), pa.array([packed[k * width : (k + 1) * width] for k in range(len(raw))], pa.binary())], ["target", "weight", "bins", "raw"])

    return stored(rows.mapInArrow(run, rows.schema), "boosting")


def _leaf_medians(rows: DataFrame, n_features: int, done, tree: GrownTree) -> dict[int, float]:
    """The median residual of each leaf (Spark's quantile sketch, one aggregation)."""
    held = rows.sparkSession.sparkContext.broadcast((done, tree))

    def run(batches):
        for batch in batches:
            done, tree = held.value
            bins, raw, target, _ = _read(batch, n_features, done)
            yield pa.RecordBatch.from_arrays([pa.array(tree.nodes_of(bins).astype(np.int32)), pa.array(target - raw[:, 0])], ["leaf", "left_over"])

    each = rows.mapInArrow(run, "leaf int, left_over double")
    return {r["leaf"]: r["m"] for r in each.groupBy("leaf").agg(F.percentile_approx("left_over", 0.5, 10_000).alias("m")).collect()}


def fit_boosted(
    df: DataFrame, features: Sequence[str], target: str, loss: str = "median", classes: int = 3, weight: str | None = None, iterations: int = 100, rate: float = 0.05,
    leaves: int = 31, depth: int = 8, least_rows: int = 300, l2: float = 1.0, bins: int = 255, refresh: int = 10,
) -> DataFrame:
    """Nodes (``NODE_SCHEMA``; thresholds over the features' own values, features by place) of a boosted fit.

    ``loss``: "median" (half the absolute loss; head ``size``, one tree a round, leaves at the median residual) or
    "log_loss" (head ``direction``, a tree a round and class, targets 0 to ``classes`` - 1, leaves by Newton's step).
    Iteration -1 holds the baselines: the median, or logarithms of the classes' shares, a class without rows at 1e-12 of
    them. Trees grow level by level to ``depth``; where more than ``leaves`` would come, the splits with the greatest
    gains are made. Rows without a target or with a weight of 0 don't count; NULL and NaN features are missing. A fit on
    no rows raises GuardError. Every ``refresh`` rounds the rows are stored anew with their predictions."""
    if loss not in ("median", "log_loss"):
        raise GuardError(f"loss {loss}")
    width, k = len(features), 1 if loss == "median" else classes
    given = df.filter(F.col(target).isNotNull())
    if loss == "median":
        base = [given.agg(F.percentile_approx(F.col(target).cast("double"), 0.5, 10_000)).head()[0]]
        if base[0] is None:
            raise GuardError("no rows to fit")
    else:
        base = [log_share(s) for s in class_shares(given, target, classes, weight)]
    cuts = feature_cuts(given, features, bins)
    rows = stored(binned_rows(given, features, target, weight, cuts, base), "boosting")
    grown: list[list[GrownTree]] = []
    since: list[list[GrownTree]] = []
    for _ in range(iterations):
        trees = _round(rows, loss, width, since, k, leaves, depth, least_rows, l2, rate)
        if loss == "median":
            medians = _leaf_medians(rows, width, since, trees[0])
            trees[0].value = [rate * medians.get(n, 0.0) if f < 0 else 0.0 for n, f in enumerate(trees[0].feature)]
        grown.append(trees)
        since.append(trees)
        if len(since) == refresh:
            rows, since = _advanced(rows, width, since), []
    return _node_table(df, "size" if loss == "median" else "direction", base, grown, cuts)


def _round(rows: DataFrame, loss: str, width: int, since, k: int, leaves: int, depth: int, least_rows: int, l2: float, rate: float) -> list[GrownTree]:
    """The trees of one round, grown level by level; the driver sees one row a node."""
    trees, at = [GrownTree.stump() for _ in range(k)], [[0] for _ in range(k)]
    n_leaves = [1] * k
    for level in range(depth):
        if not any(at):
            break
        found = best_splits(level_sums(rows, loss, width, since, trees, at), l2, least_rows).collect()
        following: list[list[int]] = [[] for _ in range(k)]
        for r in sorted(found, key=lambda r: (r["class"], -(r["gain"] or 0), r["node"])):
            c, node = r["class"], r["node"]
            if level == 0:
                trees[c].value[node] = -rate * r["g"] / (r["h"] + l2 * UNIT)
            if r["gain"] is None or n_leaves[c] >= leaves:
                continue
            n_leaves[c] += 1
            left, right = trees[c].split(node, r["feature"], r["bin"], r["missing_left"])
            trees[c].value[left] = -rate * r["g_left"] / (r["h_left"] + l2 * UNIT)
            trees[c].value[right] = -rate * (r["g"] - r["g_left"]) / (r["h"] - r["h_left"] + l2 * UNIT)
            following[c] += [n for n, size in ((left, r["n_left"]), (right, r["n"] - r["n_left"])) if size >= 2 * least_rows]
        at = [sorted(f) if n < leaves else [] for f, n in zip(following, n_leaves, strict=True)]
    return trees


def _node_table(df: DataFrame, head: str, base: Sequence[float], grown: Sequence[Sequence[GrownTree]], cuts: Sequence[np.ndarray]) -> DataFrame:
    out = [(head, -1, c, 0, True, float(v), None, None, None, None, None) for c, v in enumerate(base)]
    for i, trees in enumerate(grown):
        for c, t in enumerate(trees):
            for n, f in enumerate(t.feature):
                if f < 0:
                    out.append((head, i, c, n, True, float(t.value[n]), None, None, None, None, None))
                else:
                    limit = float(cuts[f][t.bin[n]]) if t.bin[n] < len(cuts[f]) else FINITE
                    out.append((head, i, c, n, False, None, f, limit, bool(t.missing_left[n]), t.left[n], t.right[n]))
    return df.sparkSession.createDataFrame(out, NODE_SCHEMA)


def fit_experts(df: DataFrame, features: dict[str, list[str]], target: str, label: str, regime: str = "regime", weight: str | None = None, iterations: dict[str, tuple[int, int]] | int = 100, classes: int = 3, **how) -> DataFrame:
    """Nodes (regime, ...) of both heads of every regime: what ``score``, ``model_documents`` and ``staged_scores`` take.

    ``iterations``: rounds of the direction and the size head by regime, or one number for all. Rows whose target or
    label is missing don't count for that head."""
    out = None
    for r, own in features.items():
        part = stored(df.filter(F.col(regime) == r), "experts")
        n_direction, n_size = iterations[r] if isinstance(iterations, dict) else (iterations, iterations)
        heads = fit_boosted(part, own, target, "median", iterations=n_size, **how).unionByName(fit_boosted(part, own, label, "log_loss", classes, weight, n_direction, **how))
        heads = heads.select(F.lit(r).alias("regime"), "*")
        out = heads if out is None else out.unionByName(heads)
    return out
