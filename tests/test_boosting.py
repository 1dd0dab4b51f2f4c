"""Boosted trees: splits by brute force, losses against the heads of Spark ML, documents, and reproducible fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callquality.operators import boosting as B
from callquality.operators import ml, scoring
from callquality.operators.joins import GuardError
from callquality.sources.models import model_documents, model_tables

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rnd = np.random.default_rng(0)
    n = 2400
    a, b, c = rnd.normal(size=n), rnd.normal(size=n), rnd.integers(0, 5, n).astype(float)
    t = np.where(a > 0.3, 1.5, 0) + 0.5 * b + 0.2 * c * (b > 0) + rnd.normal(size=n) * 0.3
    gone = rnd.random(n) < 0.15
    t = np.where(gone, 2.5, t)
    y = (t > 1).astype(int) + (t > 2)
    rows = [(k, None if gone[k] else float(a[k]), float(b[k]), float("nan") if k % 50 == 0 else float(c[k]), float(t[k]), int(y[k]), 1.0 + k % 3) for k in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, t double, y int, w double").withColumn("regime", F.lit("r")).repartition(3).cache()


def test_first_split_by_brute_force(spark, table):
    cuts = B.feature_cuts(table, FEATURES, bins=16)
    assert all(len(c) <= 15 and (np.diff(c) > 0).all() for c in cuts)
    base = [B.log_share(s) for s in B.class_shares(table, "y", 3, "w")]
    rows = B.binned_rows(table, FEATURES, "y", "w", cuts, base)
    found = {r["class"]: r for r in B.best_splits(B.level_sums(rows, "log_loss", 3, [], [B.GrownTree.stump()] * 3, [[0]] * 3), 1.0, 50).collect()}
    local = table.toPandas()
    bins = B.binned(local[FEATURES].to_numpy(float), cuts)
    w, y = local["w"].to_numpy(), local["y"].to_numpy()
    p = np.exp(base) / np.exp(base).sum()
    for k in range(3):
        g, h = np.rint((p[k] - (y == k)) * w * B.UNIT) / B.UNIT, np.rint(p[k] * (1 - p[k]) * w * B.UNIT) / B.UNIT
        best = (0, None)
        for f in range(3):
            for b in range(len(cuts[f]) + 1):
                for side in (True, False):
                    left = np.where(bins[:, f] == 255, side, bins[:, f] <= b)
                    if 50 <= left.sum() <= len(w) - 50 and (side or (bins[:, f] == 255).any()):
                        gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                        best = max(best, (round(gain, 6), (f, b, side, int(left.sum()))), key=lambda x: x[0])
        r = found[k]
        assert (round(r["gain"], 6), (r["feature"], r["bin"], r["missing_left"], r["n_left"])) == best and r["n"] == len(w)


def test_fit_document_score(spark, table):
    train, test = table.filter("id % 4 <> 0"), table.filter("id % 4 = 0")
    nodes = B.fit_experts(train, {"r": FEATURES}, "t", "y", weight="w", iterations={"r": (6, 6)}, rate=0.5, least_rows=20, depth=3, refresh=4).cache()
    knots = spark.createDataFrame([], "regime string, class int, i int, x double, y double")
    scored = scoring.score(test, nodes, knots, {"r": FEATURES}).orderBy("id").toPandas()
    again = scoring.score(test, *model_tables(model_documents(nodes, knots)), {"r": FEATURES}).orderBy("id").toPandas()
    assert scored.equals(again)
    chances = scored[["p_0", "p_1", "p_2"]].to_numpy()
    loss = -np.log(np.maximum(chances[np.arange(len(scored)), scored["y"]], 1e-3)).mean()
    off = np.abs(scored["t"] - np.log(scored["factor"])).mean()
    heads = (ml.fit_median(train.filter("NOT isnan(c)"), FEATURES, "t", iterations=6, depth=3), ml.fit_direction(train.filter("NOT isnan(c)"), FEATURES, "y", "w", trees=6, depth=3))
    old = ml.with_predictions(test.filter("NOT isnan(c)"), FEATURES, *heads).toPandas()
    old_loss = -np.log(np.maximum(old[["p_0", "p_1", "p_2"]].to_numpy()[np.arange(len(old)), old["y"]], 1e-3)).mean()
    assert off <= np.abs(old["t"] - old["t_predicted"]).mean() and loss <= old_loss
    same = B.fit_experts(train.repartition(7), {"r": FEATURES}, "t", "y", weight="w", iterations={"r": (1, 1)}, rate=0.5, least_rows=20, depth=3).orderBy("head", "iter", "class", "node_id")
    first = nodes.filter("iter < 1").orderBy("head", "iter", "class", "node_id")
    assert same.filter("head = 'direction'").collect() == first.filter("head = 'direction'").collect()


def test_guards_and_limits(spark, table):
    with pytest.raises(GuardError, match="no rows"):
        B.fit_boosted(table.limit(0), FEATURES, "t")
    with pytest.raises(GuardError, match="labels are not"):
        B.fit_boosted(table.withColumn("y", F.lit(7)), FEATURES, "y", "log_loss")
    with pytest.raises(GuardError, match="loss"):
        B.fit_boosted(table, FEATURES, "y", "other")
    nodes = B.fit_boosted(table, FEATURES, "y", "log_loss", iterations=1, leaves=3, depth=6, least_rows=10)
    leaves = nodes.filter("iter = 0 AND is_leaf").groupBy("class").count().collect()
    assert [r["count"] for r in leaves] == [3, 3, 3]
    alone = B.fit_boosted(table, FEATURES, "y", "log_loss", iterations=1, least_rows=2000).filter("iter = 0").collect()
    assert len(alone) == 3 and all(r["is_leaf"] for r in alone)
