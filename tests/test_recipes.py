"""Rows and fits of training recipes, and parity and early-warning reports on odd tables."""

import pytest
from pyspark.sql import functions as F

from callquality.operators import joins, metrics, ml, recipes
from callquality.operators.joins import GuardError
from callquality.operators.recipes import Recipe


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(k, "ab"[k % 2], f"p{k % 11}", float(k % 7), float(k % 5), float(k % 7 > 3) + 0.1 * (k % 3), (k % 7 > 3) * (1 + k % 3 % 2), k % 11 == 0, k % 3 > 0, None if k % 17 == 0 else k % 4 > 0, k % 6 if k % 6 > 2 else None) for k in range(600)]
    return spark.createDataFrame(rows, "id int, regime string, person string, x double, z double, t double, dir_code int, calibration boolean, representative boolean, variant boolean, bin int").cache()


def of(found, head):
    return found.filter(F.col("head") == head)


def test_rows_by_head(spark, pool):
    found = recipes.recipe_rows(pool, Recipe(100, ["z"], balance="bin"), ["id"]).cache()
    assert {(r["head"], r["regime"]): r["count"] for r in found.groupBy("head", "regime").count().collect()} == {("direction", "a"): 100, ("direction", "b"): 100, ("size", "a"): 100, ("size", "b"): 100, ("calibration", "a"): 18, ("calibration", "b"): 18}
    assert of(found, "size").join(of(found, "direction"), "id", "left_anti").isEmpty() and found.filter("(head = 'calibration') <> calibration OR head = 'calibration' AND NOT representative").isEmpty()
    sums = of(found, "direction").filter("bin IS NOT NULL AND dir_code > 0").groupBy("regime", "bin").pivot("dir_code", [1, 2]).agg(F.sum("weight")).collect()
    assert sums and all(abs(r["1"] - r["2"]) < 1e-9 for r in sums if r["1"] and r["2"]) and of(found, "direction").filter("(bin IS NULL OR dir_code = 0) AND weight <> 1").isEmpty()
    mixed = recipes.recipe_rows(pool, Recipe(60, ["z"], 25), ["id"], pool.filter("variant"))
    assert sorted((r["regime"], r["head"], r["v"], r["count"]) for r in mixed.filter("head <> 'calibration'").groupBy("regime", "head", F.coalesce("variant", F.lit(False)).alias("v")).count().collect()) == [
        x for r, n in (("a", 25), ("b", 16)) for x in ((r, "direction", False, n), (r, "direction", True, 60), (r, "size", True, 60))
    ]
    with pytest.raises(GuardError):
        recipes.recipe_rows(pool, Recipe(60, ["z"], 25), ["id"])
    assert recipes.recipe_rows(pool.limit(0), Recipe(60, ["z"], balance="bin"), ["id"]).isEmpty()


def test_fits_by_regime(spark, pool):
    rows = recipes.recipe_rows(pool, Recipe(150, ["z"], balance="bin"), ["id"])
    found = ml.fit_regimes(rows, ["a", "b"], lambda part: recipes.fit_recipe(part, ["x", "z"], "t", "dir_code", "person"))
    assert {k["class"] for k in found["a"]["knots"].select("class").distinct().collect()} == {0, 1, 2}
    scored = ml.with_predictions(pool.filter("regime = 'b'"), ["x", "z"], found["b"]["median"], found["b"]["direction"])
    assert scored.agg(F.avg(((F.col("p_0") > 0.5) == (F.col("dir_code") == 0)).cast("double"))).head()[0] > 0.95


def test_parity_of_odd_extractions(spark):
    left = spark.createDataFrame([("p", "L1", 1, 1.0, "u"), ("p", "L2", 1, float("nan"), "u"), ("q", "L1", 1, 2.0, None), ("r", "L9", 1, 5.0, None), (None, "L1", 1, 1.0, None)], "person string, locus string, rank int, v double, only_left string")
    right = spark.createDataFrame([("p", "L1", 1, 1), ("p", "L2", 1, None), ("q", "L1", 1, 2), ("r", "L9", 1, 6), ("s", "L1", 2, 0)], "person string, locus string, rank long, v int")
    chosen = spark.createDataFrame([("L1",), ("L2",), ("L1",)], "locus string")
    found, groups = joins.parity(left, right, ["locus", "rank"], "person", "locus", chosen)
    assert sorted((r["person"] or "", r["locus"], r["field"], r["left"], r["right"]) for r in found.collect()) == [("", "L1", "row", "present", None), ("p", "L1", "only_left", "u", None), ("p", "L2", "only_left", "u", None), ("s", "L1", "row", None, "present")]
    assert {r["person"]: tuple(r)[1:] for r in groups.collect()} == {"p": (2, 2, 2, True), "q": (1, 1, 0, False), "s": (0, 1, 1, True), None: (1, 0, 1, True)}
    found, groups = joins.parity(left.limit(0), right.limit(0), ["locus", "rank"], "person")
    assert found.isEmpty() and groups.isEmpty()


def test_early_warning_without_misses_or_sex(spark):
    rows = [("s1", 0.9, True, False, True, False), ("s1", 0.2, True, True, True, True), ("s2", 0.7, True, False, False, None), ("s3", 0.1, False, False, True, True)]
    df = spark.createDataFrame(rows, "sample string, p_ok double, reference_call boolean, miss boolean, single boolean, on_sex boolean")
    groups, recall, means = metrics.early_warning_report(df, "sample", F.col("on_sex"), (0.5,))
    assert {r["sample"]: (r["sex"], r["n_reference_calls"], r["n_misses"], r["auc"], r["share_below_half"]) for r in groups.collect()} == {"s1": ("male", 2, 1, 1.0, 0.5), "s2": ("female", 1, 0, None, 0.0), "s3": ("male", 0, 0, None, 1.0)}
    assert means.head()[:] == (3, 1, 1.0, 0.5)
    assert {r["subset"]: r["recall"] for r in recall.collect()} == {"all": 1.0, "off_sex_chromosomes": None, "male": 1.0, "female": None}
