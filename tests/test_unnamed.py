"""Operators that no query compares: rows and contents of small cases."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from callquality.operators import categories as C
from callquality.operators import jobs, ml, scoring
from callquality.operators.joins import GuardError
from callquality.plans import job_queries
from callquality.sources import io, merges

NODES = "regime string, head string, iter int, class int, node_id int, is_leaf boolean, value double, feature int, threshold double, missing_left boolean, `left` int, `right` int"


def stump(regime, limit, low=0.1, high=0.3):
    return [(regime, "size", 0, 0, 0, False, None, 0, limit, True, 1, 2), (regime, "size", 0, 0, 1, True, low, None, None, None, None, None), (regime, "size", 0, 0, 2, True, high, None, None, None, None, None)]


def test_last_version(spark, tmp_path):
    (tmp_path / "a.log").write_text("tool v1.0 v1.5\nnothing\ntool v2.1\nend\n")
    (tmp_path / "b.log").write_text("no version\n")
    found = {r["source_file"].rpartition("/")[2]: r["version"] for r in io.last_version(spark, str(tmp_path), r"v([0-9.]+)").collect()}
    assert found == {"a.log": "2.1"}


def test_parts_lines_and_catalogs(spark, tmp_path):
    for name, v in (("s1", 1), ("s2", 2)):
        spark.createDataFrame([(v,)], "v int").coalesce(1).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    assert sorted((r["individual"], r["v"]) for r in io.read_parts(spark, str(tmp_path)).collect()) == [("s1", 1), ("s2", 2)]
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    io.write_lines(df, str(tmp_path / "lines"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "lines"))
    assert back.columns == ["k", "v"] and sorted((r["k"], r["v"]) for r in back.collect()) == [("a", "1"), ("b", None)]
    io.write_catalog(df, str(tmp_path / "catalog"), "k", "v")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "catalog")).collect()) == ['{"k":"a","v":1}', '{"k":"b"}']


def test_call_lines_and_registry(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"SampleId": "S", "Locus": {"LocusId": "a", "ReadLength": 150, "Variants": {"a": {"Genotype": "1/2"}}}}\n{"SampleId": "T", "Locus": {"LocusId": "b"}}\n')
    rows = io.read_call_lines(spark, str(tmp_path / "x.jsonl")).orderBy("sample_id").collect()
    assert [(r["sample_id"], r["locus"]["LocusId"], r["locus"]["ReadLength"]) for r in rows] == [("S", "a", 150.0), ("T", "b", None)]
    assert io.registry(spark, [("s", "t", "l", "r", "p")]).head().asDict() == {"source": "s", "truth": "t", "label": "l", "role": "r", "path": "p"}


def test_known_entities(spark, tmp_path):
    (tmp_path / "k.tsv").write_text("locus\tunit\tref\tlow\nchr4:101-120\tCAG CCG\tCAG\t36\nX:5-9\t\tGAA\tn/a\n")
    got = {r["chrom"]: (r["start"], r["end"], r["expanded_motif"], r["low"]) for r in io.read_known_entities(spark, str(tmp_path / "k.tsv"), "locus", "unit", "ref", ["low"]).collect()}
    assert sorted(got.values()) == [(4, 9, "GAA", None), (100, 120, "CAG", 36.0)]


def test_fresh_and_population_guards(spark):
    day = lambda n: datetime.datetime(2020, 1, n)
    up = spark.createDataFrame([("a", day(1)), ("b", day(5))], "k string, modified timestamp")
    io.require_fresh(up, spark.createDataFrame([("a", day(2)), ("b", day(5))], "k string, modified timestamp"), "k")
    with pytest.raises(GuardError, match="b is older"):
        io.require_fresh(up, spark.createDataFrame([("a", day(2)), ("b", day(4))], "k string, modified timestamp"), "k")
    whole = spark.createDataFrame([], "keep_probability double, variant boolean, in_pool boolean, representative boolean")
    io.require_population(whole.schema)
    with pytest.raises(GuardError, match="in_pool"):
        io.require_population(whole.drop("in_pool").schema, "pool")


def test_combined_experts_and_parity(spark):
    first, second = (spark.createDataFrame(stump("a", v) + stump("b", v), NODES) for v in (1.0, 2.0))
    names = spark.createDataFrame([("full", 0, "x")], "branch string, pos int, name string")
    both = scoring.combine_experts(first, second, ["a"], names, names)
    assert {(r["regime"], r["threshold"]) for r in both.filter("NOT is_leaf").collect()} == {("a", 1.0), ("b", 2.0)}
    with pytest.raises(GuardError, match="different features"):
        scoring.combine_experts(first, second, ["a"], names, names.withColumn("name", F.lit("y")))
    a = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.25, 2.0)], "id int, p double, q double")
    found = {r["column"]: (r["worst"], r["agree"]) for r in scoring.prediction_parity(a, a.withColumn("q", F.col("q") + 0.5), ["id"], ["p", "q"]).collect()}
    assert found == {"p": (0.0, True), "q": (0.5, False)}
    assert not scoring.prediction_parity(a, a.limit(0), ["id"], ["p"]).head()["agree"]


def test_infinite_thresholds_are_clamped(spark):
    nodes = spark.createDataFrame(stump("r", math.inf), NODES)
    tree = scoring.compile_model(nodes)["r", "size"][0]
    assert tree[4][0] == scoring.FINITE
    scored = scoring.score(spark.createDataFrame([("r", 1e300), ("r", math.nan), ("r", None)], "regime string, x double"), nodes, spark.createDataFrame([], "regime string, class int, i int, x double, y double"), {"r": ["x"]})
    assert {round(r["factor"], 3) for r in scored.collect()} == {round(math.exp(0.1), 3)}
    with pytest.raises(GuardError, match="NaN"):
        scoring.compile_model(spark.createDataFrame(stump("r", math.nan), NODES))


def test_heads_by_regime(spark):
    rows = [(k, f"p{k % 9}", "ab"[k % 2], float(k % 7), float(k % 5), float(k % 7 > 3) + 0.1 * (k % 3), int(k % 7 > 3)) for k in range(240)]
    df = spark.createDataFrame(rows, "id int, person string, regime string, x double, z double, t double, y int").cache()
    fit = lambda part: ml.fit_heads(part, ["x", "z"], "t", "y", "person", ["z"], ["id"], cap=90)
    found = ml.fit_regimes(df, ["a", "b"], fit)
    assert set(found) == {"a", "b"} and set(found["a"]) == {"direction", "median", "knots"}
    scored = ml.with_predictions(df.filter("regime = 'a'"), ["x", "z"], found["a"]["median"], found["a"]["direction"])
    right = scored.agg(F.avg(((F.col("p_1") > 0.5) == (F.col("y") == 1)).cast("double")), F.avg(F.when(F.col("y") == 1, F.abs(F.col("t") - F.col("t_predicted"))))).head()  # the size head learns where the gate fires
    assert right[0] > 0.95 and right[1] < 0.3


def test_distinguishability(spark):
    make = lambda shift: spark.createDataFrame([(f"g{k % 12}", float(k % 10) + shift, float(k % 3)) for k in range(120)], "g string, x double, z double")
    assert ml.distinguishability(make(0), make(20), ["x", "z"], "g", folds=2).head()["auc"] > 0.99
    assert 0.3 < ml.distinguishability(make(0), make(0), ["x", "z"], "g", folds=2).head()["auc"] < 0.7


def test_merge_guards_and_skip(spark, tmp_path):
    schema = "source string, locus_id int, rk int, motif_size int, variant_locus boolean, genotyping_branch string, v int, pos long"
    here = spark.createDataFrame([("s", 1, 10, 1, True, "full", 0, 0), ("s", 2, 20, 2, True, "full", 0, 1), ("s", 3, 30, 1, False, "full", 0, 2), ("t", 1, 10, 1, True, "quick", 0, 0)], schema)
    there = spark.createDataFrame([("s", 1, 10, 1, True, "quick", 5, 0), ("s", 1, 11, 1, True, "quick", 6, 1), ("s", 2, 20, 2, True, "quick", 7, 2), ("t", 1, 10, 1, True, "quick", 8, 0)], schema)
    root = str(tmp_path / "merged")
    merge = lambda a, b: merges.merge_runs(spark, root, a, b, "source", "locus_id", ["rk"], "pos")
    rows, summary = merge(here, there)
    assert [tuple(r) for r in rows.orderBy("source", "place_at", "place_then").select("source", "locus_id", "rk", "v").collect()] == [("s", 1, 10, 5), ("s", 1, 11, 6), ("s", 2, 20, 0), ("t", 1, 10, 0)]
    told = {(r["source"], r["what"]): r["n"] for r in summary.collect()}
    assert told == {("s", "rows here"): 3, ("s", "rows merged"): 3, ("s", "entities replaced"): 1, ("s", "entities other_branch"): 1, ("s", "entities dropped"): 1, ("t", "rows here"): 1, ("t", "rows merged"): 1, ("t", "entities kept"): 1, ("t", "compared"): 1, ("t", "differing"): 1, ("t", "differing v"): 1}
    runs = lambda: {r["part_key"]: r["run"] for r in spark.read.parquet(f"{root}/manifest").orderBy("run").collect()}
    before = runs()
    merge(here.repartition(2), there)
    assert runs() == before  # the same rows in another order: nothing is built
    merge(here, there.withColumn("v", F.when(F.col("source") == "t", 9).otherwise(F.col("v"))))
    after = runs()
    assert after["s"] == before["s"] and after["t"] != before["t"]
    with pytest.raises(GuardError, match="two branches"):
        merge(here.unionByName(here.filter("rk = 10").withColumn("genotyping_branch", F.lit("quick"))), there)
    with pytest.raises(GuardError, match="missing from a run"):
        merge(here.filter("source = 't' OR locus_id <> 1"), there)
    with pytest.raises(GuardError, match="different columns"):
        merge(here, there.drop("v"))


def test_repeated_line_of_a_reference_is_the_first_in_the_table(spark, tmp_path):
    (tmp_path / "lineitem.parquet").mkdir()
    line = lambda n, of: spark.range(n).selectExpr("id AS l_orderkey", f"{of} AS l_partkey", f"{of} AS l_suppkey", "1 AS l_linenumber", f"{of} / 100D AS l_tax").coalesce(1).toPandas()
    for name, n, of in (("a", 1, 2), ("b", 5000, 4)):  # Spark reads the larger file first
        line(n, of).to_parquet(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    spark.range(2).selectExpr("id AS o_orderkey", "'F' AS o_orderstatus").write.parquet(str(tmp_path / "orders.parquet"))
    assert {r["id"]: r["purity"] for r in job_queries.reference_table(spark, str(tmp_path)).collect()} == {0: 0.02, 1: 0.04}


def test_all_variants_are_categorised_in_one_shuffle(spark):
    rnd = np.random.default_rng(7)
    some = lambda values: [None if rnd.random() < 0.1 else float(x) for x in rnd.choice(values, 300)]
    entities = [None if e == 0 else int(e) for e in rnd.integers(0, 60, 300)]
    data = list(zip(entities, [str(o) for o in rnd.permutation(300)], some([5, 9, 25, 40, math.nan]), some([5, 25, 26, 60]), some([0.5, 1, 1.3]), some([0.2, 0.8]), strict=True))
    df = spark.createDataFrame(data, "e int, o string, c double, t double, f double, p double").withColumn("r", F.lit(25.0))
    variants = {"raw": (None, None), "gated": (F.col("f"), F.col("p")), "always": (F.col("f"), F.lit(0.0))}
    made = jobs.all_categories(df, variants, ["e"], ["o"], "c", "t", "r")
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = sorted(str(tuple(r)) for r in made.collect())
    single = lambda f, p: C.corrected_categories(df.withColumns({"_f": F.lit(None).cast("double") if f is None else f, "_p": F.lit(None).cast("double") if p is None else p}), ["e"], ["o"], "c", "t", "r", "_f", "_p")
    want = [single(*v).withColumn("variant", F.lit(name)).select(made.columns).collect() for name, v in variants.items()]
    assert got == sorted(str(tuple(r)) for part in want for r in part) and len(got) == 3 * sum(e is not None for e in entities)
