"""Exact quantiles against numpy, whatever the brackets hold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from callquality.operators import quantiles as Q


@pytest.mark.parametrize(("accuracy", "whole"), [(10_000, 10), (200, 0), (50, 0)])
def test_against_numpy(spark, monkeypatch, accuracy, whole):
    monkeypatch.setattr(Q, "WHOLE", whole)
    rnd = np.random.default_rng(3)
    groups = {"normal": rnd.normal(size=3000), "ties": rnd.integers(0, 3, 3000).astype(float), "heavy": np.exp(rnd.normal(size=3000) * 40), "same": np.full(2000, 7.5), "few": np.array([4.0, -1.0, 2.5]), "one": np.array([9.0])}
    if not whole:  # a bracket of a sketch needs groups of some size, which WHOLE sees to
        groups = {k: v for k, v in groups.items() if len(v) > 100}
    rows = [(None if g == "ties" else g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None)]
    shares = [0.0, 0.01, 0.25, 0.5, 0.777, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: (r["a"], r["b"]) for r in Q.exact_quantiles(df, ["g"], {"a": "v", "b": -F.col("v")}, shares, accuracy).collect()}
    assert set(got) == {None if g == "ties" else g for g in groups}
    for g, vs in groups.items():
        a, b = got[None if g == "ties" else g]
        assert np.allclose(a, np.quantile(vs, shares), rtol=1e-12) and np.allclose(b, np.quantile(-vs, shares), rtol=1e-12)


def test_edges(spark):
    df = spark.createDataFrame([(1, 1.0), (1, math.nan), (2, None)], "g int, v double")
    rows = Q.with_quantiles(df.groupBy("g").agg(F.count("*").alias("n")), df, ["g"], {"q": "v"}, [0.0, 1.0]).orderBy("g").collect()
    assert rows[0]["q"][0] == 1.0 and math.isnan(rows[0]["q"][1]) and rows[1]["q"] is None
    assert Q.exact_quantiles(df.limit(0), [], {"q": "v"}, [0.5]).head()["q"] is None and Q.exact_quantiles(df.limit(0), ["g"], {"q": "v"}, [0.5]).count() == 0
    assert Q.exact_quantiles(df.filter("v = 1"), [], {"q": "v"}, [0.5]).head()["q"] == [1.0]


def test_no_group_is_sorted_whole(spark):
    plan = Q.exact_quantiles(spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v")), ["g"], {"q": "v"}, [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan and "collect_list(struct(_j" in plan
