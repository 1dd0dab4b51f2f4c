"""Connected groups against union-find, with hubs, chains and odd edges."""

import random

import pytest
from pyspark.sql import functions as F

from callquality.operators import components as C
from callquality.operators.joins import GuardError


def plain(edges):
    low = {}

    def find(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            low[max(x, y)] = min(x, y)
    return {x: find(x) for x in low}


@pytest.mark.parametrize("least_hub", [3, 100_000])
def test_random_graphs_with_hubs(spark, least_hub):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(7, k) for k in range(400, 600)] + [(k, 999) for k in range(600, 700)] + [(7, 7), (None, 3), (5, None)]
    df = spark.createDataFrame(edges + edges[:50], "a long, b long")
    got = [(r["node"], r["group"]) for r in C.components(df, least_hub=least_hub).collect()]
    assert dict(got) == plain(edges) and len(got) == len(dict(got))


def test_hubs_are_not_shuffled_by_key(spark):
    ends = spark.range(5000).select(F.lit(0).cast("long").alias("u"), (F.col("id") + 1).alias("v"))
    plan = C._with_least(ends, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert {r["m"] for r in C._with_least(ends, 10).collect()} == {0}


def test_chain_in_few_rounds(spark):
    n = 1000
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = C.components(edges, most_rounds=10)
    assert found.agg(F.count("*"), F.max("group"), F.count_distinct("node")).head()[:] == (n, 0, n)
    with pytest.raises(GuardError):
        C.components(edges, most_rounds=2)


def test_empty_texts_nulls_and_repeats(spark):
    nodes = spark.createDataFrame([("b", 1), ("c", 2), ("c", 3), ("z", 4), (None, 5)], "k string, n int")
    none = spark.createDataFrame([], "a string, b string")
    assert {r["n"]: r["group"] for r in C.linked_groups(nodes, none, "k").collect()} == {1: "b", 2: "c", 3: "c", 4: "z", 5: None}
    edges = spark.createDataFrame([("c", "x"), ("x", "b"), (None, "z")], "a string, b string")
    assert {r["n"]: r["group"] for r in C.linked_groups(nodes, edges, "k").collect()} == {1: "b", 2: "b", 3: "b", 4: "z", 5: None}
    assert C.linked_groups(nodes.limit(0), edges, "k").count() == 0
