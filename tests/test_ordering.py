"""Counts along an order against brute force, over any number of tasks."""

import random

import pytest
from pyspark.sql import functions as F

from callquality.operators import ordering as O


@pytest.mark.parametrize("tasks", ["1", "7"])
def test_ranks_and_counts(spark, monkeypatch, tasks):
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1.0, 2.0, 2.5, None]), k, rnd.random() < 0.7, rnd.randrange(5), rnd.randrange(6)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, id int, p boolean, d int, ask int").repartition(3)
    sort = lambda r: (r[1] is not None, r[1] or 0, r[2])
    got = {r["id"]: (r["rank"], r["n"], r["m"]) for r in O.counted_before(O.counted_before(O.ranks(df, ["g"], ["v", "id"]), ["g"], ["v", "id"], F.col("p"), "n", F.col("d"), F.col("ask"), fan=5), [], ["id"], F.col("p"), "m").collect()}
    for r in rows:
        before = [x for x in rows if x[0] == r[0] and sort(x) < sort(r)]
        assert got[r[2]] == (len(before), sum(x[3] and x[4] < r[5] for x in before), sum(x[3] and x[2] < r[2] for x in rows)), r
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_similar_percentiles(spark, monkeypatch):
    monkeypatch.setattr(O, "FAN", 4)
    rnd = random.Random(5)
    rows = [(k, rnd.choice(["x", "x", "x", "y", None]), rnd.choice([0.0, -1.0, None, 10.0]) if k % 9 == 0 else rnd.choice([1.0, 4.0, 5.0, rnd.uniform(1, 60)]), rnd.choice([None, 1.0, 2.0, rnd.random() * 3])) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, s double, v double").repartition(4)
    got = {r["id"]: (r["n"], None if r["percentile"] is None else round(r["percentile"], 9)) for r in O.similar_percentiles(df, df.filter("id % 3 = 0"), "id", "g", "s", "v", 1.25, least=5).collect()}
    want = {}
    for k, g, s, v in rows:
        if k % 3 or g is None or s is None or s <= 0:
            continue
        near = [r for r in rows if r[1] == g and r[2] is not None and r[2] > 0 and s / 1.25 <= r[2] <= s * 1.25]
        some = [r[3] for r in near if r[3] is not None]
        if near:
            want[k] = (len(near), round(100 * sum(x < v for x in some) / len(some), 9) if len(near) >= 5 and v is not None and some else None)
    assert got == want
    assert O.similar_percentiles(df.limit(0), df, "id", "g", "s", "v", 1.25).count() == 0


def test_no_pairs_of_one_class(spark, monkeypatch):
    """A class where all rows are similar: what is shuffled grows with the rows, not with their pairs."""
    written = []
    keep = O.stored
    monkeypatch.setattr(O, "stored", lambda df, label: written.append(keep(df, label)) or written[-1])
    n = 2000
    df = spark.range(n).select("id", F.lit("x").alias("g"), F.lit(5.0).alias("s"), (F.col("id") * 7919 % n).cast("double").alias("v"))
    got = O.similar_percentiles(df, df, "id", "g", "s", "v", 1.25).agg(F.count("*"), F.min("n"), F.max("n"), F.sum("percentile")).head()
    assert tuple(got)[:3] == (n, n, n) and abs(got[3] - 100 * (n - 1) / 2) < 1e-6
    assert max(t.count() for t in written) <= 13 * n
