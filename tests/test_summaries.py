"""States of parts merge to that of the whole; kept summaries survive batches that are run again."""

import bisect
import math

import pytest
from pyspark.sql import functions as F

from callquality.operators import summaries as S
from callquality.operators.joins import GuardError
from callquality.streaming import streams

SUMMARY = S.Summary({"n": "1", "total": "v"}, {"ids": "id"}, {"values": "x"})


def data(spark, n=60_000):
    x = F.when(F.col("id") % 1000 == 0, F.lit(None)).when(F.col("id") % 1001 == 1, F.lit(float("nan"))).otherwise(F.pow((F.col("id") * 7919) % 10_007, 2).cast("double"))
    return spark.range(n).select((F.col("id") % 3).alias("g"), (F.col("id") % 20_000).alias("id"), F.col("id").alias("v"), x.alias("x"), (F.col("id") % 5).cast("int").alias("part"))


def near(values, got, share):
    low, high = bisect.bisect_left(values, got) / len(values), bisect.bisect_right(values, got) / len(values)
    return low - 2 * S.rank_bound() <= share <= high + 2 * S.rank_bound()


def test_parts_merge_and_roll_up(spark):
    df = data(spark)
    parts = S.state_of(df, ["g", "part"], SUMMARY)
    for by in (["g"], []):
        got = S.told(S.merged(parts, by, SUMMARY), SUMMARY, (0.1, 0.5, 0.99)).collect()
        want = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.count_distinct("id").alias("ids"), F.collect_list(F.nullif("x", F.lit(float("nan")))).alias("x")).collect()
        key = lambda r: r["g"] if by else 0
        for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert (a["n"], a["total"]) == (b["n"], b["total"]) and abs(a["ids"] - b["ids"]) < 0.04 * b["ids"]
            assert all(near(sorted(b["x"]), v, s) for v, s in zip(a["values"], (0.1, 0.5, 0.99), strict=True))


def test_groups_without_values_and_empty_tables(spark):
    df = data(spark, 9).withColumns({"x": F.when(F.col("g") == 0, F.lit(None)).otherwise(F.col("x")), "id": F.when(F.col("g") > 0, F.col("id"))})
    got = {r["g"]: r for r in S.told(S.merged(S.state_of(df, ["g"], SUMMARY), ["g"], SUMMARY), SUMMARY).collect()}
    assert got[0]["values"] is None and got[0]["ids"] == 0 and got[1]["ids"] == 3 and not any(math.isnan(v) for v in got[2]["values"])
    assert S.told(S.state_of(df.limit(0), ["g"], SUMMARY), SUMMARY).count() == 0


def test_kept_summary_of_a_stream(spark, tmp_path):
    src, root, schema = str(tmp_path / "in"), str(tmp_path / "kept"), "g long, id long, v long, x double, part int"
    df = data(spark, 5000)
    with pytest.raises(GuardError):
        streams.kept_summary(spark, root)
    keep = lambda cp="cp": streams.keep_summary(streams.arriving(spark, src, schema, files_per_batch=1), root, str(tmp_path / cp), ["g"], SUMMARY).awaitTermination()
    for part in range(5):
        df.filter(F.col("part") == part).coalesce(1).write.mode("append").parquet(src)
        keep()
        if part == 1:
            held = S.told(streams.kept_summary(spark, root), SUMMARY)
        if part == 3:  # batch 3 finished but its commit was lost: it runs again
            (tmp_path / "cp" / "commits" / "3").unlink()
            crc = tmp_path / "cp" / "commits" / ".3.crc"
            crc.unlink(missing_ok=True)
            assert held.agg(F.sum("n")).head()[0] == 2000
    got = S.told(streams.kept_summary(spark, root), SUMMARY).select("g", "n", "total").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, df.groupBy("g").agg(F.count("*"), F.sum("v")).collect()))
    with pytest.raises(Exception, match="another stream"):
        keep("cp2")
