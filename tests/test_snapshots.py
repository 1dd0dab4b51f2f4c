"""Published versions: what is rebuilt, what a failed publisher leaves, what readers see; and pruned scans."""

import pytest
from pyspark.sql import functions as F

from callquality.operators.joins import GuardError
from callquality.sources import io
from callquality.sources import snapshots as S


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "table")


def sources(spark, **versions):
    return spark.createDataFrame([(k, v) for k, v in versions.items()], "key string, v int")


def publish(spark, root, built=None, rows=3, **versions):
    def build(changed):
        if built is not None:
            built.append(sorted(r["key"] for r in changed.collect()))
        return changed.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(rows)))).filter("key <> 'empty'").select("n", "key", (F.col("v") * 10).alias("value"))

    return S.publish(spark, root, sources(spark, **versions), "key", ["v"], build, note="test")


def content(spark, root, version=None):
    return sorted((r["key"], r["n"], r["value"]) for r in S.read_snapshot(spark, root, version).collect())


def test_only_changes_are_rebuilt(spark, root):
    built = []
    assert S.current_version(spark, root) == 0 and S.read_manifest(spark, root).count() == 0
    with pytest.raises(GuardError, match="no version"):
        S.read_snapshot(spark, root)
    assert publish(spark, root, built, a=1, b=1, empty=1) == 1
    assert publish(spark, root, built, a=1, b=1, empty=1) == 1  # nothing changed
    assert publish(spark, root, built, b=2, c=1, empty=1) == 2
    assert built == [["a", "b", "empty"], ["b", "c"]]
    assert content(spark, root) == [(k, n, v) for k, v in (("b", 20), ("c", 10)) for n in (1, 2, 3)]
    assert content(spark, root, 1) == [(k, n, 10) for k in "ab" for n in (1, 2, 3)]
    manifest = {r["part_key"]: (r["run"][:6], r["rows"]) for r in S.read_manifest(spark, root).collect()}
    assert manifest == {"b": ("000002", 3), "c": ("000002", 3), "empty": ("000001", 0)}
    assert publish(spark, root, built, b=2, empty=1) == 3 and {k for k, _, _ in content(spark, root)} == {"b"}


def test_a_dead_publisher_leaves_the_version(spark, root, monkeypatch):
    publish(spark, root, a=1, b=1)
    before = content(spark, root)

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(S, "point_to", die)
        with pytest.raises(RuntimeError):
            publish(spark, root, a=2, c=1)
    assert S.current_version(spark, root) == 1 and content(spark, root) == before
    assert publish(spark, root, a=2, c=1) == 2
    clean = root + "-clean"
    publish(spark, clean, a=2, c=1)
    assert content(spark, root) == content(spark, clean)
    assert len(S.remove_unused(spark, root)) == 1  # what the dead one left
    opened = S.read_snapshot(spark, root)
    publish(spark, root, a=3)
    assert sorted((r["key"], r["n"], r["value"]) for r in opened.collect()) == content(spark, clean)  # the reader stays with its version


def test_removal(spark, root):
    for v in (1, 2, 3):
        publish(spark, root, a=v, b=1)
    gone = S.remove_unused(spark, root, keep=1)
    assert len(gone) == 1 and gone[0].startswith("run=000002")  # run 1 still holds b
    assert [k for k, n, _ in content(spark, root)] == ["a"] * 3 + ["b"] * 3
    with pytest.raises(GuardError, match="no version 1"):
        S.read_snapshot(spark, root, 1)


def test_provenance_in_footers_and_types(spark, root, tmp_path):
    publish(spark, root, **{"001": 1})
    part = spark.read.parquet(f"{root}/parts/run={S.read_manifest(spark, root).head()['run']}/part_key=001")
    told = next(f.metadata for f in part.schema.fields if f.name == "key")
    assert told["note"] == "test" and told["run"].startswith("000001")
    assert content(spark, root)[0] == ("001", 1, 10)  # a key that looks like a number stays text


def test_guards(spark, root):
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "key string, v int")
    with pytest.raises(GuardError, match="not there once"):
        S.publish(spark, root, twice, "key", ["v"], lambda c: c)
    with pytest.raises(GuardError, match="not there once"):
        S.publish(spark, root, spark.createDataFrame([(None, 1)], "key string, v int"), "key", ["v"], lambda c: c)
    with pytest.raises(GuardError, match="not asked for"):
        S.publish(spark, root, sources(spark, a=1), "key", ["v"], lambda c: c.withColumn("key", F.lit("z")))


def test_replaced_column_is_skipped_when_recorded(spark, root):
    base = root + "-base"
    publish(spark, base, a=1, b=1)
    ids = spark.createDataFrame([(2,)], "n int")
    assert S.replace_column(spark, root, base, ids, "n", "hit", "key") == 1
    assert S.replace_column(spark, root, base, ids.unionByName(ids), "n", "hit", "key") == 1
    assert {(r["n"], r["hit"]) for r in S.read_snapshot(spark, root).collect()} == {(1, False), (2, True), (3, False)}
    publish(spark, base, a=2, b=1)
    assert S.replace_column(spark, root, base, ids, "n", "hit", "key") == 2
    assert {r["part_key"]: r["run"][:6] for r in S.read_manifest(spark, root).collect()} == {"a": "000002", "b": "000001"}


def test_arriving_batches_add_and_repeat(spark, root):
    build = lambda changed: changed.select("key", (F.col("v") * 10).alias("value"))
    for batch in ({"a": 1}, {"b": 1}, {"b": 1}, {"a": 5, "c": 1}):
        S.publish_arriving(sources(spark, **batch), root, "key", ["v"], build)
    assert S.current_version(spark, root) == 3
    assert sorted((r["key"], r["value"]) for r in S.read_snapshot(spark, root).collect()) == [("a", 50), ("b", 10), ("c", 10)]


def test_scans_are_pruned(spark, tmp_path):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("population"), F.lit("full").alias("branch"), (F.col("id") % 20).alias("individual"), F.col("id").alias("v"), F.lit("x").alias("unused"))
    io.write_parts(df.repartition("population", "individual"), str(tmp_path / "parts"), "population", "branch", "individual")
    wanted = spark.range(20).select(F.col("id").alias("individual")).filter("individual < 4")
    got = io.read_population(spark, str(tmp_path / "parts"), df.schema, "p", wanted, ["v"]).filter("v > 40")
    rows = sorted((r["individual"], r["v"]) for r in got.collect())
    assert rows == sorted((k % 20, k) for k in range(42, 400, 2) if k % 20 < 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "population" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "unused" not in plan.split("ReadSchema")[1].split("\n")[0] and "GreaterThan(v,40)" in plan
