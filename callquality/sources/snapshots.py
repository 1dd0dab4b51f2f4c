"""Published snapshots: a table in parts by key, of which only what changed is rebuilt, switched from version to version.

Layout under a root, all written by Spark jobs: ``parts/run=<run>/part_key=<key>/`` (never changed once written),
``manifest/by=<run>/`` (a row a part: key, run, stamp of its sources), ``pointer/version=<n>/`` (one row in one file, written
last: with it a version is there, without it nothing of its run is seen). Readers take the highest pointer and read the
parts of its manifest; the scan is pruned to these by a join with the manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callquality.operators.joins import GuardError
from callquality.operators.shared import counted_broadcast, stored
from callquality.sources.io import marked

#: Columns that parts have besides the table's own.
RUN, KEY = "run", "part_key"
_MANIFEST = "part_key string, run string, stamp string, rows long"
_POINTER = "number long, by string, schema string, note string"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """number, by (the run that published it), schema, note: a row a published version; none for a root without any."""
    try:
        return spark.read.schema(_POINTER).json(f"{root}/pointer/*/*.json")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], _POINTER)


def current_version(spark: SparkSession, root: str) -> int:
    """The highest published version; 0 for none."""
    return versions(spark, root).agg(F.max("number")).head()[0] or 0


def _pointed(spark: SparkSession, root: str, version: int | None) -> Row:
    found = versions(spark, root)
    found = found.orderBy(F.desc("number")).head() if version is None else found.filter(F.col("number") == version).head()
    if found is None:
        raise GuardError(f"{root} has no version {version or ''}")
    return found


def _parts_of(spark: SparkSession, root: str, by: str) -> DataFrame:
    return spark.read.schema(f"{_MANIFEST}, by string").parquet(f"{root}/manifest").filter(F.col("by") == by).drop("by")


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """part_key, run, stamp, rows of a version's parts (the current one's by default); none where nothing is published."""
    if version is None and not current_version(spark, root) or version == 0:
        return spark.createDataFrame([], _MANIFEST)
    return _parts_of(spark, root, _pointed(spark, root, version)["by"])


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, with ``part_key``. The version is looked up once, so a reader stays with what it found, as
    long as ``remove_unused`` keeps it. GuardError for a version that isn't there."""
    found = _pointed(spark, root, version)
    own = T.StructType.fromJson(json.loads(found["schema"]))
    parts = spark.read.schema(T.StructType([*own.fields, T.StructField(RUN, T.StringType()), T.StructField(KEY, T.StringType())])).parquet(f"{root}/parts")
    chosen = counted_broadcast(_parts_of(spark, root, found["by"]).select(F.col(RUN).alias("_run"), F.col(KEY).alias("_key")))
    return parts.join(chosen, (F.col(RUN) == F.col("_run")) & (F.col(KEY) == F.col("_key"))).drop("_run", "_key", RUN)


def stamped(sources: DataFrame, key: str, provenance: Sequence[str]) -> DataFrame:
    """part_key, stamp: a digest of what each key's part is to be built from."""
    return sources.select(F.col(key).cast("string").alias(KEY), F.sha2(F.to_json(F.struct(*provenance), {"ignoreNullFields": "false"}), 256).alias("stamp"))


def publish(spark: SparkSession, root: str, sources: DataFrame, key: str, provenance: Sequence[str], build: Callable[[DataFrame], DataFrame], note: str = "", remove: bool = True) -> int:
    """Publishes the version that ``sources`` describe, and returns its number.

    ``sources`` has one row a ``key``, with the columns ``provenance`` that say what its part is built from (files, their
    versions, settings). Parts that the current version built from the same stay as they are; ``build`` gets the sources
    of the others and gives their rows, with ``key``; with ``remove``, keys that left go. If nothing changed, nothing is
    written. Each part's Parquet footer names its run and the note (metadata of the key's column), the manifest its stamp.
    A run that dies leaves the current version as it was; nothing points to its parts, and the next run does its work. Keys must
    be there once each, and ``build`` must give no others; a key without rows has a part in the manifest, with 0 rows.
    """
    wanted = stored(stamped(sources, key, provenance), "snapshot-wanted")
    odd = wanted.groupBy(KEY).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(KEY).isNull()).limit(1).collect()
    if odd:
        raise GuardError(f"key {odd[0][KEY]} is not there once")
    number = current_version(spark, root)
    now = read_manifest(spark, root, number)
    kept = now.join(wanted, [KEY, "stamp"], "left_semi") if remove else now.join(wanted.join(now, [KEY, "stamp"], "left_anti"), KEY, "left_anti")
    changed = stored(wanted.join(now, [KEY, "stamp"], "left_anti"), "snapshot-changed")
    left = now.join(wanted, KEY, "left_anti") if remove else now.limit(0)
    if number and changed.isEmpty() and left.isEmpty():
        return number
    run = f"{number + 1:06d}-{uuid.uuid4().hex[:12]}"
    mine = sources.join(changed.select(F.col(KEY).alias("_key")), F.col(key).cast("string") == F.col("_key"), "left_semi")
    made = build(mine)
    own = T.StructType([f for f in made.schema.fields if f.name not in (KEY, RUN)])
    told = {"run": run, "note": note}
    rows = made.select(*[F.col(f.name).alias(f.name, metadata=told) if f.name == key else F.col(f.name) for f in own.fields], F.col(key).cast("string").alias(KEY))
    rows.repartition(KEY).write.partitionBy(KEY).parquet(f"{root}/parts/{RUN}={run}")
    written = spark.read.schema(T.StructType([*own.fields, T.StructField(KEY, T.StringType())])).parquet(f"{root}/parts/{RUN}={run}").groupBy(KEY).agg(F.count("*").alias("rows"))
    other = written.join(changed, KEY, "left_anti").limit(1).collect()
    if other:
        raise GuardError(f"the build gave key {other[0][KEY]}, which was not asked for")
    new = changed.join(written, KEY, "left").select(KEY, F.lit(run).alias(RUN), "stamp", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
    kept.select(KEY, RUN, "stamp", "rows").unionByName(new).write.parquet(f"{root}/manifest/by={run}")
    point_to(spark, root, number + 1, run, own, note)
    return number + 1


def point_to(spark: SparkSession, root: str, number: int, by: str, schema: T.StructType, note: str) -> None:
    """The switch: one row in one file, whose rename at the end of the job makes the version the current one. A second
    publisher of the same number fails on the folder that is there."""
    spark.createDataFrame([(number, by, schema.json(), note)], _POINTER).coalesce(1).write.mode("error").json(f"{root}/pointer/version={number}")


def replace_column(spark: SparkSession, root: str, base: str, ids: DataFrame, on: str, column: str, key: str) -> int:
    """Publishes ``base``'s current rows with one boolean column replaced: whether ``on`` is among the ids. A part is only
    written again where it or the ids changed; both are recorded as its provenance."""
    number = current_version(spark, base)
    digest = ids.select(F.xxhash64(on).cast("decimal(38,0)").alias("h")).distinct().agg(F.count("*").alias("n"), F.sum("h").alias("h")).head()
    sources = read_manifest(spark, base, number).select(F.col(KEY).alias(key), "stamp", RUN).withColumn("ids", F.lit(f"{digest['n']} {digest['h']} {column}"))

    def build(changed: DataFrame) -> DataFrame:
        rows = read_snapshot(spark, base, number).join(changed.select(F.col(key).cast("string").alias(KEY)).distinct(), KEY, "left_semi")
        return marked(rows, ids, on, column)

    return publish(spark, root, sources, key, ["stamp", RUN, "ids"], build, note=f"{column} by {on}")


def remove_unused(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes runs that none of the last ``keep`` versions has parts of, also of publishers that died; returns them. No
    publisher may be at work. Older versions can't be read afterwards, and their pointers go first."""
    space, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    system = space.Path(root).getFileSystem(conf)

    def remove(folder: str, name: str, wanted: set[str]) -> list[str]:
        path = space.Path(f"{root}/{folder}")
        found = [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []
        gone = [n for n in found if n.startswith(f"{name}=") and n.partition("=")[2] not in wanted]
        for n in gone:
            system.delete(space.Path(f"{root}/{folder}/{n}"), True)
        return gone

    last = versions(spark, root).orderBy(F.desc("number")).limit(keep).collect()
    remove("pointer", "version", {str(r["number"]) for r in last})
    used = [r[RUN] for by in {r["by"] for r in last} for r in _parts_of(spark, root, by).select(RUN).distinct().collect()]
    remove("manifest", "by", {r["by"] for r in last})
    return remove("parts", RUN, set(used))


def publish_arriving(batch: DataFrame, root: str, key: str, provenance: Sequence[str], build: Callable[[DataFrame], DataFrame]) -> int:
    """For ``foreachBatch``: the sources of a batch are added to what is published, or replace parts of equal keys; a batch
    that is run again finds its parts there and publishes nothing."""
    return publish(batch.sparkSession, root, batch, key, provenance, build, note="arriving", remove=False)
