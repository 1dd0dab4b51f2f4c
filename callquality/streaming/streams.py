"""Arriving files, running summaries and duplicate guards on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callquality.operators.joins import GuardError
from callquality.operators.summaries import Summary, merged, state_of

#: Folders that take turns in holding a kept summary: a reader's stays whole while two more batches arrive.
SLOTS = 3


def arriving(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """A stream of files of a folder; each file is read once for a checkpoint."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def append_new_sources(stream: DataFrame, path: str, checkpoint: str, by: Sequence[str], transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Each batch overwrites its own partitions (by, and the batch's number), so a batch that is run again adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        done = transform(batch).withColumn("batch", F.lit(number))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_summary(stream: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    """Additive sums by group, for update mode."""
    return stream.groupBy(*by).agg(*aggs)


def _done(spark: SparkSession, root: str) -> int:
    """The last batch whose summary is whole; -1 for none."""
    try:
        return spark.read.schema("number long").json(f"{root}/done/*").agg(F.coalesce(F.max("number"), F.lit(-1))).head()[0]
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return -1


def keep_summary(stream: DataFrame, root: str, checkpoint: str, by: Sequence[str], summary: Summary) -> StreamingQuery:
    """Keeps the state of all that arrived under ``root``: each batch is summed up by itself and merged into the state before
    it, so no earlier row is read again.

    A batch that is run again starts from the same state as before and replaces what it left. GuardError (from the query) if
    ``root`` holds the summary of a stream with another checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not number - 1 <= _done(spark, root) <= number:
            raise GuardError(f"{root} holds the summary of another stream")
        state = state_of(batch, by, summary)
        if number:
            before = spark.read.schema(state.schema).parquet(f"{root}/state/slot={(number - 1) % SLOTS}")
            state = merged(before.unionByName(state), by, summary)
        state.write.mode("overwrite").parquet(f"{root}/state/slot={number % SLOTS}")
        spark.range(1).select(F.lit(number).alias("number")).coalesce(1).write.mode("overwrite").json(f"{root}/done/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_summary(spark: SparkSession, root: str) -> DataFrame:
    """The state that ``keep_summary`` finished last. GuardError where there is none."""
    if (number := _done(spark, root)) < 0:
        raise GuardError(f"{root} holds no summary")
    return spark.read.parquet(f"{root}/state/slot={number % SLOTS}")


def windowed_counts(stream: DataFrame, time: str, late: str, width: str, by: Sequence[str], *aggs: Column) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(*(aggs or (F.count("*").alias("n"),)))


def without_duplicates(stream: DataFrame, time: str, late: str, keys: Sequence[str]) -> DataFrame:
    """The first of rows with equal keys within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def drained(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns its result table."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
