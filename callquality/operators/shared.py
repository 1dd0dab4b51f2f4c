"""Intermediate tables of long jobs: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callquality.operators.joins import GuardError


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where one process runs Spark (as in tests) does a temporary folder stand in."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise GuardError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder: computed once, no lineage, there when an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_broadcast(df: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """A broadcast hint for a stored table with at most so many rows; else the table as it is."""
    return F.broadcast(df) if df.count() <= most_rows else df
