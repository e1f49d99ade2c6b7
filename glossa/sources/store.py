"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; below a temporary folder where that is unset and all runs on this machine (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{top or f'file://{tempfile.gettempdir()}/glossa-{os.getpid()}'}/{name}-{uuid.uuid4().hex}"


def table(rows: DataFrame, name: str) -> DataFrame:
    """rows written below the shared folder and read back."""
    path = shared(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def dealt(rows: DataFrame) -> DataFrame:
    """A plain read of files; one that comes in fewer parts than there are cores (a small table) is dealt out, so that a pass over its texts uses them all. Larger tables are left as they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(2 * cores)
