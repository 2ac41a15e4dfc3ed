"""Folders that driver and executors share, for logs that a job writes and reads again."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one on a local session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="portcullis-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def release_shuffles(spark: SparkSession) -> None:
    """Spark deletes the files of a shuffle that nothing refers to when the driver's JVM collects: now, not at some later time."""
    gc.collect()
    spark._jvm.System.gc()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
