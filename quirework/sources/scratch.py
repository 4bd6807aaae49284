"""Folders for what a query writes and reads back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share; it goes when the program ends. Where none is set and all runs on this machine, a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not (master := spark.sparkContext.master).startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quirework-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    path = f"{named.rstrip('/')}/quirework-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_gone, spark, path)
    return path


def _gone(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
