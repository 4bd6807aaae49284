"""Intermediate tables in the shared folder that the cluster names.

Lineage is cut by writing a table and reading it back. The folder is
``spark.checkpoint.dir`` of the session, which the driver and all executors
share; lost executors therefore lose nothing of it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set and all runs on this machine (tests), a new local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not (master := spark.sparkContext.master).startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quirework-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


@contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """Within this block, the shuffle files of a finished write are deleted at once."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


_open: list[list[Scratch]] = []


@contextmanager
def released():
    """Folders that operators make within this block are deleted at its end. Their results must have been written or read by then."""
    _open.append([])
    try:
        yield
    finally:
        for scratch in _open.pop():
            scratch.drop("")
            atexit.unregister(scratch._end)


class Scratch:
    """A folder of tables of one run of an operator. It goes at the end of a block of released(), or else of the program."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quirework-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._end)
        if _open:
            _open[-1].append(self)

    @staticmethod
    def at(spark: SparkSession, path: str) -> Scratch:
        """A folder of one's own choice, which stays."""
        out = Scratch.__new__(Scratch)
        out.spark, out.root = spark, path.rstrip("/")
        return out

    def _end(self) -> None:
        """Results may be read until the program ends; then the folder goes, if Spark is still there."""
        if self.spark.sparkContext._jsc is not None:
            self.drop("")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str, partition_by: list[str] | None = None) -> DataFrame:
        """Writes df and returns the table as read back; its plan starts there."""
        schema = df.schema
        with shuffle_files_dropped(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table), partitionBy=partition_by)
        return self.spark.read.schema(schema).parquet(self.path(table))

    def make(self, table: str) -> None:
        """An empty folder, if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)

    def text(self, name: str, content: str) -> None:
        """Writes a small file of text in place of what was there."""
        jvm = self.spark._jvm
        path, new = (jvm.org.apache.hadoop.fs.Path(self.path(x)) for x in (name, f"{name}.new"))
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(new, True)
        out.write(bytearray(content.encode()))
        out.close()
        files.delete(path, False)
        files.rename(new, path)

    def drop(self, *tables: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
