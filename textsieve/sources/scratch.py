"""Tables that one computation writes for itself, in the folder that the cluster names in spark.checkpoint.dir.

Writing a table cuts its lineage, lets several steps read it without computing it again, and survives lost executors.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # at the end of an execution that was started with it


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A temporary one only where the setting is missing and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir or not os.path.isdir(_own_dir[0]):
        _own_dir[:] = [tempfile.mkdtemp(prefix="textsieve-")]
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return "file://" + _own_dir[0]


class Scratch:
    """A folder of written tables. It goes when it is cleared, or else with the session's driver."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/textsieve/{name}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """The table as it was written. What was shuffled for it is deleted, as no later step reads that."""
        path = f"{self.root}/{tag}"
        before = self.spark.conf.get(SHUFFLES_GO)
        self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(SHUFFLES_GO, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        """Deletes tables that no later step reads."""
        for tag in tags:
            self._delete(f"{self.root}/{tag}")

    def clear(self) -> None:
        """Deletes the whole folder."""
        self._delete(self.root)
        atexit.unregister(self._at_exit)

    def _at_exit(self) -> None:
        with contextlib.suppress(Exception):  # the session or its JVM may have ended before; then nothing can be done
            self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out anew (by key if there are any) where the files read would make fewer partitions than there are cores,
    as a single small file does. Larger inputs, streams and rows that come from no file stay as they are."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    size = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df if size >= cores * most else df.repartition(cores, *keys)
