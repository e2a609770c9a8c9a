"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from assayline.session import shared_folder


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The table, written to the shared folder and read from there: lineage ends here and no executor holds the only copy.

    References to plans that are done with are dropped, so that Spark may delete their shuffle files.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    gc.collect()
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Py4J hands on once a second which references were dropped.
HANDED_ON_S = 1.2


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done with now, not when its driver next happens to collect garbage."""
    for _ in range(2):  # what one collection frees may hold others
        gc.collect()
        time.sleep(HANDED_ON_S)
        spark._jvm.System.gc()


#: Schemes of file systems that tasks can open themselves.
KNOWN_SCHEMES = ("file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss")


def shared_uri(spark: SparkSession) -> str:
    """The shared folder as tasks open it without Spark: a folder without a scheme lies on Spark's default file system, so that it is
    the one that Spark writes to; for a file system that tasks don't know, it is taken as mounted."""
    folder = shared_folder(spark)
    if "://" in folder or folder.startswith("file:"):
        return folder
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return whole if whole.split(":")[0] in KNOWN_SCHEMES else folder


BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's own bound, which a session has if it does not set another.
BATCH_DEFAULT = 64 << 20


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Keeps the batches that Spark sends to Python at a few megabytes, in the JVM and in Python, unless the session has a bound
    of its own. Holds for the session."""
    if spark.conf.get(BATCH_KEY).rstrip("b") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH_KEY, str(size))


def release_memory() -> None:
    """Gives what this process no longer uses back to the system: Spark keeps Python workers for later tasks, and their allocators
    would keep the largest amount any of them needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library, which has no such call
        return


class Memo:
    """Remembered results, by bytes. They are held in two generations: what is asked for moves to the young one, and when that has
    used up half of the room, the old one is forgotten and the young one takes its place. So frequent keys stay."""

    ENTRY_BYTES = 150

    def __init__(self, room: int):
        self.half, self.used = room // 2, 0
        self.young: dict = {}
        self.old: dict = {}

    def known(self, keys: set) -> dict:
        """What is remembered of some keys."""
        young, old = self.young, self.old
        found = {k: young[k] for k in keys if k in young}
        again = {k: old[k] for k in keys if k in old and k not in found} if old else {}
        self.remember(again)
        return found | again

    def remember(self, known: dict) -> None:
        size = sum(map(len, known)) + sum(map(len, known.values())) + self.ENTRY_BYTES * len(known)
        if self.used + size > self.half:
            self.young, self.old, self.used = {}, self.young, 0
        if size <= self.half:
            self.young.update(known)
            self.used += size
