"""Tables written to the folder that the driver and all executors share.

A written table cuts lineage: a lost executor costs a re-read of Parquet files,
never a recomputation of the stages before it.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch handed to a Python worker. Texts may be
#: long, so a batch is bounded by bytes as well as by rows.
BATCH_ROWS = 1500
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Unset is accepted on a local master alone, where one machine holds
    everything; a cluster must name its shared folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return f"file:///tmp/checkpoints/{os.getuid()}"


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small; whole texts of any length pass through them.

    The bounds hold when a result is computed, so they stay set in the session; smaller
    ones of the caller stay as they are.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after which the Python worker gives freed memory back; it may idle beside a JVM that needs it."""

    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return wrapped


def session_folder(spark: SparkSession, name: str) -> str:
    """A new shared folder that goes when the driver's JVM ends; results are read from it until then."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


class Workspace:
    """Intermediate tables of one operator call, under one folder of the session."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = session_folder(spark, name)
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as a scan of what was written."""
        path = self.path(name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._ledgerlight_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by :meth:`put` that no later plan reads."""
        path = getattr(df, "_ledgerlight_path", None)
        if path:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
