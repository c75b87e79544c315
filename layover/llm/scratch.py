"""Tables written once to the shared folder the cluster names, and counts of rows without collecting."""

from __future__ import annotations

import ctypes
import functools
import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from layover.session import new_path


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the folder in ``spark.checkpoint.dir`` and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim_jvm(spark: SparkSession) -> str | None:
    """Give back what the driver's JVM has freed outside its heap; its answer, or None where it has no such command.

    Threads that plan and compile leave hundreds of megabytes to the C library, which keeps them.
    """
    java, array = spark.sparkContext._jvm.java, spark.sparkContext._gateway.new_array
    try:
        # By the interface: the server's own class is not open to callers.
        kinds = array(java.lang.Class, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = java.lang.Class.forName(kind)
        invoke = java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        call = array(java.lang.Object, 4)
        call[0] = spark.sparkContext._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call[1] = "systemTrimNativeHeap"
        return invoke.invoke(java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JError:
        return None


def trim_here() -> None:
    """Give back what this process has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def gives_back(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` after whose tasks their process gives back what they have freed.

    Python workers outlive their tasks, and each would keep the most it ever took beside the JVM of its executor.
    """

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim_here()

    return task


def release(spark: SparkSession) -> None:
    """Let the session drop shuffle files of steps that are over, and give the driver's free memory back.

    A driver with idle memory keeps both.  The first collection lets go of the plans, the second of the
    shuffles they held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)
    trim_jvm(spark)
    trim_here()
