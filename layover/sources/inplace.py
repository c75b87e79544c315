"""Tables laid out by their key, of which a change rewrites only the parts it touches.

A row lies in the part that the hash of its key names; a change to some keys reads and writes the parts of these
keys and leaves the files of all others alone.  It needs a folder that Spark can write to, and no table format.

Rows go into parts in GROUPS groups of parts, if there are many: one group after another is shuffled into place and its
shuffle let go, so the disk never holds a shuffle of them all.  Rows that are worked out only once are set aside in the
shared folder before, in these groups.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layover.session import new_path
from layover.sources.tables import write_new

PART = "key_part"
PARTS = 256
GROUP = "__part_group"
GROUPS = 8
#: Groups put into place together where every step reads the whole table again.
AGAIN = 2
#: Rows that take no more than this are put into place in one go.
GROUP_BYTES = 64 * 1024 * 1024


def part_of(key: Column, parts: int) -> Column:
    """The part a key lies in; rows without a key have one of their own."""
    return F.when(key.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))


@contextmanager
def _open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Writers keep ``most`` folders open, where they would sort (and spill) their rows by folder."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most + 1))  # with this many they begin to sort
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def _folder(spark: SparkSession, path: str):
    """A path and its file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    folder, system = _folder(spark, path)
    system.delete(folder, True)


def _let_go(spark: SparkSession) -> None:
    """Let the session drop the shuffle files of steps that are over: plans first, then what they held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def _grouped(placed: DataFrame) -> DataFrame:
    return placed.withColumn(GROUP, F.pmod(F.col(PART), F.lit(GROUPS)))


def _set_aside(placed: DataFrame, path: str) -> DataFrame:
    """Rows with their part, written in groups of parts."""
    with _open_files(placed.sparkSession, GROUPS):
        return write_new(_grouped(placed), path, [GROUP], "zstd")


def _size(spark: SparkSession, path: str) -> int:
    folder, system = _folder(spark, path)
    return system.getContentSummary(folder).getLength()


def _told_size(df: DataFrame) -> int:
    """Bytes of a table as the planner takes them; where it knows nothing, very many."""
    return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _steps(size: float, together: int = 1) -> list[list[int]]:
    """Groups that are put into place together: all of them if they are small, or so many."""
    each = GROUPS if size <= GROUP_BYTES else together
    return [list(range(first, first + each)) for first in range(0, GROUPS, each)]


def _dealt(rows: DataFrame, step: list[int], parts: int, files_per_part: int) -> DataFrame:
    """Rows of some groups, each part in ``files_per_part`` tasks of its own."""
    columns = [c for c in rows.columns if c not in (PART, GROUP)]
    row = ((F.col(PART) - F.col(GROUP)) / GROUPS).cast("int") + 1  # parts are numbered from -1
    task = (row * len(step) + F.col(GROUP) - step[0]) * files_per_part
    if files_per_part > 1:
        task = task + F.pmod(F.xxhash64(*columns), F.lit(files_per_part)).cast("int")
    tasks = (parts // GROUPS + 2) * len(step) * files_per_part
    return rows.filter(F.col(GROUP).isin(step)).repartitionById(tasks, task).drop(GROUP)


def write_laid_out(
    df: DataFrame, path: str, key: str, parts: int = PARTS, files_per_part: int = 1, read_again: bool = False
) -> None:
    """Write a table in parts by its key, each part in at most ``files_per_part`` files.

    More files per part spread a key with a large share of the rows over as many tasks.  ``read_again`` says that the
    table gives the same rows whenever it is read, as stored ones do: it is then read once per step, and not set aside.
    The table appears under its path when it is whole.
    """
    spark = df.sparkSession
    placed = df.withColumn(PART, part_of(F.col(key), parts))
    target, system = _folder(spark, path)
    if system.exists(target):
        return placed.limit(0).write.partitionBy(PART).parquet(path)  # fails, with Spark's own error
    aside, building = new_path(spark, "to-lay-out"), f"{path.rstrip('/')}-in"
    _remove(spark, building)  # of a job that died
    rows = _grouped(placed) if read_again else _set_aside(placed, aside)
    # Nothing else lies on the disk where rows are read again, and every step reads all of them.
    steps = _steps(_told_size(df), AGAIN) if read_again else _steps(_size(spark, aside))
    for step in steps:
        with _open_files(spark, 1):
            _dealt(rows, step, parts, files_per_part).write.mode("append").option("compression", "zstd").partitionBy(PART).parquet(building)
        for group in step:
            _remove(spark, f"{aside}/{GROUP}={group}")
        if len(steps) > 1:
            _let_go(spark)
    _remove(spark, aside)
    if not system.rename(_folder(spark, building)[0], target):
        raise OSError(f"cannot move {building} to {path}")


def read_laid_out(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    told = T.StructType([*schema.fields, T.StructField(PART, T.IntegerType())])
    return spark.read.schema(told).parquet(path).drop(PART)


def change_keys(
    spark: SparkSession, path: str, schema: T.StructType, key: str, keys: DataFrame,
    change: Callable[[DataFrame], DataFrame], parts: int = PARTS, files_per_part: int = 1,
) -> list[int]:
    """Apply ``change`` to the parts in which ``keys`` (a column named as the key) lie; which parts these were.

    ``change`` gets all rows of these parts, those of other keys too, and returns their next state in the same
    columns.  It must not move a row to another key or add rows of keys outside; such a change fails before
    anything is written.  The next state is complete in the shared folder before the parts are replaced, and a group of
    it goes when its parts are in place, so a job that dies while replacing them can be run again from there.  What
    comes to the driver is one number per part.
    """
    touched = sorted(r[0] for r in keys.select(part_of(F.col(key), parts).alias(PART)).distinct().collect())
    if not touched:
        return []
    told = T.StructType([*schema.fields, T.StructField(PART, T.IntegerType())])
    before = spark.read.schema(told).parquet(path).filter(F.col(PART).isin(touched)).drop(PART)
    aside = new_path(spark, "changed-parts")
    after = _set_aside(change(before).select(*schema.names).withColumn(PART, part_of(F.col(key), parts)), aside)
    if after.filter(~F.col(PART).isin(touched)).limit(1).count():
        raise ValueError("the change moves rows to keys in other parts")
    gone = sorted(set(touched) - {r[0] for r in after.select(PART).distinct().collect()})
    steps = _steps(_size(spark, aside))
    for step in steps:
        with _open_files(spark, 1):
            _dealt(after, step, parts, files_per_part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
                "compression", "zstd"
            ).partitionBy(PART).parquet(path)
        for group in step:
            _remove(spark, f"{aside}/{GROUP}={group}")
        if len(steps) > 1:
            _let_go(spark)
    _remove(spark, aside)
    for number in gone:  # a part that lost all its rows has nothing to be replaced with
        _remove(spark, f"{path}/{PART}={number}")
    return touched
