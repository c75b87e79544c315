"""Event and chat ingestion, and the misconnect trigger on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from layover.operators.passengers import misconnects

EVENT_TIME = "__event_time"
SALT = "__salt"


def keep_state_on_disk(spark: SparkSession) -> SparkSession:
    """Hold streaming state in RocksDB instead of executor memory; set before a query first starts."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    return spark


def read_files(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    name_pattern: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream, new ones picked up as they appear.

    ``name_pattern`` chooses among the files by their own names.  For a table that may be one file or a folder
    of files, ``folder`` is a pattern of its path.
    """
    reader = spark.readStream.schema(schema)
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def first_seen(stream: DataFrame, key: str, at: str, lateness: str, salts: int = 8) -> DataFrame:
    """First arrival of each id in a live tail; repeats within the lateness bound are dropped.

    A row that is later than the bound is dropped as well, which ``dropped_late`` counts.  Old files in
    no order of time are no live tail: read them with ``write_first_seen``, which loses nothing.

    Repeats of one id may be a large share of the stream, and a streaming deduplication sends
    all of them to one task.  So they are first dropped per (id, salt), where the salt is taken
    from the input partition; at most ``salts`` copies of an id remain for the second step.
    State is kept no longer than the lateness bound.
    """
    # Watermarks need a zoned timestamp; the zone-free column itself is left alone.
    timed = stream.withColumn(EVENT_TIME, F.col(at).cast("timestamp")).withWatermark(EVENT_TIME, lateness)
    if salts > 1:
        timed = timed.withColumn(SALT, F.pmod(F.spark_partition_id(), F.lit(salts)))
        timed = timed.dropDuplicatesWithinWatermark([key, SALT]).drop(SALT)
    return timed.dropDuplicatesWithinWatermark([key]).drop(EVENT_TIME)


def misconnect_alerts(events: DataFrame, threshold_mins: int = 40) -> DataFrame:
    """The batch trigger rule, unchanged, on a stream: it keeps no state."""
    return misconnects(events, threshold_mins)


def write_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start writing a stream to parquet files, each row exactly once, until input is used up."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same through batch writes, one folder per micro-batch.

    A batch that is run again after a failure overwrites its own folder, so nothing is doubled.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _lacking(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def write_first_seen(stream: DataFrame, path: str, checkpoint: str, key: str, at: str) -> StreamingQuery:
    """Write the first arrival of each id, whatever its time, one folder per micro-batch.

    Within a batch the earliest row of an id counts, unknown times last; ids already in the folders of
    earlier batches are left out.  Rows without an id are all kept.  No state is held and no row is
    late; a batch that is run again overwrites its own folder and reads only those before it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        rest = F.struct(*columns)
        earliest = F.min_by(rest, F.struct(F.col(at).isNull().alias("unknown"), F.col(at), F.xxhash64(*columns)))
        known = batch.filter(F.col(key).isNotNull())
        fresh = known.groupBy(key).agg(earliest.alias("__row")).select("__row.*")
        if not _lacking(spark, path):
            before = spark.read.schema(f"`{key}` {dict(batch.dtypes)[key]}, batch_id long").parquet(path)
            fresh = fresh.join(before.filter(F.col("batch_id") < batch_id).select(key), key, "left_anti")
        rows = fresh.select(*columns).unionByName(batch.filter(F.col(key).isNull()))
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dropped_late(query: StreamingQuery) -> int:
    """Rows a query has dropped because they came after the lateness bound, over its recent batches."""
    return sum(
        state["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for state in progress["stateOperators"]
    )


def drain(query: StreamingQuery) -> None:
    """Wait until the available input is used up; a failed query raises."""
    query.awaitTermination()
