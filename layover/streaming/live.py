"""Counts and context kept up to date while events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from layover.operators.audit import COUNTS
from layover.streaming.ingest import EVENT_TIME


def live_counts(audit: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """The operation counts of every window of execution time: (window_start, *counts).

    Rows without a time belong to no window.  State holds the windows of the lateness bound, one row each; rows
    that come later are not counted (``ingest.dropped_late`` tells how many).  Meant for update mode, in which
    a window is given out each time it changes, the last ones included.
    """
    # Watermarks need a zoned timestamp; starts are zone-free again.
    timed = audit.withColumn(EVENT_TIME, F.col("executed_at").cast("timestamp")).withWatermark(EVENT_TIME, lateness)
    counted = timed.groupBy(F.window(EVENT_TIME, window).alias("w")).agg(*[F.count_if(rule()).alias(n) for n, rule in COUNTS.items()])
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *COUNTS)


def live_pairs(
    left: DataFrame, right: DataFrame, on: str, left_at: str, right_at: str, within: str, lateness: str = "2 hours"
) -> DataFrame:
    """Rows of two streams that share a key, the right one up to ``within`` after the left one, both inclusive.

    (left, right): the two rows, so columns cannot clash.  Both sides have a watermark and the interval bounds how
    long a row can still find a partner: state is limited to the lateness bound and the interval.  Null keys
    and times find none.
    """
    a = left.filter(F.col(on).isNotNull() & F.col(left_at).isNotNull()).select(
        F.col(on).alias("__a"), F.col(left_at).cast("timestamp").alias("__a_at"), F.struct("*").alias("left")
    ).withWatermark("__a_at", lateness)
    b = right.filter(F.col(on).isNotNull() & F.col(right_at).isNotNull()).select(
        F.col(on).alias("__b"), F.col(right_at).cast("timestamp").alias("__b_at"), F.struct("*").alias("right")
    ).withWatermark("__b_at", lateness)
    near = F.expr(f"__b_at >= __a_at AND __b_at <= __a_at + INTERVAL {within}")
    return a.join(b, (F.col("__a") == F.col("__b")) & near).select("left", "right")


def write_changes(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what changes in each micro-batch to a folder of its own, until the input is used up.

    A batch that is run again overwrites its folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def read_newest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The newest state of every key that ``write_changes`` has written; folded per key before the shuffle."""
    told = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rest = [c for c in schema.names if c not in keys]
    newest = spark.read.schema(told).parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("__newest"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"__newest.{c}").alias(c) for c in schema.names])
