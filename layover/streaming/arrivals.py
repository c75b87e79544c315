"""First arrivals by keyed state: what an id has been seen for is known per id, not read back from old output.

Every id has a state of one number and a timer.  The first row of an id is passed on, later ones are left out,
whatever their times and however many batches lie between.  The timer forgets an id a stated time after its
first arrival, so state is bounded by the ids of that time; an id that comes back after it counts as new.
Rows without an id are no repeats of each other: they pass by the state and are all kept.

No row is dropped for being late.  What is older than the newest time of earlier batches by more than a stated
bound is written like any other, in a folder of its own, and counted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from layover.streaming.ingest import SALT

# The processor travels to the executors by value; they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ORDER, TIE = "__order", "__tie"
UNKNOWN = (1 << 63) - 1


class FirstArrival(StatefulProcessor):
    """Passes on the first row of an id, the earliest of its batch, and forgets the id after ``keep_ms``."""

    def __init__(self, names: list[str], keep_ms: int):
        self.names, self.width, self.keep_ms = names, len(names), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = None
        for row in rows:  # one row is held, however many an id has
            if first is None or row[self.width :] < first[self.width :]:
                first = row
        if self.seen.exists():
            return
        until = timerValues.getCurrentProcessingTimeInMs() + self.keep_ms
        self.seen.update((until,))
        self.handle.registerTimer(until)
        yield Row(**dict(zip(self.names, first)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


#: Units an interval may be given in.
UNITS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def milliseconds(interval: str) -> int:
    """Length of an interval such as ``7 days``."""
    number, unit = interval.split()
    return int(float(number) * UNITS[unit.lower().removesuffix("s")])


def _micros(at: str) -> Column:
    return F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(UNKNOWN))


def first_arrivals(stream: DataFrame, key: str, at: str, keep_for: str = "7 days", salts: int = 1) -> DataFrame:
    """The first row of each id of a stream, and all rows without an id.

    Of rows that arrive in one batch the earliest counts, unknown times last, then the smallest hash of the row.
    ``keep_for`` is an interval of processing time.  With ``salts`` over 1, repeats are first left out per id and
    input partition, so that an id with a large share of a batch's rows is not read by one task; each salt
    has a state of its own, bounded alike.
    """
    columns = stream.columns
    known = stream.filter(F.col(key).isNotNull())
    keep_ms = milliseconds(keep_for)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in stream.schema.fields])

    def passed(rows: DataFrame, by: list[str], out: T.StructType) -> DataFrame:
        return rows.groupBy(*by).transformWithState(FirstArrival(out.names, keep_ms), out, "Append", "ProcessingTime")

    def ordered(rows: DataFrame) -> DataFrame:
        return rows.withColumns({ORDER: _micros(at), TIE: F.xxhash64(*columns)})

    if salts > 1:
        salted = known.withColumn(SALT, F.pmod(F.spark_partition_id(), F.lit(salts)))
        by_salt = T.StructType([*schema.fields, T.StructField(SALT, T.IntegerType(), True)])
        known = passed(ordered(salted), [key, SALT], by_salt).drop(SALT)
    return passed(ordered(known), [key], schema).unionByName(stream.filter(F.col(key).isNull()))


def write_arrivals(
    stream: DataFrame, path: str, checkpoint: str, at: str, lateness: str = "2 hours"
) -> StreamingQuery:
    """Write a stream as ``batch_id=…/late=…`` folders until its input is used up.

    A row is late if its time is more than ``lateness`` before the newest time of all earlier batches, of which
    only the last one's note is read.  A batch that is run again overwrites its folder and its note.  State is
    kept on disk.
    """
    behind = milliseconds(lateness) * 1000

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = newest_time(spark, path, batch_id - 1)
        rows = batch.withColumn("late", F.lit(False) if newest is None else (_micros(at) < F.lit(newest - behind)))
        rows = rows.persist()
        try:
            rows.write.mode("overwrite").partitionBy("late").parquet(f"{path}/batch_id={batch_id}")
            own = rows.filter(_micros(at) < UNKNOWN).agg(F.max(_micros(at)).alias("newest"))
            note = own.select(F.greatest("newest", F.lit(newest).cast("long")).alias("newest"))
            note.write.mode("overwrite").parquet(f"{path}-newest/batch_id={batch_id}")
        finally:
            rows.unpersist()

    spark = stream.sparkSession
    # Timers of processing time ask for batch after batch without data, which would never use the input up.
    wanted = {PROVIDER: ON_DISK, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return (
            stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def newest_time(spark: SparkSession, path: str, batch_id: int) -> int | None:
    """The newest time, in microseconds, up to a batch; None before the first."""
    if batch_id < 0:
        return None
    return spark.read.schema("newest long").parquet(f"{path}-newest/batch_id={batch_id}").agg(F.max("newest")).first()[0]


def read_arrivals(spark: SparkSession, path: str, schema: T.StructType, late: bool | None = None) -> DataFrame:
    """What ``write_arrivals`` has written: all of it, or only what was or was not late."""
    told = T.StructType([*schema.fields, T.StructField("late", T.BooleanType()), T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(told).parquet(path)
    if late is not None:
        rows = rows.filter(F.col("late") == late)
    return rows.select(*schema.names)


def held(query: StreamingQuery) -> int:
    """Ids in state after a query's last batch, over all its keyed steps."""
    last = query.lastProgress
    return sum(s["numRowsTotal"] for s in last["stateOperators"]) if last else 0
