"""The trigger as an event: one alert when a connection falls below the threshold, not one per row below it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from layover.operators.keys import attach


def crossings(
    events: DataFrame, threshold_mins: int = 40, key: str = "pnr", at: str = "event_timestamp", tie: str = "event_id", chunk: str = "month"
) -> DataFrame:
    """Rows at which a key's connection falls below the threshold.

    A row is below by the rule of ``passengers.misconnects``.  It alerts if its key's row before it, by time and
    then by ``tie``, is not below: repeated updates below the threshold give one alert, and a recovery arms it
    again.  A key's first row alerts if it is below.  Unknown times come last, rows that are alike in time and
    tie are one update, and rows without minutes, or without a key, tell nothing and are left out.

    The row before is looked up inside chunks of time; the last row of a chunk is carried to the next one that has
    any.  So a key with a large share of all rows is spread over its chunks, and what is ordered per key is one
    row per chunk.
    """
    now, before = F.col("new_connection_mins"), F.col("orig_connection_mins")
    part = F.coalesce(F.date_trunc(chunk, F.col(at)).cast("string"), F.lit("unknown"))  # sorts after digits
    order = F.struct(F.col(at).isNull().alias("unknown"), F.col(at).alias("at"), F.col(tie).alias("tie"))
    told = events.select(
        F.struct("*").alias("row"), F.col(key).alias("key"), part.alias("chunk"), order.alias("order"),
        ((now < threshold_mins) & (now < before)).alias("below"),
    ).filter(now.isNotNull() & before.isNotNull() & F.col(key).isNotNull())
    # Alike in time and tie: one update, below if any of them is.
    told = told.groupBy("key", "chunk", "order").agg(F.max("below").alias("below"), F.max_by("row", F.struct("below", F.xxhash64("row"))).alias("row"))
    last = told.groupBy("key", "chunk").agg(F.max_by("below", "order").alias("left"))
    carried = last.withColumn("came", F.lag("left").over(W.partitionBy("key").orderBy("chunk"))).drop("left")
    inside = told.withColumn("previous", F.lag("below").over(W.partitionBy("key", "chunk").orderBy("order")))
    known = attach(inside, carried, ["key", "chunk"])
    armed = ~F.coalesce("previous", "came", F.lit(False))
    return known.filter(F.col("below") & armed).select("row.*")
