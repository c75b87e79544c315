"""Streams against their batch forms."""

import pytest
from pyspark.sql import functions as F

from layover.operators import passengers
from layover.session import new_path
from layover.sources.testviews import spark_view
from layover.streaming import ingest
from tests.conftest import SF, SF_SMALL


def keys(df, column):
    return sorted(r[column] for r in df.select(column).collect())


@pytest.fixture()
def folder(spark):
    return new_path(spark, "stream-test")


def test_trigger_on_a_stream_equals_batch(spark, folder):
    events = spark_view(spark, SF_SMALL, "v_flight_events")
    events.repartition(4).write.parquet(f"{folder}/in")
    stream = ingest.read_files(spark, f"{folder}/in", events.schema, files_per_batch=1)
    ingest.drain(ingest.write_files(ingest.misconnect_alerts(stream), f"{folder}/out", f"{folder}/state"))
    got = spark.read.schema(events.schema).parquet(f"{folder}/out")
    assert keys(got, "pnr") == keys(passengers.misconnects(events), "pnr")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.mark.parametrize("salts,on_disk", [(1, False), (8, False), (8, True)])
def test_repeats_are_dropped_across_batches_and_restarts(spark, folder, salts, on_disk):
    before = spark.conf.get(PROVIDER)
    if on_disk:
        ingest.keep_state_on_disk(spark)
    try:
        drop_repeats_twice(spark, folder, salts)
    finally:
        spark.conf.set(PROVIDER, before)


def drop_repeats_twice(spark, folder, salts):
    chat = spark_view(spark, SF, "v_chat")
    chat.write.parquet(f"{folder}/in")

    def run():
        stream = ingest.read_files(spark, f"{folder}/in", chat.schema, files_per_batch=1)
        unique = ingest.first_seen(stream, "signal_id", "signal_timestamp", lateness="2 hours", salts=salts)
        ingest.drain(ingest.write_files(unique, f"{folder}/out", f"{folder}/state"))
        return keys(spark.read.schema(chat.schema).parquet(f"{folder}/out"), "signal_id")

    once = keys(chat, "signal_id")
    assert run() == once
    chat.write.mode("append").parquet(f"{folder}/in")
    assert run() == once


def test_a_hot_id_with_many_copies_leaves_one(spark, folder):
    chat = spark_view(spark, SF_SMALL, "v_chat")
    hot = chat.limit(1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("copy")
    chat.unionByName(hot).repartition(6).write.parquet(f"{folder}/in")
    stream = ingest.read_files(spark, f"{folder}/in", chat.schema)
    unique = ingest.first_seen(stream, "signal_id", "signal_timestamp", lateness="2 hours")
    ingest.drain(ingest.write_files(unique, f"{folder}/out", f"{folder}/state"))
    assert keys(spark.read.schema(chat.schema).parquet(f"{folder}/out"), "signal_id") == keys(chat, "signal_id")


def test_batch_folders_hold_each_row_once_when_a_batch_runs_again(spark, folder):
    events = spark_view(spark, SF_SMALL, "v_flight_events")
    events.repartition(3).write.parquet(f"{folder}/in")
    stream = ingest.read_files(spark, f"{folder}/in", events.schema, files_per_batch=1)
    # Two runs from the start write the same batches; the folders are overwritten, not doubled.
    for attempt in ("first", "second"):
        ingest.drain(ingest.write_batches(stream, f"{folder}/out", f"{folder}/state-{attempt}"))
    got = spark.read.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    assert keys(got, "pnr") == keys(events, "pnr")


def four_files(spark, folder):
    """Events in four files in no order of time, some times unknown, and every row a second time."""
    events = spark_view(spark, SF_SMALL, "v_flight_events").withColumn(
        "event_timestamp", F.expr("CASE WHEN pmod(hash(pnr), 10) = 0 THEN NULL ELSE event_timestamp END")
    )
    events.repartition(4, "customer_id").write.parquet(f"{folder}/in")
    events.repartition(2, "pnr").write.mode("append").parquet(f"{folder}/in")
    return events, ingest.read_files(spark, f"{folder}/in", events.schema, files_per_batch=1)


def test_old_files_in_any_order_lose_nothing(spark, folder):
    events, stream = four_files(spark, folder)
    for _ in range(2):  # the second run finds nothing new
        ingest.drain(ingest.write_first_seen(stream, f"{folder}/out", f"{folder}/state", "pnr", "event_timestamp"))
    got = spark.read.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    assert keys(got, "pnr") == keys(events, "pnr")
    assert got.filter("event_timestamp IS NULL").count() == events.filter("event_timestamp IS NULL").count()


def test_a_live_tail_counts_what_came_too_late(spark, folder):
    events, stream = four_files(spark, folder)
    unique = ingest.first_seen(stream, "pnr", "event_timestamp", lateness="1 hour")
    query = ingest.write_files(unique, f"{folder}/out", f"{folder}/state")
    ingest.drain(query)
    written = spark.read.schema(events.schema).parquet(f"{folder}/out")
    assert ingest.dropped_late(query) > 0
    assert written.select("pnr").distinct().count() + ingest.dropped_late(query) >= events.count()
