"""Queries run as streams over the test files until the input is used up."""

from pyspark.sql import functions as F

from layover.registry import query
from layover.registry.audit import COUNTS
from layover.session import new_path
from layover.sources import testviews
from layover.streaming import arrivals, ingest, live


def stream_of(t, name: str):
    """A test view over a stream of its base table, which is a file or a folder of files."""
    view = testviews.VIEWS[name]
    schema = t.base(view.base).schema
    # As a pattern, for Spark streams a path that is no pattern only from a folder.
    files = ingest.read_files(t.spark, f"{t.sf_dir.rstrip('/')}/{view.base}[.]parquet", schema)
    return testviews.project(view, files)


@query(
    "misconnect_trigger_stream",
    "SELECT * FROM v_flight_events WHERE new_connection_mins < 40 AND new_connection_mins < orig_connection_mins",
)
def misconnect_trigger_stream(t):
    alerts = ingest.misconnect_alerts(stream_of(t, "v_flight_events"))
    path = new_path(t.spark, "alerts")
    ingest.drain(ingest.write_files(alerts, path, f"{path}-state"))
    return t.spark.read.schema(alerts.schema).parquet(path)


@query("chat_ingest_stream", "SELECT * FROM v_chat")
def chat_ingest_stream(t):
    twice = stream_of(t, "v_chat").unionByName(stream_of(t, "v_chat"))
    unique = ingest.first_seen(twice, "signal_id", "signal_timestamp", lateness="2 hours")
    path = new_path(t.spark, "signals")
    ingest.drain(ingest.write_files(unique, path, f"{path}-state"))
    return t.spark.read.schema(unique.schema).parquet(path)


@query("event_ingest_stream", "SELECT * FROM v_flight_events")
def event_ingest_stream(t):
    # Several files in no order of time, one per batch, each followed by a repeat of it.
    path = new_path(t.spark, "events")
    t.flight_events.repartition(4, "customer_id").write.parquet(f"{path}-in")
    files = ingest.read_files(t.spark, f"{path}-in", t.flight_events.schema, files_per_batch=1)
    query = ingest.write_first_seen(files.unionByName(files), path, f"{path}-state", "pnr", "event_timestamp")
    ingest.drain(query)
    return t.spark.read.schema(files.schema).option("recursiveFileLookup", "true").parquet(path)


@query(
    "keyed_arrivals_stream",
    """SELECT * FROM (SELECT CASE WHEN right(pnr, 1) IN ('3', '8') THEN NULL ELSE signal_id END AS signal_id, * EXCLUDE (signal_id) FROM v_chat)
WHERE signal_id IS NOT NULL UNION ALL
SELECT NULL, v_chat.* EXCLUDE (signal_id) FROM v_chat, range(2) WHERE right(pnr, 1) IN ('3', '8')""",
)
def keyed_arrivals_stream(t):
    # Every row arrives twice, in files in no order of time; some have no id and are no repeats.
    path = new_path(t.spark, "arrivals")
    lost = t.chat.withColumn("signal_id", F.expr("CASE WHEN right(pnr, 1) IN ('3', '8') THEN NULL ELSE signal_id END"))
    lost.repartition(2, "customer_id").write.parquet(f"{path}-in")
    lost.repartition(2, "message_text").write.mode("append").parquet(f"{path}-in")
    files = ingest.read_files(t.spark, f"{path}-in", lost.schema, files_per_batch=1)
    unique = arrivals.first_arrivals(files, "signal_id", "signal_timestamp", keep_for="30 days")
    ingest.drain(arrivals.write_arrivals(unique, path, f"{path}-state", "signal_timestamp", lateness="1 minute"))
    return arrivals.read_arrivals(t.spark, path, lost.schema)


#: Files in each of three batches, so that as many tasks write them.
FILES = 16


def in_three_batches(t, rows, path):
    """A table as a stream of three batches of files, in no order of time."""
    rows.repartition(3 * FILES, "exec_id").write.parquet(f"{path}-in")
    return ingest.read_files(t.spark, f"{path}-in", rows.schema, files_per_batch=FILES)


@query(
    "window_counts_stream",
    f"SELECT date_trunc('hour', executed_at) AS window_start, {COUNTS} FROM d_flags WHERE executed_at IS NOT NULL GROUP BY 1",
)
def window_counts_stream(t):
    path = new_path(t.spark, "counts")
    counts = live.live_counts(in_three_batches(t, t.exec, path), "1 hour", lateness="60 days")
    ingest.drain(live.write_changes(counts, path, f"{path}-state"))
    return live.read_newest(t.spark, path, counts.schema, ["window_start"])


@query(
    "staged_then_resolved_stream",
    """SELECT a.customer_id, a.exec_id AS staged_id, b.exec_id AS resolved_id, b.status FROM v_exec a JOIN v_exec b ON b.customer_id = a.customer_id
 AND b.executed_at >= a.executed_at AND b.executed_at <= a.executed_at + INTERVAL 2 HOUR
WHERE a.status = 'STAGED_FOR_CONCIERGE' AND b.scenario = 'PULL_CONCIERGE'""",
)
def staged_then_resolved_stream(t):
    path = new_path(t.spark, "pairs")
    told = t.exec.select("exec_id", "customer_id", "scenario", "status", "executed_at")
    rows = in_three_batches(t, told, path)
    pairs = live.live_pairs(
        rows.filter("status = 'STAGED_FOR_CONCIERGE'"), rows.filter("scenario = 'PULL_CONCIERGE'"),
        "customer_id", "executed_at", "executed_at", "2 HOURS", lateness="60 days",
    ).select("left.customer_id", F.col("left.exec_id").alias("staged_id"), F.col("right.exec_id").alias("resolved_id"), "right.status")
    ingest.drain(ingest.write_files(pairs, path, f"{path}-state"))
    return t.spark.read.schema(pairs.schema).parquet(path)
