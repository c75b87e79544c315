"""Live counts and pairs against their batch forms, over micro-batches in no order."""

import pytest

from layover.operators.audit import COUNTS
from layover.session import new_path
from layover.sources.testviews import spark_view
from layover.streaming import ingest, live
from tests.conftest import SF_SMALL


@pytest.fixture()
def folder(spark):
    return new_path(spark, "live-test")


def run_counts(spark, folder, schema, lateness):
    counts = live.live_counts(ingest.read_files(spark, f"{folder}/in", schema, files_per_batch=1), "1 day", lateness)
    query = live.write_changes(counts, f"{folder}/out", f"{folder}/state")
    ingest.drain(query)
    got = live.read_newest(spark, f"{folder}/out", counts.schema, ["window_start"])
    return {r["window_start"]: tuple(r)[1:] for r in got.collect()}, query


def test_every_window_is_counted_as_in_batch_also_after_more_input(spark, folder):
    audit = spark_view(spark, SF_SMALL, "v_exec")
    for round_no in (1, 2):  # the second round adds the same rows again and goes on from the state
        audit.repartition(3, "exec_id").write.mode("append").parquet(f"{folder}/in")
        got, query = run_counts(spark, folder, audit.schema, "90 days")
        plain: dict = {}
        for r in audit.filter("executed_at IS NOT NULL").selectExpr("date_trunc('DAY', executed_at) AS d", "*").collect():
            plain[r["d"]] = plain.get(r["d"], 0) + round_no
        assert {w: c[0] for w, c in got.items()} == plain
        assert ingest.dropped_late(query) == 0
    assert len(next(iter(got.values()))) == len(COUNTS)


def test_state_is_bounded_and_late_rows_are_told(spark, folder):
    audit = spark_view(spark, SF_SMALL, "v_exec").filter("executed_at IS NOT NULL")
    audit.filter("executed_at >= '2024-01-20'").coalesce(1).write.parquet(f"{folder}/in")
    run_counts(spark, folder, audit.schema, "1 day")
    audit.filter("executed_at < '2024-01-05'").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    _, query = run_counts(spark, folder, audit.schema, "1 day")
    assert ingest.dropped_late(query) > 0
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_pairs_of_two_streams(spark, folder):
    rows = "k string, at timestamp_ntz, text string"
    from datetime import datetime as at

    time = lambda h, m=0: at(2024, 1, 1, h, m)
    left = [("a", time(1), "x"), ("a", time(5), "y"), ("b", time(2), "z"), (None, time(1), "n"), ("c", None, "t")]
    right = [("a", time(1), "p"), ("a", time(3), "q"), ("a", time(3, 1), "late"), ("a", time(0, 59), "before"), ("b", time(4), "r"), (None, time(1), "n"), ("c", time(1), "t"), ("a", time(6), "s")]
    for name, data in (("l", left), ("r", right)):
        spark.createDataFrame(data, rows).repartition(3).write.parquet(f"{folder}/{name}")
    schema = spark.createDataFrame([], rows).schema
    streams = [ingest.read_files(spark, f"{folder}/{n}", schema, files_per_batch=1) for n in "lr"]
    pairs = live.live_pairs(*streams, "k", "at", "at", "2 HOURS", lateness="1 day")
    ingest.drain(ingest.write_files(pairs, f"{folder}/out", f"{folder}/state"))
    got = spark.read.schema(pairs.schema).parquet(f"{folder}/out").selectExpr("left.text AS a", "right.text AS b").collect()
    assert sorted(map(tuple, got)) == [("x", "p"), ("x", "q"), ("y", "s"), ("z", "r")]
