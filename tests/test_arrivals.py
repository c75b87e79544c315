"""First arrivals by keyed state."""

from collections import Counter
from datetime import datetime as at

import pytest

from layover.session import new_path
from layover.streaming import arrivals, ingest

ROWS = "id string, at timestamp_ntz, text string"


@pytest.fixture()
def folder(spark):
    return new_path(spark, "arrivals-test")


def add(spark, folder, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, **options):
    stream = ingest.read_files(spark, f"{folder}/in", spark.createDataFrame([], ROWS).schema, files_per_batch=1)
    query = arrivals.write_arrivals(
        arrivals.first_arrivals(stream, "id", "at", **options), f"{folder}/out", f"{folder}/state", "at", lateness="1 hour"
    )
    ingest.drain(query)
    return query


def written(spark, folder, late=None):
    return Counter(tuple(r) for r in arrivals.read_arrivals(spark, f"{folder}/out", spark.createDataFrame([], ROWS).schema, late).collect())


def day(n: int, hour: int = 0):
    return at(2024, 1, n, hour)


@pytest.mark.parametrize("salts", [1, 4])
def test_the_first_arrival_of_each_id_over_batches_and_restarts(spark, folder, salts):
    add(spark, folder, [("a", day(5, 3), "later"), ("a", day(5, 1), "earlier"), ("b", None, "no time"), ("b", day(9), "a time"), (None, day(1), "x"), (None, day(1), "x")])
    add(spark, folder, [("a", day(1), "too early to count"), ("c", day(2), "old but new"), (None, day(9), "y"), (None, None, "z")])
    query = run(spark, folder, keep_for="30 days", salts=salts)
    assert arrivals.held(query) >= 3
    expected = Counter({
        ("a", day(5, 1), "earlier"): 1, ("b", day(9), "a time"): 1, ("c", day(2), "old but new"): 1,
        (None, day(1), "x"): 2, (None, day(9), "y"): 1, (None, None, "z"): 1,
    })
    assert written(spark, folder) == expected
    # Late rows are written as well, and counted: the newest time before them was the 9th.
    assert written(spark, folder, late=True) == Counter({("c", day(2), "old but new"): 1})
    add(spark, folder, [("a", day(8), "again"), ("c", day(8), "again"), ("d", day(9), "new"), (None, day(1), "x")])
    run(spark, folder, keep_for="30 days", salts=salts)
    assert written(spark, folder) == expected + Counter({("d", day(9), "new"): 1, (None, day(1), "x"): 1})
    assert written(spark, folder, late=True).total() == 2


def test_ids_are_forgotten_after_the_stated_time(spark, folder):
    add(spark, folder, [(f"i{k}", day(1), "first") for k in range(50)])
    assert arrivals.held(run(spark, folder, keep_for="1 millisecond")) >= 50
    add(spark, folder, [("j", day(1), "first")])
    assert arrivals.held(run(spark, folder, keep_for="1 millisecond")) <= 4  # the others are gone, and their timers
    add(spark, folder, [("i3", day(2), "back")])
    run(spark, folder, keep_for="1 millisecond")
    rows = written(spark, folder)
    assert rows[("i3", day(2), "back")] == 1 and rows.total() == 52


def test_intervals():
    assert arrivals.milliseconds("7 days") == 7 * 86_400_000 and arrivals.milliseconds("1 Second") == 1000
