"""Alerts on falling below the threshold against a plain loop."""

import random
from datetime import datetime as at, timedelta

from layover.operators.crossings import crossings

EVENTS = "event_id string, pnr string, orig_connection_mins int, new_connection_mins int, event_timestamp timestamp_ntz, key string, below int"


def test_one_alert_per_fall_and_rearmed_by_recovery(spark):
    minutes = [90, 35, 30, None, 39, 40, 12, 11, 70, 20]
    rows = [(f"E{k}", "P", 90, m, at(2024, 1, 1) + timedelta(days=20 * k), "k", k) for k, m in enumerate(minutes)]
    got = crossings(spark.createDataFrame(rows, EVENTS))
    assert got.columns == [c.split()[0] for c in EVENTS.split(", ")]
    assert sorted(r["event_id"] for r in got.collect()) == ["E1", "E6", "E9"]


def test_against_a_loop(spark):
    random.seed(2)
    rows = []
    for k in range(1500):
        pnr = random.choice(["hot", "hot", f"P{random.randrange(80)}", None])
        time = random.choice([None, *[at(2024, 1, 1) + timedelta(hours=random.randrange(5000))] * 9])
        rows.append((f"E{k:04d}", pnr, random.choice([None, 50, 90, 90, 90]), random.choice([None, 20, 39, 40, 60, 95]), time, "k", k))
    state, known = {}, []
    for e, pnr, orig, new, _, _, _ in sorted(rows, key=lambda r: (r[4] is None, r[4] or at(1970, 1, 1), r[0])):
        if None in (pnr, orig, new):
            continue
        below = new < 40 and new < orig
        if below and not state.get(pnr, False):
            known.append(e)
        state[pnr] = below
    df = spark.createDataFrame(rows, EVENTS).repartition(5)
    for chunk in ("month", "day", "year"):
        assert sorted(r["event_id"] for r in crossings(df, chunk=chunk).collect()) == sorted(known)
    assert crossings(df.limit(0)).count() == 0
