"""Seats and cases against plain loops over one passenger or message after the other."""

import random
from collections import Counter

import pytest

from layover.operators import decisions, seats

CLAIMS = "customer_id long, pnr long, alternate_flight string, departure_time long, lookup_id string, standing long, choice long"


def one_by_one(claimed: list[tuple], room: dict) -> list[tuple]:
    left, out = dict(room), []
    by_person: dict = {}
    for c in claimed:
        by_person.setdefault((c[5], c[0], c[1]), []).append(c)
    for person in sorted(by_person):
        for c in sorted(by_person[person], key=lambda c: c[6]):
            if left.get((c[2], c[3]), 0) > 0:
                left[c[2], c[3]] -= 1
                out.append((c[0], c[1], c[2], c[3], c[4]))
                break
    return sorted(out)


@pytest.mark.parametrize("seed, people, flights, most", [(1, 60, 8, 4), (2, 300, 12, 30), (3, 200, 40, 3), (4, 400, 2, 150)])
def test_claims_are_settled_as_in_a_loop(spark, seed, people, flights, most):
    random.seed(seed)
    room = {(f"F{k}", k % 3): random.randint(0, most) for k in range(flights)}
    line = random.sample(range(1000), people)
    claimed = []
    for i in range(people):
        # Everybody likes the first flights best, so losers move on several times.
        some = sorted(random.sample(range(flights), random.randint(1, min(6, flights))))
        claimed += [(i, i % 7, f"F{k}", k % 3, f"L{i}-{k}", line[i], n) for n, k in enumerate(some)]
    claimed.append((people, 0, "unknown", 0, "L", 5000, 0))
    got = seats.settle_claims(
        spark.createDataFrame(claimed, CLAIMS).repartition(3),
        spark.createDataFrame([(*k, n) for k, n in room.items()], "alternate_flight string, departure_time long, seats int"),
    )
    rows = [tuple(r) for r in got.select("customer_id", "pnr", "alternate_flight", "departure_time", "lookup_id").collect()]
    assert sorted(rows) == one_by_one(claimed, room)
    assert all(n <= room[k] for k, n in Counter((r[2], r[3]) for r in rows).items())


def test_no_claims_and_no_seats(spark):
    none = spark.createDataFrame([], CLAIMS)
    room = spark.createDataFrame([("F", 1, 0)], "alternate_flight string, departure_time long, seats int")
    some = spark.createDataFrame([(1, 1, "F", 1, "L", 1, 1), (2, 1, None, 1, "M", 2, 1)], CLAIMS)
    assert seats.settle_claims(none, room).count() == seats.settle_claims(some, room).count() == 0


INVENTORY = "lookup_id string, pnr string, alternate_flight string, departure_time timestamp_ntz, arrival_time timestamp_ntz, seats_available int, hold_status string, inventory_status string"


def test_one_seat_goes_to_the_highest_tier_and_the_loser_moves_on(spark):
    from datetime import datetime as at

    day = lambda h: at(2024, 1, 1, h)
    rows = [
        ("a1", "P1", "EK1", day(8), day(10), 1, "AVAILABLE", "AVAILABLE"), ("a2", "P2", "EK1", day(8), day(10), 3, "AVAILABLE", "AVAILABLE"),
        ("b1", "P1", "EK2", day(9), day(12), 2, "AVAILABLE", "AVAILABLE"), ("c1", "P3", "EK1", day(8), day(10), 1, "AVAILABLE", "AVAILABLE"),
        ("d1", "P4", "EK9", day(8), day(23), None, "AVAILABLE", "FULL"),
    ]
    inventory = spark.createDataFrame(rows, INVENTORY)
    people = spark.createDataFrame([("x", "P1"), ("y", "P2"), ("z", "P3"), ("w", "P4"), (None, "P1"), ("v", None), ("y", "P2")], "customer_id string, pnr string")
    profiles = spark.createDataFrame([("x", "GOLD", 5.0), ("y", "PLATINUM", None), ("z", None, 9.0)], "customer_id string, loyalty_tier string, lifetime_spend_usd double")
    chosen = seats.seat_choices(people, profiles, inventory)
    got = {r["customer_id"]: r["lookup_id"] for r in chosen.collect()}
    assert got == {"y": "a2", "x": "b1", "z": None, "w": None}
    after = {r["lookup_id"]: (r["hold_status"], r["seats_available"]) for r in seats.take_seats(inventory, chosen).collect()}
    assert after == {
        "a1": ("AVAILABLE", 0), "a2": ("HELD", 2), "b1": ("HELD", 1), "c1": ("AVAILABLE", 0), "d1": ("AVAILABLE", None),
    }


def test_a_limit_leaves_out_later_flights(spark):
    from datetime import datetime as at

    rows = [("a", "P1", "EK1", at(2024, 1, 1, 8), at(2024, 1, 1, 20), 1, "", ""), ("b", "P1", "EK2", at(2024, 1, 1, 9), at(2024, 1, 1, 22), 1, "", "")]
    people = spark.createDataFrame([("x", "P1", 21), ("y", "P1", 21)], "customer_id string, pnr string, limit_hour int")
    profiles = spark.createDataFrame([], "customer_id string, loyalty_tier string, lifetime_spend_usd double")
    got = {r["customer_id"]: r["lookup_id"] for r in seats.seat_choices(people, profiles, spark.createDataFrame(rows, INVENTORY)).collect()}
    assert got == {"x": "a", "y": None}


# --- cases in the order of messages --------------------------------------------------------

MESSAGES = "signal_id string, pnr string, customer_id string, signal_timestamp timestamp_ntz, turn int, message_text string, agent_text string, step string, __own int"


def test_a_batch_gives_the_rows_of_its_messages_one_by_one(spark):
    from datetime import datetime as at, timedelta

    random.seed(6)
    people = [f"C{k}" for k in range(40)]
    log = []  # staged cases, some of them closed
    for k, c in enumerate(people):
        if k % 3:
            log.append((f"E{k}", f"CASE-{c}-old", "P", c, "PUSH_NBA", "HOLD_AND_PROMPT", "{}", "STAGED_FOR_CONCIERGE", True, at(2024, 1, 1)))
            if k % 3 == 2:
                log.append((f"F{k}", f"CASE-{c}-old", "P", c, "PULL_CONCIERGE", "CONFIRM", "{}", "SUCCESS", True, at(2024, 1, 2)))
    audit = spark.createDataFrame(
        log, "exec_id string, case_id string, pnr string, customer_id string, scenario string, action_taken string, reasoning string, status string, success_flag boolean, executed_at timestamp_ntz",
    )
    said = []
    for c in people:
        for k in range(random.randint(1, 7)):
            said.append((f"S{c}{k}", "P", c, at(2024, 1, 5) + timedelta(minutes=random.randint(0, 4)), random.choice([0, 0, 2, 3]), "hello", None, "mine", k))
    got = decisions.concierge_steps(spark.createDataFrame(said, MESSAGES).repartition(4), audit, as_of="2024-02-01 00:00:00")
    assert got.columns.count("step") == 1 and "__own" in got.columns
    state = {c: (f"CASE-{c}-old" if k % 3 else None, k % 3 == 1) for k, c in enumerate(people)}
    known = {}
    for s in sorted(said, key=lambda s: (s[3], s[0])):
        case, is_open = state[s[2]]
        if is_open:
            step = decisions.CONTINUE
        elif s[4] > 0:
            step = decisions.HOLD_AGAIN
        else:
            step, case = decisions.STAGE_FIRST, f"CASE-{s[2]}-20240201000000"
        known[s[0]] = (step, case)
        state[s[2]] = (case, False)  # its own resolution closes the case
    assert {r["signal_id"]: (r["step"], r["case_id"]) for r in got.collect()} == known


def test_texts_are_decided_once(spark):
    """The plan reads an agent's text in one place."""
    said = spark.createDataFrame([("s", "p", "c", None, 0, "m", "{}", "", 1)], MESSAGES)
    audit = spark.createDataFrame([], "exec_id string, case_id string, pnr string, customer_id string, scenario string, action_taken string, reasoning string, status string, success_flag boolean, executed_at timestamp_ntz")
    plan = decisions.pull_resolution(said, audit)._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.split("\n") if "regexp" in line.lower() and "agent_text" in line]
    assert len(lines) <= 1
