"""Column rules on edge values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from layover.functions import clock, outcome, wording
from layover.functions import text as tx
from layover.operators import audit as au
from layover.operators import chat
from layover.operators.mutate import delete_where, update_where


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def text(value):
    return F.lit(value).cast("string")


AT = dt.datetime(2026, 8, 12, 11, 30, 5)


@pytest.mark.parametrize(
    "written,expected",
    [
        ("2026-08-12 11:30:05", AT),
        ("  2026-08-12 11:30:05\n", AT),
        ("2026-08-12T11:30:05", AT),
        ("2026-08-12T11:30:05Z", AT),
        ("2026-08-12T11:30:05+04:00", AT),
        ("2026-08-12T11:30:05-05:00", AT),
        ("2026-08-12T11:30:05.250000+00:00", AT.replace(microsecond=250000)),
        ("Wed, 12 Aug 2026 11:30:05 GMT", AT),
        ("2026-08-12", dt.datetime(2026, 8, 12)),
        ("2026-08-12T11", AT.replace(minute=0, second=0)),
        ("2026-08-12T11:30", AT.replace(second=0)),
        ("20260812T113005", AT),
        ("20260812T113005Z", AT),
        ("20260812T113005+0400", AT),
        ("20260812T1130", AT.replace(second=0)),
        ("20260812T11", AT.replace(minute=0, second=0)),
        ("20260812", dt.datetime(2026, 8, 12)),
        ("2026", None),
        ("2026-13-01 00:00:00", None),
        ("Wed, 12 Foo 2026 11:30:05 GMT", None),
        ("yesterday", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_moment(spark, written, expected):
    assert one(spark, clock.parse_moment(text(written))) == expected


def test_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one(spark, clock.parse_moment(text("2026-03-08T02:30:00Z"))) == dt.datetime(2026, 3, 8, 2, 30)
        start = one(spark, clock.window_start("1d", "2026-03-08 12:00:00"))
        assert start == dt.datetime(2026, 3, 7, 12)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize(
    "status,flag,successful,failed",
    [
        ("SUCCESS", False, True, True),
        ("success", None, True, True),
        ("Confirmed", True, True, False),
        ("COMPLETED", True, True, False),
        ("PARTIAL_FAILURE", True, False, True),
        ("failed", None, False, True),
        ("STAGED_FOR_CONCIERGE", True, True, False),
        ("PENDING", None, False, True),
        ("", True, True, False),
        (None, True, True, False),
        (None, None, False, True),
    ],
)
def test_success_and_failure(spark, status, flag, successful, failed):
    s, f = text(status), F.lit(flag).cast("boolean")
    assert one(spark, outcome.is_successful(s, f)) is successful
    assert one(spark, outcome.is_failed(s, f)) is failed


@pytest.mark.parametrize(
    "status,badge",
    [
        ("success", "badge-success"), ("UNCONFIRMED", "badge-success"), ("STAGED_FOR_CONCIERGE", "badge-staged"),
        ("awaiting", "badge-staged"), ("FAILED", "badge-fail"), ("STAGED_FAILED", "badge-staged"),
        ("other", "badge-neutral"), ("", "badge-neutral"), (None, "badge-neutral"),
    ],
)
def test_badges(spark, status, badge):
    assert one(spark, outcome.status_badge(text(status))) == badge


@pytest.mark.parametrize(
    "said,hour",
    [
        ("I CANNOT land after 6 PM.", 18), ("cannot land after 12 PM", 12), ("cannot land after 12 am", 0),
        ("Cannot land after 11AM", 11), ("I can land after 6 PM", None), ("", None), (None, None),
    ],
)
def test_limit_hour(spark, said, hour):
    assert one(spark, tx.limit_hour(text(said))) == hour


@pytest.mark.parametrize(
    "value,flight",
    [("ek380", "EK380"), ("EK372", "EK372"), ("EK372 or EK380", "EK372"), ("EK414", "EK372"), ("", "EK372"), (None, "EK372")],
)
def test_offered_flight(spark, value, flight):
    assert one(spark, tx.offered_flight(text(value))) == flight


@pytest.mark.parametrize(
    "value,flights",
    [("EK372, EK380", ["EK372", "EK380"]), (" ,,\tEK380 ", ["EK380"]), ("", []), (None, [])],
)
def test_flight_list(spark, value, flights):
    assert one(spark, tx.flight_list(text(value))) == flights


@pytest.mark.parametrize(
    "reasoning,summary",
    [
        ('{"archetype": "SURE_THING", "held_flights": ["EK372", "EK380"], "handoff": "AWAITING"}',
         "Segment: SURE_THING · Held: EK372, EK380 · Handoff: AWAITING"),
        ('{"chosen_flight": "EK372", "seat": "3K"}', "Chosen: EK372"),
        ('{"held_flights": []}', "Held: "),
        ('{"held_flights": "EK372", "archetype": "X"}', '{"held_flights": "EK372", "archetype": "X"}'),
        ('{"seat": "3K"}', '{"seat": "3K"}'),
        ('{"archetype": ""}', '{"archetype": ""}'),
        ('{"archetype": "X"} and more', '{"archetype": "X"} and more'),
        ('{"archetype": "X"},{"archetype": "Y"}', '{"archetype": "X"},{"archetype": "Y"}'),
        ('{"archetype": "X"},{"__end_of_text":"1"}] [', '{"archetype": "X"},{"__end_of_text":"1"}] ['),
        ("{'archetype': 'X'}", "{'archetype': 'X'}"),
        ('{"archetype": ', '{"archetype": '),
        ("just text", "just text"),
        ("null", "null"),
        ("5", "5"),
        ("", ""),
        (None, ""),
    ],
)
def test_audit_summary(spark, reasoning, summary):
    assert one(spark, tx.audit_summary(text(reasoning))) == summary
    # The same from a document parsed before.
    assert one(spark, tx.document_summary(tx.document(text(reasoning)), text(reasoning))) == summary


@pytest.mark.parametrize(
    "profile,fields",
    [
        ("- Full Name: Ann Lee\n* Tier : GOLD\n• Note: a: b\nno field\nEmpty:\n", {"Full Name": "Ann Lee", "Tier": "GOLD", "Note": "a: b"}),
        ("Tier: GOLD\nTier: PLATINUM", {"Tier": "PLATINUM"}),
        ("", {}),
    ],
)
def test_profile_fields(spark, profile, fields):
    assert one(spark, tx.profile_fields(text(profile))) == fields


@pytest.mark.parametrize(
    "value,shown",
    [("1234567.5", "1,234,567.5"), ("1000", "1,000"), ("100", "100"), ("-12.34", "-12.34"), ("0", "0"), ("abc", None)],
)
def test_grouped_number(spark, value, shown):
    assert one(spark, tx.grouped_number(text(value))) == shown


@pytest.mark.parametrize(
    "answer,flight,reason",
    [
        ('```json\n{"chosen_flight": "EK380", "reasoning_summary": "r"}\n```', "EK380", "r"),
        ('```JSON {"chosen_flight": "", "seat": "1A"}``` then {"chosen_flight": "EK372"}', "EK372", None),
        ('first {"chosen_flight": broken} then {"chosen_flight": "EK380"}', "EK380", None),
        ("only ek380 in prose", "EK380", "only ek380 in prose"),
        ("ek372 and ek380", "EK372", "ek372 and ek380"),
        ("x" * 700, "EK372", "x" * 600),
        ("", "EK372", ""),
        (None, "EK372", ""),
    ],
)
def test_decision_from_text(spark, answer, flight, reason):
    row = one(spark, tx.decision_from_text(text(answer)))
    assert (row["chosen_flight"], row["reasoning_summary"]) == (flight, reason)


def test_transcript_lines(spark):
    line = lambda role, said, other=None: one(spark, tx.transcript_line(text(role), text(said), text(other)))
    assert line("agent", "Hello") == "[AGENT]: Hello"
    assert line(None, None, "from message") == "[PASSENGER]: from message"
    assert line("user", "") == "[USER]: "


def test_json_keeps_nulls(spark):
    made = one(spark, tx.as_json(a=F.lit(None).cast("string"), b=F.lit('q"')))
    assert made == '{"a":null,"b":"q\\""}'


def audit_rows(spark, values):
    return spark.sql(
        "SELECT CAST(c1 AS STRING) exec_id, CAST(c2 AS STRING) case_id, 'P' pnr, CAST(c3 AS STRING) customer_id, "
        "CAST(c4 AS STRING) scenario, 'A' action_taken, '' reasoning, CAST(c5 AS STRING) status, "
        "CAST(c6 AS BOOLEAN) success_flag, CAST(c7 AS TIMESTAMP_NTZ) executed_at "
        f"FROM VALUES {values} AS v(c1, c2, c3, c4, c5, c6, c7)"
    )


def test_unknown_times_stay_and_bounds_are_inclusive(spark):
    rows = audit_rows(
        spark,
        "('1','c','u','PUSH_NBA','SUCCESS',true,NULL), ('2','c','u','PUSH_NBA','SUCCESS',true,'2026-01-01 00:00:00'),"
        "('3','c','u','PUSH_NBA','SUCCESS',true,'2025-12-31 23:59:59'), ('4','c','u','PUSH_NBA','SUCCESS',true,'2027-01-01 00:00:00')",
    )
    ids = lambda df: sorted(r["exec_id"] for r in df.collect())
    assert ids(au.within(rows, "1d", "2026-01-02 00:00:00")) == ["1", "2", "4"]
    assert ids(au.within(rows, "nonsense", "2026-01-02 00:00:00")) == ["1", "2", "4"]
    assert ids(au.since(rows, "2026-01-01T00:00:00Z")) == ["1", "2", "4"]
    assert ids(au.since(rows, "garbage")) == ["1", "2", "3", "4"]
    assert ids(au.since(rows, "")) == ["1", "2", "3", "4"]
    assert ids(au.of_scenario(rows, None)) == ["1", "2", "3", "4"]
    assert ids(au.of_category(rows, None)) == ["1", "2", "3", "4"]


def test_open_staging_without_case_and_with_empty_case(spark):
    rows = audit_rows(
        spark,
        "('1',NULL,'a','PUSH_NBA','STAGED_FOR_CONCIERGE',true,'2026-01-01 00:00:00'),"
        "('2','X','b','PUSH_NBA','STAGED_FOR_CONCIERGE',true,'2026-01-01 00:00:00'),"
        "('3','X','b','PULL_CONCIERGE','SUCCESS',true,'2026-01-01 01:00:00'),"
        "('4','Y','c','PUSH_NBA','STAGED_FOR_CONCIERGE',true,'2026-01-01 00:00:00'),"
        "('5','Y','c','PULL_CONCIERGE','success',true,'2026-01-01 01:00:00')",
    )
    assert sorted(r["customer_id"] for r in au.open_staging(rows).collect()) == ["a", "c"]
    state = {r["customer_id"]: r["is_open"] for r in au.staging_state(rows).collect()}
    assert state == {"a": True, "b": False, "c": True}


def test_invariants_over_the_audit_log(spark):
    from layover.sources.testviews import AS_OF, spark_view
    from tests.conftest import SF_SMALL

    log = spark_view(spark, SF_SMALL, "v_exec")
    for window in clock.WINDOW_HOURS:
        rows = au.within(log, window, AS_OF)
        stats = au.execution_stats(log, window, AS_OF).collect()[0]
        sums = {r["field"]: r["s"] for r in au.count_by_fields(rows).groupBy("field").agg(F.sum("n").alias("s")).collect()}
        if stats["total_audit_rows"]:
            assert set(sums.values()) == {stats["total_audit_rows"]}
        assert stats["converted_cases"] <= stats["staged_cases"]
        counts = au.operation_counts(log, window, AS_OF).collect()[0].asDict()
        assert all(stats[k] == v for k, v in counts.items())
        for category, column in [("successful", "successful_resolutions"), ("failed", "failed_actions"),
                                 ("staged", "staged_for_concierge"), ("hold", "hold_and_prompt_actions"),
                                 ("autorebook", "proactive_rebook_actions")]:
            assert au.of_category(rows, category).count() == stats[column]


def test_null_conditions_change_nothing(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, NULL), (3, 'b') AS t(k, v)")
    kept = delete_where(rows, "v = 'a'").collect()
    assert sorted(r["k"] for r in kept) == [2, 3]
    changed = update_where(rows, "v = 'a'", {"v": F.lit("z")}).collect()
    assert {r["k"]: r["v"] for r in changed} == {1: "z", 2: None, 3: "b"}


def test_ids(spark):
    row = spark.sql("SELECT 'CUST-1' AS customer_id, 'PNR-1' AS pnr").select(
        au.case_id(as_of="2026-08-12 11:30:05").alias("c"), au.row_id("EXEC", as_of="2026-08-12 11:30:05").alias("e"),
        au.row_id("SIG", row_key="pnr", as_of="2026-08-12 11:30:05").alias("s"),
    ).collect()[0]
    assert tuple(row) == ("CASE-CUST-1-20260812113005", "EXEC-2026-08-12-113005-CUST-1", "SIG-2026-08-12-113005-CUST-1-PNR-1")


def test_the_present_is_the_default(spark):
    now = one(spark, clock.moment())
    assert abs((now - dt.datetime.now(dt.UTC).replace(tzinfo=None)).total_seconds()) < 3600 * 15


def test_silent_conversations_get_the_notice(spark):
    turns = spark.sql("SELECT * FROM VALUES (1L, 0L, 'user', 'hi') AS t(conv_id, turn, role, text)")
    rows = chat.transcripts(chat.prior_turns(turns), 100, turns).collect()
    assert [r["transcript"] for r in rows] == [wording.NO_TURNS]


@pytest.mark.parametrize(
    "written,kept",
    [
        ('{"a": 1.0}', "1"), ('{"a": 1e3}', "1000.0"), (' {"a": [1, "b"]} ', '[1,"b"]'), ('{"a": {"b": 1}}', '{"b":1}'), ('{"a": null}', None),
        ('{"b": 1}', None), ('{"a": 1}, {"a": 2}', None), ('{"a": 1},"1"', None), ('{"a": 1}]', None), ('{"a": 1},"1"] [', None), ('{"a": 1},"1"]', None),
        ('{"a": 1, "a": 2}', None), ('[{"a": 1}]', None), ('"a"', None), ("", None), (None, None), ('{"a": true} x', None),
    ],
)
def test_document(spark, written, kept):
    assert one(spark, tx.document_text(tx.document(text(written)), "a")) == kept
