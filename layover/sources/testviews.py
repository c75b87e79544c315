"""The disruption tables as views over the supplied test tables.

Each view is a base table, an optional filter and one SQL expression per column.  The same text
serves Spark (``selectExpr``) and, with the timestamp type renamed, the SQL oracle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"
NTZ = "TIMESTAMP_NTZ"


@dataclass(frozen=True)
class View:
    base: str
    columns: dict[str, str]
    where: str | None = None


EXEC = View(
    "events",
    {
        "exec_id": "'EXEC-' || CAST(event_id AS VARCHAR(20))",
        "case_id": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'CASE-' || CAST(user_id AS VARCHAR(20)) || '-' || CAST(day(ts) AS VARCHAR(2)) END",
        "pnr": "'PNR-' || CAST(user_id AS VARCHAR(20))",
        "customer_id": "'CUST-' || CAST(user_id AS VARCHAR(20))",
        "scenario": "CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN '' WHEN event_type IN ('purchase','signup') THEN 'PULL_CONCIERGE' ELSE 'PUSH_NBA' END",
        "action_taken": "CASE event_type WHEN 'view' THEN 'HOLD_AND_PROMPT' WHEN 'click' THEN 'PROACTIVE_REBOOK_NOTIFY' WHEN 'purchase' THEN 'CONFIRM_REBOOK_QUIET_POD' WHEN 'signup' THEN 'CONFIRM_REBOOK_LATER_LOUNGE' ELSE NULL END",
        "reasoning": """CASE WHEN event_id % 7 = 0 THEN 'free text ' || CAST(event_id AS VARCHAR(20)) ELSE '{"archetype": "CHOICE_ORIENTED", "held_flights": ["EK372", "EK380"], "chosen_flight": "EK' || CAST(372 + 8 * (event_id % 2) AS VARCHAR(3)) || '"}' END""",
        "status": "CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_type = 'view' THEN 'STAGED_FOR_CONCIERGE' WHEN event_type = 'purchase' THEN 'SUCCESS' WHEN event_type = 'click' THEN 'confirmed' WHEN event_type = 'error' THEN 'Failed_inventory' ELSE 'PENDING' END",
        "success_flag": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value > 20 END",
        "executed_at": "CASE WHEN event_id % 23 = 0 THEN NULL ELSE ts END",
    },
)

FLIGHT_EVENTS = View(
    "orders",
    {
        "event_id": "'EVT-' || CAST(9000 + o_orderkey % 100 AS VARCHAR(10))",
        "pnr": "'PNR-' || CAST(o_orderkey AS VARCHAR(20))",
        "customer_id": "'CUST-' || CAST(o_custkey AS VARCHAR(20))",
        "flight_number": "'EK' || lpad(CAST(o_custkey % 400 AS VARCHAR(3)), 3, '0')",
        "itinerary": "'LHR-DXB-SIN'",
        "orig_connection_mins": "CAST(70 + o_orderkey % 30 AS INT)",
        "new_connection_mins": "CAST(20 + CAST(floor(o_totalprice) AS BIGINT) % 60 AS INT)",
        "misconnect_risk": "(CAST(floor(o_totalprice) AS BIGINT) % 60) < 20",
        "event_timestamp": "o_orderdate",
    },
)

INVENTORY = View(
    "lineitem",
    {
        "lookup_id": "'LKP-' || CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_partkey AS VARCHAR(20)) || '-' || CAST(l_suppkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(3)) || '-' || CAST(l_shipdate AS VARCHAR(30))",
        "pnr": "'PNR-' || CAST(l_orderkey AS VARCHAR(20))",
        "alternate_flight": "'EK' || CAST(300 + l_suppkey % 100 AS VARCHAR(3))",
        "departure_time": "l_shipdate + INTERVAL '1' HOUR * CAST(l_partkey % 20 AS INT)",
        "arrival_time": "l_shipdate + INTERVAL '1' HOUR * CAST(l_partkey % 20 + 2 + l_suppkey % 7 AS INT)",
        "seats_available": "CAST(l_quantity AS INT) % 6",
        "lounge_available": "l_linestatus = 'O'",
        "inventory_status": "CASE WHEN CAST(l_quantity AS INT) % 6 = 0 THEN 'FULL' ELSE 'AVAILABLE' END",
        "overnight_required": "l_returnflag = 'R'",
        "destination": "'SIN'",
        "hold_status": "'AVAILABLE'",
        "hold_expires_at": "CAST(NULL AS TIMESTAMP_NTZ)",
        "amenity_type": "CASE WHEN l_linenumber % 3 = 0 THEN 'QUIET_POD' END",
        "amenity_id": "CASE WHEN l_linenumber % 3 = 0 THEN 'POD-' || CAST(l_linenumber AS VARCHAR(3)) END",
        "amenity_status": "CASE WHEN l_linenumber % 3 = 0 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END",
    },
)

UPLIFT = View(
    "orders",
    {
        "experiment_id": "'EXP-' || CAST(o_orderkey AS VARCHAR(20))",
        "customer_id": "'CUST-' || CAST(o_custkey AS VARCHAR(20))",
        "archetype": "CASE o_custkey % 4 WHEN 0 THEN 'SURE_THING' WHEN 1 THEN 'PERSUADABLE' WHEN 2 THEN 'SLEEPING_DOG' ELSE 'CHOICE_ORIENTED' END",
        "action_id": "'ACT-00' || CAST(1 + o_orderkey % 5 AS VARCHAR(1))",
        "gesture_applied": "o_orderstatus <> 'F'",
        "uplift_score": "CAST(CAST(floor(o_totalprice) AS BIGINT) % 68 - 25 AS DOUBLE) / 100 + CAST(o_orderkey % 7 AS DOUBLE) / 10000000",
    },
)

_CHAT = {
    "signal_id": "'SIG-' || CAST(conv_id AS VARCHAR(20)) || '-' || CAST(turn AS VARCHAR(5))",
    "pnr": "'PNR-' || CAST(conv_id AS VARCHAR(20))",
    "customer_id": "'CUST-' || CAST(conv_id AS VARCHAR(20))",
    "signal_timestamp": "TIMESTAMP_NTZ '2026-08-12 11:30:00' + INTERVAL '1' MINUTE * CAST(turn AS INT)",
    "sentiment": "CASE conv_id % 3 WHEN 0 THEN 'CALM' WHEN 1 THEN 'FRUSTRATED' ELSE 'SILENT' END",
    "message_text": "CASE WHEN conv_id % 3 = 2 THEN NULL WHEN turn >= 4 AND conv_id % 2 = 0 THEN 'Dinner is cancelled, prefer the later flight' WHEN turn BETWEEN 1 AND 3 THEN 'I CANNOT land after ' || CAST(1 + conv_id % 11 AS VARCHAR(2)) || ' PM. Also, I need a quiet place to work.' ELSE text END",
}

CHAT = View("conversations", _CHAT, "role = 'user'")

# The same messages with their conversation and turn number, for rules about order within a chat.
CHAT_TURNS = View("conversations", {"conv_id": "conv_id", "turn": "turn", **_CHAT}, "role = 'user'")

TURNS = View("conversations", {c: c for c in ("conv_id", "turn", "role", "text")})

PROFILE = View(
    "customer",
    {
        "customer_id": "'CUST-' || CAST(c_custkey AS VARCHAR(20))",
        "full_name": "c_name",
        "loyalty_tier": "CASE WHEN c_acctbal >= 7500 THEN 'PLATINUM' WHEN c_acctbal >= 4000 THEN 'GOLD' WHEN c_acctbal >= 1000 THEN 'SILVER' ELSE 'BLUE' END",
        "lifetime_spend_usd": "c_acctbal",
        "lifetime_flights": "CAST(c_custkey % 60 AS INT)",
        "cabin_class_preference": "c_mktsegment",
        "base_retention_propensity": "CAST(c_custkey % 100 AS DOUBLE) / 100",
    },
)

# Profile text with bullets, a line that is no field, a blank field and a repeated field.
PROFILE_TEXT = View(
    "customer",
    {
        "customer_id": "'CUST-' || CAST(c_custkey AS VARCHAR(20))",
        "profile": "'Profile summary' || chr(10) || '- Full Name: ' || c_name || chr(10) || '  * Loyalty Tier : ' || CASE WHEN c_acctbal >= 7500 THEN 'PLATINUM' WHEN c_acctbal >= 4000 THEN 'GOLD' ELSE 'BLUE' END || chr(10) || CASE WHEN c_custkey % 5 = 0 THEN '• Lifetime Spend (USD): unknown' ELSE '• Lifetime Spend (USD): ' || CAST(CAST(floor(c_acctbal * 100) AS BIGINT) * 13 AS VARCHAR(20)) END || chr(10) || 'Base Retention Propensity: 0.' || CAST(c_custkey % 100 AS VARCHAR(2)) || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN 'Last Disruption Outcome: accepted: lounge' ELSE 'Last Disruption Outcome:' END || chr(10) || CASE WHEN c_custkey % 7 = 0 THEN 'Loyalty Tier: UPGRADED' ELSE '' END",
    },
)

# Validity intervals, and the commit log they belong to.
ORDER_VERSIONS = View(
    "lineitem",
    {
        "order_id": "l_orderkey",
        "line_id": "l_linenumber",
        "amount": "l_extendedprice",
        "added_snapshot": "CAST(l_partkey % 10 AS INT)",
        "removed_snapshot": "CASE WHEN l_returnflag = 'R' THEN CAST(l_partkey % 10 + 1 + l_suppkey % 5 AS INT) END",
        "committed_at": "TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' DAY * CAST(l_partkey % 10 AS INT)",
    },
)

# Times written in the forms the time parser must read, and some it must not.
TIME_TEXT = View(
    "events",
    {
        "event_id": "event_id",
        "time_text": "CASE event_id % 9 WHEN 0 THEN substr(CAST(ts AS VARCHAR(40)), 1, 19) WHEN 1 THEN replace(substr(CAST(ts AS VARCHAR(40)), 1, 19), ' ', 'T') || 'Z' WHEN 2 THEN replace(substr(CAST(ts AS VARCHAR(40)), 1, 19), ' ', 'T') || '+04:00' WHEN 3 THEN replace(substr(CAST(ts AS VARCHAR(40)), 1, 19), ' ', 'T') || '-05:00' WHEN 4 THEN 'Mon, ' || lpad(CAST(day(ts) AS VARCHAR(2)), 2, '0') || ' Jan 2024 ' || substr(CAST(ts AS VARCHAR(40)), 12, 8) || ' GMT' WHEN 5 THEN '  ' || substr(CAST(ts AS VARCHAR(40)), 1, 19) || ' ' WHEN 6 THEN 'soon' WHEN 7 THEN '2024-13-' || CAST(event_id AS VARCHAR(20)) ELSE NULL END",
    },
)

# What an agent might answer to a passenger message: fenced or bare objects, broken ones, prose.
AGENT_OUTPUT = View(
    "conversations",
    {
        **CHAT_TURNS.columns,
        "agent_text": """CASE conv_id % 6
 WHEN 0 THEN 'Here you go.' || chr(10) || '```json' || chr(10) || '{"chosen_flight": "EK372", "seat": "4A", "amenity": "", "passenger_reply": "Done, see you at the gate.", "reasoning_summary": "Lands in time for turn ' || CAST(turn AS VARCHAR(5)) || '."}' || chr(10) || '```'
 WHEN 1 THEN 'Plan {"chosen_flight": "EK380", "seat": "12A", "reasoning_summary": "They prefer the later one."} as asked'
 WHEN 2 THEN '```' || chr(10) || '{"chosen_flight": "EK380", "reasoning_summary": }' || chr(10) || '``` then {"seat": "1C", "chosen_flight": "EK380", "reasoning_summary": "Dinner cancelled, later flight suits them."}'
 WHEN 3 THEN 'No object here, only ek380 for this one: ' || text
 WHEN 4 THEN '{"chosen_flight": "", "seat": "9F"} and {"chosen_flight": "EK372", "passenger_reply": "Change of mind noted"}'
 ELSE text END""",
    },
    "role = 'user'",
)

VIEWS = {
    "v_exec": EXEC,
    "v_flight_events": FLIGHT_EVENTS,
    "v_inventory": INVENTORY,
    "v_uplift": UPLIFT,
    "v_chat": CHAT,
    "v_chat_turns": CHAT_TURNS,
    "v_turns": TURNS,
    "v_profile": PROFILE,
    "v_profile_text": PROFILE_TEXT,
    "v_order_versions": ORDER_VERSIONS,
    "v_time_text": TIME_TEXT,
    "v_agent_output": AGENT_OUTPUT,
}


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def project(view: View, base: DataFrame) -> DataFrame:
    """Apply a view to its base table, batch or streaming."""
    if view.where:
        base = base.filter(view.where)
    return base.selectExpr(*[f"{expr} AS {name}" for name, expr in view.columns.items()])


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    view = VIEWS[name]
    return project(view, base_table(spark, sf_dir, view.base))


def oracle_view(name: str) -> str:
    """SELECT text of a view for the SQL oracle."""
    view = VIEWS[name]
    columns = ",\n ".join(f"{expr} AS {col}" for col, expr in view.columns.items())
    where = f"\nWHERE {view.where}" if view.where else ""
    return f"SELECT {columns}\nFROM {view.base}{where}".replace(NTZ, "TIMESTAMP")
