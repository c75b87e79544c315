"""Golden rows for tests and demos, as literal relations.

They are inline ``VALUES`` relations, so the planner knows their exact size and broadcasts them
by its own size rule; no hint is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from layover.sources.schemas import SCHEMAS

# The golden rows, table by table, in column order.
ROWS = {
    "flight_operational_events": [
        ("EVT-9001", "PNR-881A", "CUST-101", "EK002", "LHR-DXB-SIN", 90, 35, True, "2026-08-12 11:30:00"),
        ("EVT-9002", "PNR-442B", "CUST-202", "EK002", "LHR-DXB-BKK", 85, 35, True, "2026-08-12 11:30:00"),
        ("EVT-9003", "PNR-109C", "CUST-303", "EK002", "LHR-DXB-SYD", 75, 25, True, "2026-08-12 11:30:00"),
        ("EVT-9004", "PNR-404D", "CUST-404", "EK002", "LHR-DXB-SIN", 90, 35, True, "2026-08-12 11:30:00"),
    ],
    "unstructured_chat_signals": [
        ("SIG-01", "PNR-109C", "CUST-303", "2026-08-12 11:32:10", "FRUSTRATED",
         "Unbelievable. Another inbound delay. My connection is down to 25 mins. Get me on another flight or refund my return ticket."),
        ("SIG-02", "PNR-442B", "CUST-202", "2026-08-12 11:33:00", "CALM",
         "Hi, my connection time just dropped to 35 minutes in Dubai. Will I make it, or can you look at alternate flights and lounge access?"),
        ("SIG-03", "PNR-881A", "CUST-101", "2026-08-12 11:33:30", "SILENT", None),
    ],
    "action_gesture_shelf": [
        ("ACT-001", "PROACTIVE_REBOOK_NOTIFY", "Rebook next flight + Push notification", 120.0, False, "Automatically secure seat on next flight and notify user via app."),
        ("ACT-002", "LOUNGE_PASS_MEAL", "Express Lounge Pass + $50 Meal Voucher", 45.0, False, "Provide fast-track lounge pass and digital dining voucher."),
        ("ACT-003", "FULL_CONCIERGE_CARE", "Auto-Rebook + First Lounge + $200 Loyalty Credits", 280.0, True, "Requires human agent signoff or high-tier automated policy."),
        ("ACT-004", "NO_ACTION_MONITOR", "Monitor connection status without push", 0.0, False, "Allow passenger to self-navigate or wait for operational update."),
        ("ACT-005", "HOLD_AND_PROMPT", "Hold alternate seats + Push choice micro-prompt", 15.0, False, "Pre-hold inventory options; invite passenger into concierge chat to choose."),
    ],
    "historical_uplift_experiments": [
        ("EXP-101", "CUST-101", "SURE_THING", "ACT-003", True, 0.02),
        ("EXP-102", "CUST-101", "SURE_THING", "ACT-004", True, 0.0),
        ("EXP-201", "CUST-202", "PERSUADABLE", "ACT-002", True, 0.42),
        ("EXP-202", "CUST-202", "PERSUADABLE", "ACT-004", False, 0.0),
        ("EXP-301", "CUST-303", "SLEEPING_DOG", "ACT-002", False, -0.25),
        ("EXP-302", "CUST-303", "SLEEPING_DOG", "ACT-001", True, 0.15),
        ("EXP-401", "CUST-404", "CHOICE_ORIENTED", "ACT-005", True, 0.38),
        ("EXP-402", "CUST-404", "CHOICE_ORIENTED", "ACT-001", False, -0.12),
    ],
    "concierge_inventory_lookup": [
        ("LKP-001", "PNR-881A", "EK354", "2026-08-12 15:10:00", "2026-08-12 19:45:00", 4, True, "AVAILABLE", False, "SIN", "AVAILABLE", None, None, None, None),
        ("LKP-002", "PNR-442B", "EK372", "2026-08-12 16:30:00", "2026-08-12 20:15:00", 2, True, "AVAILABLE", False, "BKK", "AVAILABLE", None, None, None, None),
        ("LKP-003", "PNR-109C", "EK414", "2026-08-12 22:00:00", "2026-08-12 08:30:00", 0, False, "FULL", True, "SYD", "AVAILABLE", None, None, None, None),
        ("LKP-004", "PNR-404D", "EK372", "2026-08-12 15:10:00", "2026-08-12 17:15:00", 2, True, "AVAILABLE", False, "SIN", "AVAILABLE", "2026-08-12 16:00:00", "QUIET_POD", "POD-4", "AVAILABLE"),
        ("LKP-005", "PNR-404D", "EK380", "2026-08-12 18:00:00", "2026-08-12 21:30:00", 4, True, "AVAILABLE", False, "SIN", "AVAILABLE", "2026-08-12 19:00:00", None, None, "UNAVAILABLE"),
    ],
}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def values_sql(table: str) -> str:
    """``VALUES`` text of the golden rows; both engines used in the tests accept it."""
    rows = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in ROWS[table])
    return f"VALUES {rows}"


def seed(spark: SparkSession, table: str) -> DataFrame:
    """The golden rows of a table with its declared types."""
    schema = SCHEMAS[table]
    casts = [f"CAST(col{i} AS {f.dataType.simpleString()}) AS {f.name}"
             for i, f in enumerate(schema.fields, start=1)]
    return spark.sql(f"SELECT {', '.join(casts)} FROM {values_sql(table)}")


def action_shelf(spark: SparkSession) -> DataFrame:
    return seed(spark, "action_gesture_shelf")
