"""The declared tables: names, columns and types."""

from __future__ import annotations

from pyspark.sql import types as T

# Table and column names and types.
TABLE_DDL = {
    "flight_operational_events": (
        "event_id string, pnr string, customer_id string, flight_number string, itinerary string, "
        "orig_connection_mins int, new_connection_mins int, misconnect_risk boolean, "
        "event_timestamp timestamp_ntz"
    ),
    "unstructured_chat_signals": (
        "signal_id string, pnr string, customer_id string, signal_timestamp timestamp_ntz, "
        "sentiment string, message_text string"
    ),
    "action_gesture_shelf": (
        "action_id string, action_code string, action_description string, cost_usd double, "
        "requires_human boolean, policy_notes string"
    ),
    "historical_uplift_experiments": (
        "experiment_id string, customer_id string, archetype string, action_id string, "
        "gesture_applied boolean, uplift_score double"
    ),
    "concierge_inventory_lookup": (
        "lookup_id string, pnr string, alternate_flight string, departure_time timestamp_ntz, "
        "arrival_time timestamp_ntz, seats_available int, lounge_available boolean, "
        "inventory_status string, overnight_required boolean, destination string, "
        "hold_status string, hold_expires_at timestamp_ntz, amenity_type string, "
        "amenity_id string, amenity_status string"
    ),
    "irop_execution_results": (
        "exec_id string, case_id string, pnr string, customer_id string, scenario string, "
        "action_taken string, reasoning string, status string, success_flag boolean, "
        "executed_at timestamp_ntz"
    ),
    "passenger_profiles": (
        "customer_id string, full_name string, loyalty_tier string, lifetime_spend_usd double, "
        "lifetime_flights int, cabin_class_preference string, base_retention_propensity double"
    ),
    "orders": "order_id bigint, customer string, amount double, order_date string",
    "newtesttable": "id bigint, data string",
}

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(ddl: str) -> T.StructType:
    """StructType of a column list; needs no session, so modules can be imported before one."""
    return T.StructType(
        [T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(","))]
    )


SCHEMAS: dict[str, T.StructType] = {name: _schema(ddl) for name, ddl in TABLE_DDL.items()}

AUDIT_COLUMNS = SCHEMAS["irop_execution_results"].names
CHAT_COLUMNS = SCHEMAS["unstructured_chat_signals"].names
