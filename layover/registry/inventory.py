"""Queries that move the inventory and other tables to their next state."""

from pyspark.sql import functions as F

from layover.operators import decisions, inventory, mutate
from layover.registry import part, query
from layover.registry import text as _text  # noqa: F401  (shared oracle parts)
from layover.session import new_path
from layover.sources import inplace
from layover.sources.schemas import SCHEMAS
from layover.sources.tables import settle

COLUMNS = SCHEMAS["concierge_inventory_lookup"].names
AT_RISK = "SELECT pnr FROM v_flight_events WHERE misconnect_risk"


def inv(hold: str, state: str, alias: str = "i") -> str:
    swap = {"hold_status": f"{hold} AS hold_status", "inventory_status": f"{state} AS inventory_status"}
    return ", ".join(swap.get(c, f"{alias}.{c}") for c in COLUMNS)


def at_risk(t):
    return t.flight_events.filter("misconnect_risk")


query(
    "inventory_for_pnr",
    f"SELECT * FROM v_inventory WHERE pnr IN ({AT_RISK}) ORDER BY pnr, departure_time, lookup_id",
)(lambda t: inventory.for_pnrs(t.inventory, at_risk(t)))

# --- holds ---------------------------------------------------------------------------------


def held_sql(flights: str, extra: str = "") -> str:
    hit = f"i.alternate_flight IN ({flights}) AND i.pnr IN ({AT_RISK}){extra}"
    hold = f"CASE WHEN {hit} THEN 'HELD' ELSE i.hold_status END"
    state = f"CASE WHEN {hit} THEN 'AVAILABLE' ELSE i.inventory_status END"
    return f"SELECT {inv(hold, state)} FROM v_inventory i"


query("place_holds", held_sql("'EK372', 'EK380'"))(
    lambda t: inventory.place_holds(t.inventory, at_risk(t))
)
query("place_holds_with_seats", held_sql("'EK372', 'EK380'", " AND i.seats_available > 0"))(
    lambda t: inventory.place_holds(t.inventory, at_risk(t), require_seats=True)
)
query("re_hold", held_sql("'EK310', 'EK325', 'EK399'"))(
    lambda t: inventory.re_hold(t.inventory, at_risk(t), " EK310, EK325 ,,EK399")
)

# --- choices: the first open flight of each PNR, with a release list for some ---------------

part(
    "d_choices",
    """SELECT pnr, min(alternate_flight) AS chosen_flight,
 CASE WHEN max(arrival_time) > TIMESTAMP '1999-01-01 00:00:00' THEN ' ' || max(alternate_flight) || ' ,, EK372' ELSE '' END AS release_flights
FROM v_inventory WHERE seats_available > 0 GROUP BY pnr""",
)


def choices(t):
    late = F.max("arrival_time") > F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    listed = F.concat(F.lit(" "), F.max("alternate_flight"), F.lit(" ,, EK372"))
    return (
        t.inventory.filter("seats_available > 0")
        .groupBy("pnr")
        .agg(
            F.min("alternate_flight").alias("chosen_flight"),
            F.when(late, listed).otherwise("").alias("release_flights"),
        )
    )


CHOSEN = "coalesce(i.alternate_flight = c.chosen_flight, false)"
LISTED = "coalesce(list_contains(list_transform(string_split(c.release_flights, ','), lambda x: trim(x)), i.alternate_flight), false)"
JOINED = "FROM v_inventory i LEFT JOIN d_choices c ON c.pnr = i.pnr"
CONFIRM_HOLD = f"CASE WHEN {CHOSEN} THEN 'CONFIRMED' ELSE i.hold_status END"
CONFIRM_STATE = f"CASE WHEN {CHOSEN} THEN 'CONFIRMED' ELSE i.inventory_status END"

query("confirm_choice", f"SELECT {inv(CONFIRM_HOLD, CONFIRM_STATE)} {JOINED}")(
    lambda t: inventory.confirm(t.inventory, choices(t))
)
query(
    "release_others",
    f"SELECT {inv(f'CASE WHEN {LISTED} THEN {chr(39)}RELEASED{chr(39)} ELSE i.hold_status END', 'i.inventory_status')} {JOINED}",
)(lambda t: inventory.release(t.inventory, choices(t)))

FREED = f"""CASE WHEN trim(replace(coalesce(c.release_flights, ''), ',', '')) <> '' THEN {LISTED}
 ELSE coalesce(i.alternate_flight <> c.chosen_flight, false) END"""
query(
    "confirm_and_release",
    f"SELECT {inv(f'CASE WHEN {FREED} THEN {chr(39)}RELEASED{chr(39)} WHEN {CHOSEN} THEN {chr(39)}CONFIRMED{chr(39)} ELSE i.hold_status END', CONFIRM_STATE)} {JOINED}",
)(lambda t: inventory.confirm_and_release(t.inventory, settle(choices(t), "choices")))

query(
    "release_candidates",
    "SELECT i.pnr, i.lookup_id, i.alternate_flight, c.chosen_flight FROM v_inventory i JOIN d_choices c ON c.pnr = i.pnr WHERE i.alternate_flight <> c.chosen_flight",
)(lambda t: inventory.release_candidates(t.inventory, choices(t)))

query(
    "flight_except",
    "SELECT pnr, alternate_flight FROM v_inventory EXCEPT SELECT pnr, chosen_flight FROM d_choices",
)(
    lambda t: mutate.missing_values(
        t.inventory.select("pnr", "alternate_flight"),
        choices(t).select("pnr", F.col("chosen_flight").alias("alternate_flight")),
    )
)

part(
    "d_pull_choices",
    """SELECT pnr, arg_max(chosen_flight, (signal_timestamp, signal_id)) AS chosen_flight,
 arg_max(step <> 'CONTINUE_STAGED_CASE', (signal_timestamp, signal_id)) AS again FROM d_steps GROUP BY pnr""",
)
PULL_AGAIN = "(coalesce(c.again, false) AND i.alternate_flight IN ('EK372', 'EK380'))"
PULL_CHOSEN = "coalesce(i.alternate_flight = c.chosen_flight, false)"
PULL_FREED = "coalesce(i.alternate_flight = CASE c.chosen_flight WHEN 'EK372' THEN 'EK380' ELSE 'EK372' END, false) AND c.pnr IS NOT NULL"
query(
    "pull_inventory",
    f"""SELECT {inv(f"CASE WHEN {PULL_FREED} THEN 'RELEASED' WHEN {PULL_CHOSEN} THEN 'CONFIRMED' WHEN {PULL_AGAIN} THEN 'HELD' ELSE i.hold_status END",
                 f"CASE WHEN {PULL_CHOSEN} THEN 'CONFIRMED' WHEN {PULL_AGAIN} THEN 'AVAILABLE' ELSE i.inventory_status END")}
FROM v_inventory i LEFT JOIN d_pull_choices c ON c.pnr = i.pnr""",
)(
    lambda t: inventory.confirm_and_release(
        t.inventory, settle(decisions.latest_choices(decisions.concierge_steps(t.agent_output, t.exec)), "choices")
    )
)

# --- general mutation ----------------------------------------------------------------------

query("delete_where", "SELECT * FROM v_exec WHERE success_flag IS DISTINCT FROM false")(
    lambda t: mutate.delete_where(t.exec, "success_flag = false")
)
query(
    "update_where",
    """SELECT * REPLACE (CASE WHEN scenario = 'PUSH_NBA' AND success_flag THEN 'SUCCESS' ELSE status END AS status) FROM v_exec""",
)(
    lambda t: mutate.update_where(
        t.exec, "scenario = 'PUSH_NBA' AND success_flag", {"status": F.lit("SUCCESS")}
    )
)
query(
    "replace_rows",
    """SELECT customer_id, loyalty_tier, lifetime_flights FROM v_profile WHERE lifetime_flights <> 7
UNION ALL SELECT customer_id, loyalty_tier || ' (updated)', lifetime_flights + 1 FROM v_profile WHERE lifetime_flights = 7""",
)(
    lambda t: mutate.replace_rows(
        t.profile.select("customer_id", "loyalty_tier", "lifetime_flights"),
        "lifetime_flights = 7",
        t.profile.filter("lifetime_flights = 7").select(
            "customer_id",
            F.concat("loyalty_tier", F.lit(" (updated)")).alias("loyalty_tier"),
            (F.col("lifetime_flights") + 1).alias("lifetime_flights"),
        ),
    )
)
query(
    "update_from_keys",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
 THEN '?' ELSE o_orderpriority END AS data FROM orders""",
)(
    lambda t: mutate.update_from_keys(
        t.base("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("data")),
        t.base("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")),
        "id",
        {"data": F.lit("?")},
    )
)
part("d_target", "SELECT c_custkey AS id, c_mktsegment AS data FROM customer")
part("d_source", "SELECT o_custkey * 2 AS id, min(o_orderpriority) AS data FROM orders GROUP BY 1")
query(
    "merge_upsert",
    """SELECT t.id, CASE WHEN s.id IS NOT NULL THEN s.data || t.data ELSE t.data END AS data
FROM d_target t LEFT JOIN d_source s ON s.id = t.id
UNION ALL SELECT s.id, s.data FROM d_source s WHERE NOT EXISTS (SELECT 1 FROM d_target t WHERE t.id = s.id)""",
)(
    lambda t: mutate.merge_upsert(
        t.base("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("data")),
        t.base("orders")
        .groupBy((F.col("o_custkey") * 2).alias("id"))
        .agg(F.min("o_orderpriority").alias("data")),
        "id",
        {"data": F.concat("new_data", "data")},
    )
)
query(
    "drop_duplicates",
    """SELECT customer_id, pnr, flight_number FROM (SELECT customer_id, pnr, flight_number,
 row_number() OVER (PARTITION BY customer_id ORDER BY pnr, flight_number) AS rn FROM v_flight_events) WHERE rn = 1""",
)(
    lambda t: mutate.one_per_key(
        t.flight_events.select("customer_id", "pnr", "flight_number"), "customer_id"
    )
)
query(
    "derived_column",
    "SELECT o_orderkey * 3 AS id, o_orderpriority AS data FROM orders",
)(
    lambda t: t.base("orders")
    .select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("data"))
    .withColumn("id", F.col("id") * 3)
)
query("sample_rows")(lambda t: t.exec.sample(fraction=0.5, seed=3))
query(
    "sample_by_key",
    "SELECT * FROM v_exec WHERE ('0x' || substr(md5('3:' || exec_id), 1, 8))::BIGINT < 2147483648",
)(lambda t: mutate.sample_by_key(t.exec, "exec_id", 0.5, seed=3))
query(
    "insert_select_rows",
    """SELECT customer_id, pnr FROM v_flight_events UNION ALL SELECT customer_id, pnr FROM v_flight_events WHERE misconnect_risk""",
)(
    lambda t: mutate.append_rows(
        t.flight_events.select("customer_id", "pnr"), at_risk(t).select("customer_id", "pnr")
    )
)


# --- in place ------------------------------------------------------------------------------


@query(
    "hold_in_place",
    """SELECT lookup_id, pnr, alternate_flight, seats_available,
 CASE WHEN named THEN 'HELD' ELSE hold_status END AS hold_status, CASE WHEN named THEN 'AVAILABLE' ELSE inventory_status END AS inventory_status
FROM (SELECT i.*, coalesce(alternate_flight IN ('EK372', 'EK380') AND e.pnr IS NOT NULL, false) AS named FROM v_inventory i
 LEFT JOIN (SELECT DISTINCT pnr FROM v_flight_events WHERE new_connection_mins = 20) e ON e.pnr = i.pnr)""",
)
def hold_in_place(t):
    path = new_path(t.spark, "inventory")
    inplace.write_laid_out(t.inventory, path, "pnr", parts=64, read_again=True)
    pnrs = t.flight_events.filter("new_connection_mins = 20").select("pnr").distinct()
    inplace.change_keys(t.spark, path, t.inventory.schema, "pnr", pnrs, lambda rows: inventory.place_holds(rows, pnrs), parts=64)
    return inplace.read_laid_out(t.spark, path, t.inventory.schema).select(
        "lookup_id", "pnr", "alternate_flight", "seats_available", "hold_status", "inventory_status"
    )
